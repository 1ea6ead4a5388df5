"""DuckDB SQL for the fixture inputs (FIXTURES.md §2), used only by the correctness oracle.

Written independently of :mod:`arrears.sources.fixtures`: the oracle sees only the raw driver
views (``orders``, ``lineitem``, ...), so every oracle text starts with the inputs it needs as CTEs.
"""

from __future__ import annotations

BUCKET = "CASE {k} % 5 WHEN 1 THEN '31-60' WHEN 2 THEN '61-90' WHEN 3 THEN '90+' ELSE '1-30' END"

STRATEGY = (
    "CASE {p} WHEN '1-URGENT' THEN 'late_stage' WHEN '2-HIGH' THEN 'mixed' "
    "WHEN '3-MEDIUM' THEN 'sms_first' WHEN '4-NOT SPECIFIED' THEN 'soft_call' ELSE 'other' END"
)

FIXTURE_SQL: dict[str, str] = {
    "geo": """
        SELECT c.*, r.r_name
        FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "lo": """
        SELECT l.*, o.o_custkey, o.o_orderdate
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "accounts": """
        SELECT CASE WHEN c_custkey % 50 = 49 THEN -c_custkey ELSE c_custkey END AS account_id,
               CAST(CAST(abs(c_acctbal) AS DECIMAL(10,2)) * 100 AS DECIMAL(10,2)) AS principal_amount,
               c_mktsegment AS product_type,
               r_name AS region
        FROM geo""",
    "collection_cases": f"""
        SELECT o_orderkey AS case_id, o_custkey AS account_id, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS start_date,
               {STRATEGY.format(p='o_orderpriority')} AS strategy_name,
               {BUCKET.format(k='o_orderkey')} AS dpd_bucket
        FROM orders""",
    "contact_events": """
        SELECT l_orderkey * 8 + l_linenumber AS event_id,
               l_orderkey AS case_id,
               o_orderdate + to_days(CAST(l_partkey % 14 - 2 AS INTEGER))
                           + to_hours(CAST((l_suppkey * 7 + l_linenumber) % 12 AS INTEGER)) AS event_dttm,
               CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'sms' WHEN 'R' THEN 'email' END AS channel,
               CASE l_partkey % 4 WHEN 0 THEN 'RPC' WHEN 1 THEN 'Promise' WHEN 2 THEN 'No answer'
                                  WHEN 3 THEN 'Wrong number' END AS contact_result,
               CASE WHEN l_partkey % 4 = 1 AND l_linenumber <> 7
                    THEN CAST(o_orderdate AS DATE)
                         + CAST(l_partkey % 14 + CAST(l_quantity AS INTEGER) % 15 AS INTEGER) END
                   AS promise_to_pay_date,
               CASE WHEN l_partkey % 4 = 1 AND l_linenumber <> 6
                    THEN CAST(l_extendedprice AS DECIMAL(10,2)) END AS promised_amount
        FROM lo""",
    "payments": """
        SELECT l_orderkey * 8 + l_linenumber AS payment_id,
               o_custkey AS account_id,
               o_orderdate + to_days(CAST(l_suppkey % 25 AS INTEGER))
                           + to_hours(CAST((l_partkey * 5 + l_linenumber) % 24 AS INTEGER)) AS payment_dttm,
               CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -l_extendedprice
                         WHEN l_quantity = 1 THEN 0.0
                         ELSE l_extendedprice END AS DECIMAL(10,2)) AS payment_amount
        FROM lo""",
    "cases": """
        SELECT cc.case_id, cc.account_id, cc.customer_id, CAST(cc.start_date AS TIMESTAMP) AS start_date,
               cc.dpd_bucket, cc.strategy_name, a.principal_amount
        FROM collection_cases cc LEFT JOIN accounts a ON a.account_id = cc.account_id""",
    "contacts": """
        SELECT event_id, case_id, event_dttm, channel, contact_result FROM contact_events""",
    "sms_ab_test": """
        SELECT c_custkey AS customer_id,
               CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_name,
               c_mktsegment AS segment,
               CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE 1 END AS delivered_flg,
               CASE WHEN c_acctbal >= 7500 - 800 * (c_custkey % 2) THEN 1 ELSE 0 END AS paid_7d_flg,
               CASE WHEN c_acctbal >= 7500 - 800 * (c_custkey % 2) THEN c_acctbal ELSE 0.0 END AS paid_amount_7d
        FROM customer""",
    "actions_log": """
        SELECT user_id AS customer_id, ts AS action_dttm,
               CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'sms'
                               WHEN 'signup' THEN 'promise' WHEN 'purchase' THEN 'payment'
                               ELSE 'other' END AS action_type,
               CASE WHEN event_type IN ('signup', 'purchase') THEN value ELSE 0.0 END AS action_amount
        FROM events""",
    "daily_snapshot": """
        SELECT c_custkey AS customer_id,
               TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(k AS INTEGER)) AS snapshot_date,
               CAST((c_custkey * 7 + k) % 120 AS BIGINT) AS dpd,
               abs(c_acctbal) AS outstanding_amount
        FROM customer CROSS JOIN range(0, 29, 4) t(k)""",
    "train": f"""
        SELECT o_custkey AS customer_id, o_orderdate AS snapshot_date,
               {BUCKET.format(k='o_orderkey')} AS dpd_bucket,
               o_totalprice AS outstanding_amount,
               CASE WHEN o_orderkey % 12 = 5 THEN NULL ELSE abs(c_acctbal) END AS income,
               r_name AS region, c_mktsegment AS product_type,
               (o_orderkey * 13) % 6 AS contacts_last_7d,
               (o_orderkey * 7) % 4 AS rpc_last_30d,
               (o_orderkey * 11) % 3 AS promises_last_30d,
               CAST(1000.0 AS DOUBLE) * ((o_orderkey * 17) % 10) AS payments_amount_last_30d,
               CASE WHEN (o_orderkey * 7919) % 1000 < 250 + 100 * ((o_orderkey * 7) % 4)
                                                     + 50 * ((o_orderkey * 11) % 3)
                    THEN 1 ELSE 0 END AS target_paid_30d,
               o_orderkey AS row_id
        FROM orders JOIN geo ON o_custkey = c_custkey""",
    "train_scores": """
        SELECT o_custkey AS customer_id, o_orderdate AS snapshot_date,
               CAST(200 + 9 * ((o_orderkey * 7919) % 1000) AS DOUBLE) / 10000 AS score,
               o_orderkey AS row_id
        FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'""",
    "scored_orders": """
        SELECT o.*, g.r_name, (o_orderkey * 6151) % 1000 AS s
        FROM orders o JOIN geo g ON o.o_custkey = g.c_custkey
        WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    "scoring_results": f"""
        SELECT o_custkey AS customer_id, o_orderdate AS snapshot_date,
               CAST(s * s AS DOUBLE) / 1000000 AS score,
               CASE WHEN s + (o_orderkey * 31) % 500 > 800 THEN 1 ELSE 0 END AS target_paid_30d,
               o_totalprice AS recovered_amount_30d,
               {BUCKET.format(k='o_orderkey')} AS dpd_bucket,
               r_name AS region,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS current_contact_flg,
               o_orderkey AS row_id
        FROM scored_orders""",
    "eval_scores": f"""
        SELECT o_orderkey AS row_id,
               CASE WHEN s + (o_orderkey * 31) % 500 > 800 THEN 1 ELSE 0 END AS y_true,
               CAST(s * s AS DOUBLE) / 1000000 AS baseline_proba,
               CAST(s + (o_orderkey * 4409) % 600 AS DOUBLE) / 1600 AS boosted_proba,
               {BUCKET.format(k='o_orderkey')} AS dpd_bucket,
               r_name AS region
        FROM scored_orders""",
}

# which fixture CTEs each one depends on (in definition order)
_DEPS = {
    "geo": [],
    "lo": [],
    "accounts": ["geo"],
    "collection_cases": [],
    "contact_events": ["lo"],
    "payments": ["lo"],
    "cases": ["collection_cases", "accounts"],
    "contacts": ["contact_events"],
    "sms_ab_test": [],
    "actions_log": [],
    "daily_snapshot": [],
    "train": ["geo"],
    "train_scores": [],
    "scored_orders": ["geo"],
    "scoring_results": ["scored_orders"],
    "eval_scores": ["scored_orders"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_inputs(names: list[str], body: str, extra_ctes: str = "") -> str:
    """``WITH <fixture CTEs>[, extra] <body>`` — body is a SELECT (may use further CTEs via extra)."""
    parts = [f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in _closure(names)]
    head = "WITH " + ",\n".join(parts)
    if extra_ctes.strip():
        head += ",\n" + extra_ctes.strip()
    return f"{head}\n{body.strip()}"


def erfc_sql(x: str) -> str:
    """DuckDB text of the same erfc evaluation as :func:`arrears.functions.erfc` (x >= 0)."""
    series = (
        f"list_reduce(range(1, 121), lambda acc, n: {{'t': acc.t * 2.0 * ({x}) * ({x}) / (2 * n + 1), "
        f"'s': acc.s + acc.t * 2.0 * ({x}) * ({x}) / (2 * n + 1)}}, {{'t': ({x}), 's': ({x})}}).s"
    )
    frac = f"list_reduce(range(80, 0, -1), lambda k, n: ({x}) + (n / 2.0) / k, ({x}))"
    return (
        f"(CASE WHEN ({x}) <= 3.0 THEN 1.0 - 2.0 / sqrt(pi()) * exp(-({x}) * ({x})) * {series} "
        f"ELSE exp(-({x}) * ({x})) / sqrt(pi()) / {frac} END)"
    )
