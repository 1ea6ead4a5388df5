"""C1 and its building blocks over the fixture inputs (period: FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.functions import ratio
from arrears.oracle_fixtures import with_inputs
from arrears.plans import strategy as st
from arrears.sources.fixtures import inputs

C1_START, C1_END = "1997-02-01", "1997-02-28"

# oracle helpers: the period and the two windows, written the SQL way
_PERIOD = f"start_date BETWEEN DATE '{C1_START}' AND DATE '{C1_END}'"
_CONTACT_HITS = """
    contact_hits AS (
        SELECT c.case_id, c.strategy_name, c.start_date, e.event_id, e.event_dttm, e.channel, e.contact_result
        FROM period_cases c JOIN contact_events e
          ON e.case_id = c.case_id
         AND CAST(e.event_dttm AS DATE) >= c.start_date
         AND CAST(e.event_dttm AS DATE) <= c.start_date + 6)"""
_PAYMENT_HITS = """
    payment_hits AS (
        SELECT c.case_id, c.account_id, c.strategy_name, c.start_date,
               p.payment_id, p.payment_dttm, p.payment_amount
        FROM period_cases c JOIN payments p
          ON p.account_id = c.account_id AND p.payment_amount > 0
         AND CAST(p.payment_dttm AS DATE) >= c.start_date
         AND CAST(p.payment_dttm AS DATE) <= c.start_date + 6)"""
_PERIOD_CASES = f"period_cases AS (SELECT * FROM collection_cases WHERE {_PERIOD})"


def _oracle(inputs_needed, body, *ctes):
    return with_inputs(inputs_needed, body, ",\n".join((_PERIOD_CASES,) + ctes))


@query("scan_table", oracle=with_inputs(["collection_cases"], "SELECT * FROM collection_cases"))
def scan_table(spark, sf_dir):
    """S3: full scan of a base table."""
    return inputs(spark, sf_dir).collection_cases


@query("cases_in_period", oracle=_oracle(["collection_cases"], "SELECT * FROM period_cases"))
def cases_in_period(spark, sf_dir):
    return st.cases_in_period(inputs(spark, sf_dir).collection_cases, C1_START, C1_END)


@query(
    "positive_payments",
    oracle=with_inputs(["payments"], "SELECT * FROM payments WHERE payment_amount > 0"),
)
def positive_payments(spark, sf_dir):
    """P3."""
    return inputs(spark, sf_dir).payments.where(F.col("payment_amount") > 0)


@query(
    "nonpositive_payment_count",
    oracle=with_inputs(["payments"], "SELECT count(*) AS nonpositive_payments FROM payments WHERE payment_amount <= 0"),
)
def nonpositive_payment_count(spark, sf_dir):
    """P4."""
    p = inputs(spark, sf_dir).payments
    return p.where(F.col("payment_amount") <= 0).agg(F.count(F.lit(1)).alias("nonpositive_payments"))


@query(
    "cases_accounts_join",
    oracle=_oracle(
        ["collection_cases", "accounts"],
        "SELECT c.*, a.principal_amount, a.product_type, a.region "
        "FROM period_cases c JOIN accounts a ON a.account_id = c.account_id",
    ),
)
def cases_accounts_join(spark, sf_dir):
    """Inner equi join cases ⋈ accounts."""
    inp = inputs(spark, sf_dir)
    return st.cases_in_period(inp.collection_cases, C1_START, C1_END).join(inp.accounts, "account_id")


@query(
    "contacts_in_window",
    oracle=_oracle(["collection_cases", "contact_events"], "SELECT * FROM contact_hits", _CONTACT_HITS),
)
def contacts_in_window(spark, sf_dir):
    inp = inputs(spark, sf_dir)
    return st.contacts_in_window(inp.collection_cases, inp.contact_events, C1_START, C1_END)


@query(
    "contacts_in_window_left",
    oracle=_oracle(
        ["collection_cases", "contact_events"],
        """SELECT c.case_id, c.strategy_name, c.start_date, e.event_id, e.event_dttm, e.channel, e.contact_result
           FROM period_cases c LEFT JOIN contact_events e
             ON e.case_id = c.case_id
            AND CAST(e.event_dttm AS DATE) BETWEEN c.start_date AND c.start_date + 6""",
    ),
)
def contacts_in_window_left(spark, sf_dir):
    inp = inputs(spark, sf_dir)
    return st.contacts_in_window_left(inp.collection_cases, inp.contact_events, C1_START, C1_END)


@query(
    "payments_in_window",
    oracle=_oracle(["collection_cases", "payments"], "SELECT * FROM payment_hits", _PAYMENT_HITS),
)
def payments_in_window(spark, sf_dir):
    inp = inputs(spark, sf_dir)
    return st.payments_in_window(inp.collection_cases, inp.payments, C1_START, C1_END)


@query(
    "cases_by_strategy",
    oracle=_oracle(
        ["collection_cases"],
        "SELECT strategy_name, count(*) AS total_cases FROM period_cases GROUP BY strategy_name",
    ),
)
def cases_by_strategy(spark, sf_dir):
    """A1."""
    return st.cases_by_strategy(inputs(spark, sf_dir).collection_cases, C1_START, C1_END)


@query(
    "contacted_cases_total",
    oracle=_oracle(
        ["collection_cases", "contact_events"],
        "SELECT count(DISTINCT case_id) AS contacted_cases_7d FROM contact_hits",
        _CONTACT_HITS,
    ),
)
def contacted_cases_total(spark, sf_dir):
    """A3: global distinct contacted cases."""
    inp = inputs(spark, sf_dir)
    hits = st.contacts_in_window(inp.collection_cases, inp.contact_events, C1_START, C1_END)
    return hits.agg(F.countDistinct("case_id").alias("contacted_cases_7d"))


@query(
    "paid_cases_total",
    oracle=_oracle(
        ["collection_cases", "payments"],
        "SELECT count(DISTINCT case_id) AS paid_cases_7d FROM payment_hits",
        _PAYMENT_HITS,
    ),
)
def paid_cases_total(spark, sf_dir):
    """A4."""
    inp = inputs(spark, sf_dir)
    hits = st.payment_day_hits(inp.collection_cases, inp.payments, C1_START, C1_END)
    return hits.agg(F.countDistinct("case_id").alias("paid_cases_7d"))


@query(
    "collected_total",
    oracle=_oracle(
        ["collection_cases", "payments"],
        "SELECT CAST(sum(payment_amount) AS DOUBLE) AS collected_amount_7d FROM payment_hits",
        _PAYMENT_HITS,
    ),
)
def collected_total(spark, sf_dir):
    """A5."""
    inp = inputs(spark, sf_dir)
    hits = st.payment_day_hits(inp.collection_cases, inp.payments, C1_START, C1_END)
    return hits.agg(F.sum("amount").cast("double").alias("collected_amount_7d"))


@query(
    "paid_cases_by_strategy",
    oracle=_oracle(
        ["collection_cases", "payments"],
        "SELECT strategy_name, count(DISTINCT case_id) AS paid_cases_7d FROM payment_hits GROUP BY 1",
        _PAYMENT_HITS,
    ),
)
def paid_cases_by_strategy(spark, sf_dir):
    """A6."""
    inp = inputs(spark, sf_dir)
    return st.paid_by_strategy(inp.collection_cases, inp.payments, C1_START, C1_END).select(
        "strategy_name", "paid_cases_7d"
    )


@query(
    "collected_by_strategy",
    oracle=_oracle(
        ["collection_cases", "payments"],
        "SELECT strategy_name, CAST(sum(payment_amount) AS DOUBLE) AS collected_amount_7d "
        "FROM payment_hits GROUP BY 1",
        _PAYMENT_HITS,
    ),
)
def collected_by_strategy(spark, sf_dir):
    """A7."""
    inp = inputs(spark, sf_dir)
    return st.paid_by_strategy(inp.collection_cases, inp.payments, C1_START, C1_END).select(
        "strategy_name", F.col("collected_amount_7d").cast("double").alias("collected_amount_7d")
    )


@query(
    "avg_collected_per_paid_case",
    oracle=_oracle(
        ["collection_cases", "payments"],
        "SELECT strategy_name, round(CAST(sum(payment_amount) AS DOUBLE) / count(DISTINCT case_id), 6) "
        "AS avg_collected_per_paid_case_7d FROM payment_hits GROUP BY 1",
        _PAYMENT_HITS,
    ),
)
def avg_collected_per_paid_case(spark, sf_dir):
    """A8."""
    inp = inputs(spark, sf_dir)
    by = st.paid_by_strategy(inp.collection_cases, inp.payments, C1_START, C1_END)
    return by.select("strategy_name", ratio("collected_amount_7d", "paid_cases_7d").alias("avg_collected_per_paid_case_7d"))


@query(
    "collection_rate_safe",
    oracle=_oracle(
        ["collection_cases", "accounts", "payments"],
        """SELECT pr.strategy_name,
                  round(CAST(col.amount AS DOUBLE) / nullif(CAST(pr.principal AS DOUBLE), 0), 6) AS collection_rate_7d
           FROM (SELECT c.strategy_name, sum(a.principal_amount) AS principal
                 FROM period_cases c JOIN accounts a USING (account_id) GROUP BY 1) pr
           LEFT JOIN (SELECT strategy_name, sum(payment_amount) AS amount FROM payment_hits GROUP BY 1) col
             USING (strategy_name)""",
        _PAYMENT_HITS,
    ),
)
def collection_rate_safe(spark, sf_dir):
    """Collected / principal with both sides aggregated before the join."""
    inp = inputs(spark, sf_dir)
    base = st.principal_by_strategy(inp.collection_cases, inp.accounts, C1_START, C1_END)
    paid = st.paid_by_strategy(inp.collection_cases, inp.payments, C1_START, C1_END)
    return base.join(paid, "strategy_name", "left").select(
        "strategy_name", ratio("collected_amount_7d", "total_principal_amount").alias("collection_rate_7d")
    )


@query(
    "fanout_biased_rate",
    oracle=_oracle(
        ["collection_cases", "accounts", "payments"],
        """SELECT h.strategy_name,
                  round(CAST(sum(h.payment_amount) AS DOUBLE) / nullif(CAST(sum(a.principal_amount) AS DOUBLE), 0), 6)
                      AS collection_rate_7d
           FROM payment_hits h JOIN accounts a ON a.account_id = h.account_id
           GROUP BY 1""",
        _PAYMENT_HITS,
    ),
)
def fanout_biased_rate(spark, sf_dir):
    """J13."""
    inp = inputs(spark, sf_dir)
    return st.fanout_biased_rate(inp.collection_cases, inp.accounts, inp.payments, C1_START, C1_END)


@query(
    "strategy_effectiveness_7d",
    oracle=_oracle(
        ["collection_cases", "accounts", "contact_events", "payments"],
        """SELECT b.strategy_name,
                  b.total_cases,
                  k.contacted AS contacted_cases_7d,
                  p.paid AS paid_cases_7d,
                  CAST(p.amount AS DOUBLE) AS collected_amount_7d,
                  round(CAST(p.amount AS DOUBLE) / nullif(CAST(p.paid AS DOUBLE), 0), 6)
                      AS avg_collected_per_paid_case_7d,
                  round(CAST(p.amount AS DOUBLE) / nullif(CAST(b.principal AS DOUBLE), 0), 6) AS collection_rate_7d
           FROM (SELECT c.strategy_name, count(*) AS total_cases, sum(a.principal_amount) AS principal
                 FROM period_cases c JOIN accounts a USING (account_id) GROUP BY 1) b
           LEFT JOIN (SELECT strategy_name, count(DISTINCT case_id) AS contacted FROM contact_hits GROUP BY 1) k
             USING (strategy_name)
           LEFT JOIN (SELECT strategy_name, count(DISTINCT case_id) AS paid, sum(payment_amount) AS amount
                      FROM payment_hits GROUP BY 1) p
             USING (strategy_name)""",
        _CONTACT_HITS,
        _PAYMENT_HITS,
    ),
)
def strategy_effectiveness_7d(spark, sf_dir):
    """C1."""
    inp = inputs(spark, sf_dir)
    return st.strategy_effectiveness(
        inp.collection_cases, inp.accounts, inp.contact_events, inp.payments, C1_START, C1_END
    )


@query(
    "ordered_output",
    oracle=_oracle(
        ["collection_cases", "accounts"],
        """SELECT c.strategy_name, count(*) AS total_cases
           FROM period_cases c JOIN accounts a USING (account_id) GROUP BY 1 ORDER BY 1""",
    ),
)
def ordered_output(spark, sf_dir):
    """K1: final ordering by key (cases with an account per strategy, sorted)."""
    inp = inputs(spark, sf_dir)
    return st.principal_by_strategy(inp.collection_cases, inp.accounts, C1_START, C1_END).select(
        "strategy_name", "total_cases"
    ).orderBy("strategy_name")
