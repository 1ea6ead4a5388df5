"""C3 and its parts (period: Q1 1997 on the fixtures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.plans import promise_funnel as pf
from arrears.sources.fixtures import inputs

C3_START, C3_END = "1997-01-01", "1997-03-31"

_CTES = f"""
    q_cases AS (
        SELECT case_id, account_id, strategy_name, start_date,
               CAST(date_trunc('week', start_date) AS DATE) AS week_start
        FROM collection_cases WHERE start_date BETWEEN DATE '{C3_START}' AND DATE '{C3_END}'),
    in_window AS (
        SELECT q.*, e.event_dttm, e.contact_result, e.promised_amount, e.promise_to_pay_date
        FROM q_cases q JOIN contact_events e
          ON e.case_id = q.case_id
         AND CAST(e.event_dttm AS DATE) BETWEEN q.start_date AND q.start_date + 6),
    first_p AS (
        SELECT case_id, min(event_dttm) AS first_promise_dttm
        FROM in_window WHERE promised_amount > 0 OR promise_to_pay_date IS NOT NULL
        GROUP BY case_id),
    first_p_rows AS (
        SELECT f.case_id, q.account_id, q.week_start, q.strategy_name, f.first_promise_dttm,
               e.promise_to_pay_date, e.promised_amount
        FROM first_p f
        JOIN q_cases q ON q.case_id = f.case_id
        JOIN contact_events e ON e.case_id = f.case_id AND e.event_dttm = f.first_promise_dttm),
    paid_t AS (
        SELECT r.case_id, r.week_start, r.strategy_name, r.promised_amount, r.promise_to_pay_date,
               sum(p.payment_amount) AS paid_until_promise_date
        FROM first_p_rows r LEFT JOIN payments p
          ON p.account_id = r.account_id AND p.payment_amount > 0
         AND CAST(p.payment_dttm AS DATE) <= r.promise_to_pay_date
        GROUP BY r.case_id, r.week_start, r.strategy_name, r.promised_amount, r.promise_to_pay_date),
    tot AS (SELECT week_start, strategy_name, count(*) AS total_cases FROM q_cases GROUP BY 1, 2),
    rpc AS (SELECT week_start, strategy_name, count(DISTINCT case_id) AS rpc_cases_7d
            FROM in_window WHERE contact_result = 'RPC' GROUP BY 1, 2),
    prom AS (SELECT week_start, strategy_name, count(DISTINCT case_id) AS promise_cases_7d
             FROM in_window WHERE promised_amount > 0 OR promise_to_pay_date IS NOT NULL GROUP BY 1, 2),
    kept AS (SELECT week_start, strategy_name, count(*) AS kept_promise_cases
             FROM paid_t WHERE paid_until_promise_date >= promised_amount GROUP BY 1, 2),
    rec AS (SELECT q.week_start, q.strategy_name, sum(p.payment_amount) AS recovery_amount_14d
            FROM q_cases q JOIN payments p
              ON p.account_id = q.account_id AND p.payment_amount > 0
             AND CAST(p.payment_dttm AS DATE) BETWEEN q.start_date AND q.start_date + 13
            GROUP BY 1, 2)"""

_IN = ["collection_cases", "contact_events", "payments"]


def _o(body):
    return with_inputs(_IN, body, _CTES)


@query("cases_with_week", oracle=_o("SELECT * FROM q_cases"))
def cases_with_week(spark, sf_dir):
    """P2."""
    return pf.cases_with_week(inputs(spark, sf_dir).collection_cases, C3_START, C3_END)


@query(
    "promise_events",
    oracle=_o("SELECT * FROM contact_events WHERE promised_amount > 0 OR promise_to_pay_date IS NOT NULL"),
)
def promise_events(spark, sf_dir):
    """P5."""
    return inputs(spark, sf_dir).contact_events.where(pf.is_promise())


@query("rpc_events", oracle=_o("SELECT * FROM contact_events WHERE contact_result = 'RPC'"))
def rpc_events(spark, sf_dir):
    """P6."""
    return inputs(spark, sf_dir).contact_events.where(pf.is_rpc())


@query("cases_by_week_strategy", oracle=_o("SELECT * FROM tot"))
def cases_by_week_strategy(spark, sf_dir):
    """A2."""
    return pf.cases_by_week_strategy(inputs(spark, sf_dir).collection_cases, C3_START, C3_END)


@query("rpc_cases_by_week", oracle=_o("SELECT * FROM rpc"))
def rpc_cases_by_week(spark, sf_dir):
    """A10."""
    inp = inputs(spark, sf_dir)
    c = pf.funnel_counts(inp.collection_cases, inp.contact_events, C3_START, C3_END)
    return c.where(F.col("rpc_cases_7d").isNotNull()).select(*pf.KEYS, "rpc_cases_7d")


@query("promise_cases_by_week", oracle=_o("SELECT * FROM prom"))
def promise_cases_by_week(spark, sf_dir):
    """A11."""
    inp = inputs(spark, sf_dir)
    c = pf.funnel_counts(inp.collection_cases, inp.contact_events, C3_START, C3_END)
    return c.where(F.col("promise_cases_7d").isNotNull()).select(*pf.KEYS, "promise_cases_7d")


@query("first_promise_time", oracle=_o("SELECT * FROM first_p"))
def first_promise_time(spark, sf_dir):
    """W3."""
    inp = inputs(spark, sf_dir)
    return pf.first_promise_time(inp.collection_cases, inp.contact_events, C3_START, C3_END)


@query("first_promise_lookup", oracle=_o("SELECT * FROM first_p_rows"))
def first_promise_lookup(spark, sf_dir):
    """J10."""
    inp = inputs(spark, sf_dir)
    return pf.first_promise_details(inp.collection_cases, inp.contact_events, C3_START, C3_END)


@query(
    "payments_until_date_left",
    oracle=_o(
        "SELECT case_id, week_start, strategy_name, promised_amount, promise_to_pay_date, "
        "CAST(paid_until_promise_date AS DOUBLE) AS paid_until_promise_date FROM paid_t"
    ),
)
def payments_until_date_left(spark, sf_dir):
    """J7 (aggregated per first-promise group)."""
    inp = inputs(spark, sf_dir)
    t = pf.paid_until_promise(inp.collection_cases, inp.contact_events, inp.payments, C3_START, C3_END)
    return t.withColumn("paid_until_promise_date", F.col("paid_until_promise_date").cast("double"))


@query(
    "payments_until_date_rows",
    oracle=_o(
        """SELECT r.*, p.payment_id, p.payment_dttm, p.payment_amount
           FROM first_p_rows r LEFT JOIN payments p
             ON p.account_id = r.account_id AND p.payment_amount > 0
            AND CAST(p.payment_dttm AS DATE) <= r.promise_to_pay_date"""
    ),
)
def payments_until_date_rows(spark, sf_dir):
    """J7 (rows): each first-promise row with the payments up to its promise date."""
    inp = inputs(spark, sf_dir)
    return pf.promise_payment_rows(inp.collection_cases, inp.contact_events, inp.payments, C3_START, C3_END)


@query("kept_promise_by_week", oracle=_o("SELECT * FROM kept"))
def kept_promise_by_week(spark, sf_dir):
    """A12."""
    inp = inputs(spark, sf_dir)
    return pf.kept_promises(inp.collection_cases, inp.contact_events, inp.payments, C3_START, C3_END)


@query(
    "recovery_14d_by_week",
    oracle=_o("SELECT week_start, strategy_name, CAST(recovery_amount_14d AS DOUBLE) AS recovery_amount_14d FROM rec"),
)
def recovery_14d_by_week(spark, sf_dir):
    """A13."""
    inp = inputs(spark, sf_dir)
    r = pf.recovery_by_week(inp.collection_cases, inp.payments, C3_START, C3_END)
    return r.withColumn("recovery_amount_14d", F.col("recovery_amount_14d").cast("double"))


@query(
    "promise_funnel",
    oracle=_o(
        """SELECT t.week_start, t.strategy_name, t.total_cases, r.rpc_cases_7d, p.promise_cases_7d,
                  k.kept_promise_cases, CAST(c.recovery_amount_14d AS DOUBLE) AS recovery_amount_14d,
                  round(CAST(r.rpc_cases_7d AS DOUBLE) / nullif(t.total_cases, 0), 6) AS rpc_rate_7d,
                  round(CAST(p.promise_cases_7d AS DOUBLE) / nullif(r.rpc_cases_7d, 0), 6) AS promise_rate_from_rpc,
                  round(CAST(k.kept_promise_cases AS DOUBLE) / nullif(p.promise_cases_7d, 0), 6) AS kept_promise_rate
           FROM tot t
           LEFT JOIN rpc r USING (week_start, strategy_name)
           LEFT JOIN prom p USING (week_start, strategy_name)
           LEFT JOIN kept k USING (week_start, strategy_name)
           LEFT JOIN rec c USING (week_start, strategy_name)"""
    ),
)
def promise_funnel(spark, sf_dir):
    """C3."""
    inp = inputs(spark, sf_dir)
    return pf.promise_funnel(inp.collection_cases, inp.contact_events, inp.payments, C3_START, C3_END)
