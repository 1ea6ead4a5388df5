"""C4 (collection summary per overdue bucket) and its row-level pieces, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.plans import bucket_summary as bs
from arrears.sources.fixtures import inputs

_IN = ["cases", "contacts", "payments"]
_CTES = """
    dedup AS (
        SELECT event_id, case_id, event_dttm, channel, contact_result FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id
                       ORDER BY event_dttm DESC NULLS LAST, case_id DESC, channel DESC, contact_result DESC) AS rn
            FROM contacts) WHERE rn = 1),
    pos AS (SELECT * FROM payments WHERE payment_amount > 0),
    c_win AS (
        SELECT c.dpd_bucket, c.case_id FROM dedup e JOIN cases c ON e.case_id IS NOT DISTINCT FROM c.case_id
        WHERE e.event_dttm >= c.start_date AND e.event_dttm <= c.start_date + INTERVAL 6 DAY),
    p_win AS (
        SELECT c.dpd_bucket, c.case_id, p.payment_amount FROM pos p JOIN cases c ON p.account_id IS NOT DISTINCT FROM c.account_id
        WHERE p.payment_dttm >= c.start_date AND p.payment_dttm <= c.start_date + INTERVAL 6 DAY)"""


@query(
    "contacts_window_ts",
    oracle=with_inputs(
        _IN,
        """SELECT e.*, c.start_date, c.dpd_bucket FROM dedup e JOIN cases c ON e.case_id IS NOT DISTINCT FROM c.case_id
           WHERE e.event_dttm >= c.start_date AND e.event_dttm <= c.start_date + INTERVAL 6 DAY""",
        _CTES,
    ),
)
def contacts_window_ts(spark, sf_dir):
    """J5 + P7: de-duplicated contacts merged with their case, timestamp window (rows)."""
    inp = inputs(spark, sf_dir)
    cases, contacts, _ = bs.preprocess(inp.cases, inp.contacts, inp.payments)
    return bs.contacts_in_window(cases, contacts, 6)


@query(
    "distinct_cases_by_bucket",
    oracle=with_inputs(
        _IN,
        """SELECT t.dpd_bucket, t.total_cases, k.contacted_cases_7d, p.paid_cases_7d FROM
             (SELECT dpd_bucket, count(DISTINCT case_id) AS total_cases FROM cases
              WHERE dpd_bucket IS NOT NULL GROUP BY 1) t
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS contacted_cases_7d FROM c_win GROUP BY 1) k
             USING (dpd_bucket)
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS paid_cases_7d FROM p_win GROUP BY 1) p
             USING (dpd_bucket)""",
        _CTES,
    ),
)
def distinct_cases_by_bucket(spark, sf_dir):
    """A32 + U1: distinct cases per bucket — all, contacted and paid in the timestamp window."""
    inp = inputs(spark, sf_dir)
    out = bs.collection_summary(*bs.preprocess(inp.cases, inp.contacts, inp.payments))
    return out.select(
        "dpd_bucket", "total_cases",
        F.nullif("contacted_cases_7d", F.lit(0)).alias("contacted_cases_7d"),
        F.nullif("paid_cases_7d", F.lit(0)).alias("paid_cases_7d"),
    )


@query(
    "collected_by_bucket",
    oracle=with_inputs(
        _IN, "SELECT dpd_bucket, CAST(sum(payment_amount) AS DOUBLE) AS collected_amount_7d FROM p_win GROUP BY 1", _CTES
    ),
)
def collected_by_bucket(spark, sf_dir):
    """A33."""
    inp = inputs(spark, sf_dir)
    out = bs.collection_summary(*bs.preprocess(inp.cases, inp.contacts, inp.payments))
    return out.where(F.col("paid_cases_7d") > 0).select("dpd_bucket", "collected_amount_7d")


@query(
    "collection_summary",
    oracle=with_inputs(
        _IN,
        """SELECT CASE WHEN t.dpd_bucket IN ('1-30', '31-60', '61-90', '90+') THEN t.dpd_bucket END AS dpd_bucket,
                  t.total_cases,
                  coalesce(k.n, 0) AS contacted_cases_7d,
                  coalesce(p.n, 0) AS paid_cases_7d,
                  coalesce(CAST(p.amount AS DOUBLE), 0.0) AS collected_amount_7d,
                  coalesce(round(CAST(p.amount AS DOUBLE) / nullif(CAST(p.n AS DOUBLE), 0), 6), 0.0)
                      AS avg_payment_per_paid_case_7d
           FROM (SELECT dpd_bucket, count(DISTINCT case_id) AS total_cases FROM cases
                 WHERE dpd_bucket IS NOT NULL GROUP BY 1) t
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS n FROM c_win GROUP BY 1) k USING (dpd_bucket)
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS n, sum(payment_amount) AS amount
                      FROM p_win GROUP BY 1) p USING (dpd_bucket)""",
        _CTES,
    ),
)
def collection_summary(spark, sf_dir):
    """C4: D1 preprocessing + the summary plan."""
    inp = inputs(spark, sf_dir)
    return bs.collection_summary(*bs.preprocess(inp.cases, inp.contacts, inp.payments))


@query(
    "build_collection_summary",
    oracle=with_inputs(
        _IN,
        """SELECT CASE WHEN t.dpd_bucket IN ('1-30', '31-60', '61-90', '90+') THEN t.dpd_bucket END AS dpd_bucket,
                  t.total_cases,
                  coalesce(k.n, 0) AS contacted_cases_7d,
                  coalesce(p.n, 0) AS paid_cases_7d,
                  coalesce(CAST(p.amount AS DOUBLE), 0.0) AS collected_amount_7d,
                  coalesce(round(CAST(p.amount AS DOUBLE) / nullif(CAST(p.n AS DOUBLE), 0), 6), 0.0)
                      AS avg_payment_per_paid_case_7d
           FROM (SELECT dpd_bucket, count(DISTINCT case_id) AS total_cases FROM cases
                 WHERE dpd_bucket IS NOT NULL GROUP BY 1) t
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS n FROM c_win GROUP BY 1) k USING (dpd_bucket)
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS n, sum(payment_amount) AS amount
                      FROM p_win GROUP BY 1) p USING (dpd_bucket)""",
        _CTES,
    ),
)
def build_collection_summary(spark, sf_dir):
    """The public entry — C4 with the emptiness checks counted in the same pass."""
    inp = inputs(spark, sf_dir)
    return bs.build_collection_summary(inp.cases, inp.contacts, inp.payments)


@query(
    "distinct_pairs",
    oracle=with_inputs(_IN, "SELECT DISTINCT dpd_bucket, case_id FROM c_win", _CTES),
)
def distinct_pairs(spark, sf_dir):
    """Unique (dpd_bucket, case_id) pairs of contacted cases in the timestamp window."""
    inp = inputs(spark, sf_dir)
    cases, contacts, _ = bs.preprocess(inp.cases, inp.contacts, inp.payments)
    return bs.contacted_pairs(cases, contacts, 6)


@query(
    "order_by_bucket",
    oracle=with_inputs(
        _IN,
        """SELECT CASE WHEN dpd_bucket IN ('1-30', '31-60', '61-90', '90+') THEN dpd_bucket END AS dpd_bucket,
                  CAST(CASE dpd_bucket WHEN '1-30' THEN 1 WHEN '31-60' THEN 2 WHEN '61-90' THEN 3 WHEN '90+' THEN 4 END
                       AS INTEGER) AS bucket_rank
           FROM (SELECT DISTINCT dpd_bucket FROM cases WHERE dpd_bucket IS NOT NULL)""",
        _CTES,
    ),
)
def order_by_bucket(spark, sf_dir):
    """The summary's buckets with their position in the domain order (unknown → NULL, last)."""
    from arrears.functions import bucket_rank

    inp = inputs(spark, sf_dir)
    out = bs.build_collection_summary(inp.cases, inp.contacts, inp.payments)
    return out.select("dpd_bucket", bucket_rank("dpd_bucket").alias("bucket_rank"))
