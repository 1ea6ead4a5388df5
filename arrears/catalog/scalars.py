"""Entries for single expressions and helpers (P9-P12, J12, F1-F5, F7-F10) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.functions import (
    date_of,
    days_ago,
    floor_days_between,
    plus_days,
    ratio,
    ratio_or_zero,
    two_sided_normal_p,
    week_start,
)
from arrears.operators import profile as pr
from arrears.oracle_fixtures import with_inputs
from arrears.plans.payment_model import CAT_COLS, fill_categories
from arrears.sources.fixtures import inputs


@query(
    "event_dates",
    oracle=with_inputs(
        ["contact_events"],
        """SELECT event_id, CAST(event_dttm AS DATE) AS event_date, CAST(event_dttm AS DATE) + 6 AS window_end,
                  CAST(date_trunc('week', event_dttm) AS DATE) AS week_start,
                  event_dttm - INTERVAL 30 DAY AS month_before FROM contact_events""",
    ),
)
def event_dates(spark, sf_dir):
    """Day, day + 6, Monday and the time 30 days earlier of every contact."""
    e = inputs(spark, sf_dir).contact_events
    return e.select("event_id", date_of("event_dttm").alias("event_date"),
                    plus_days(date_of("event_dttm"), 6).alias("window_end"),
                    week_start(date_of("event_dttm")).alias("week_start"), days_ago("event_dttm", 30).alias("month_before"))


@query(
    "days_between",
    oracle=with_inputs(
        ["collection_cases", "contact_events"],
        """SELECT e.event_id, c.case_id,
                  CAST(floor(date_diff('second', CAST(c.start_date AS TIMESTAMP), e.event_dttm) / 86400.0) AS BIGINT) AS days
           FROM collection_cases c JOIN contact_events e ON e.case_id = c.case_id""",
    ),
)
def days_between(spark, sf_dir):
    """whole days from a case's start to each of its contacts, floored."""
    inp = inputs(spark, sf_dir)
    cases = inp.collection_cases.select("case_id", F.col("start_date").cast("timestamp_ntz").alias("start_dttm"))
    joined = cases.join(inp.contact_events.select("event_id", "case_id", "event_dttm"), "case_id")
    return joined.select("event_id", "case_id", floor_days_between("event_dttm", "start_dttm").alias("days"))


@query(
    "safe_ratio",
    oracle=with_inputs(
        ["payments", "accounts"],
        """SELECT a.account_id, round(CAST(p.paid AS DOUBLE) / nullif(CAST(a.principal_amount AS DOUBLE), 0), 6) AS rate,
                  coalesce(round(CAST(p.paid AS DOUBLE) / nullif(CAST(a.principal_amount AS DOUBLE), 0), 6), 0) AS rate_or_zero,
                  CAST(a.principal_amount AS DOUBLE) AS principal
           FROM accounts a LEFT JOIN (SELECT account_id, sum(payment_amount) AS paid FROM payments GROUP BY 1) p
             ON p.account_id = a.account_id""",
    ),
)
def safe_ratio(spark, sf_dir):
    """P12, F4 (and J12's shape): paid per principal of every account, both variants."""
    inp = inputs(spark, sf_dir)
    paid = inp.payments.groupBy("account_id").agg(F.sum("payment_amount").alias("paid"))
    return inp.accounts.join(paid, "account_id", "left").select(
        "account_id", ratio("paid", "principal_amount").alias("rate"),
        ratio_or_zero("paid", "principal_amount").alias("rate_or_zero"),
        F.col("principal_amount").cast("double").alias("principal"))


@query(
    "left_join_metric_chain",
    oracle=with_inputs(
        ["collection_cases", "contact_events"],
        """SELECT b.dpd_bucket, b.strategy_name, b.cases, coalesce(c.contacted, 0) AS contacted, coalesce(r.rpc, 0) AS rpc
           FROM (SELECT dpd_bucket, strategy_name, count(*) AS cases FROM collection_cases GROUP BY 1, 2) b
           LEFT JOIN (SELECT cc.dpd_bucket, cc.strategy_name, count(DISTINCT cc.case_id) AS contacted
                      FROM collection_cases cc JOIN contact_events e ON e.case_id = cc.case_id GROUP BY 1, 2) c
             ON c.dpd_bucket = b.dpd_bucket AND c.strategy_name = b.strategy_name
           LEFT JOIN (SELECT cc.dpd_bucket, cc.strategy_name, count(DISTINCT cc.case_id) AS rpc
                      FROM collection_cases cc JOIN contact_events e ON e.case_id = cc.case_id
                      WHERE e.contact_result = 'RPC' GROUP BY 1, 2) r
             ON r.dpd_bucket = b.dpd_bucket AND r.strategy_name = b.strategy_name""",
    ),
)
def left_join_metric_chain(spark, sf_dir):
    """Metrics of two keys attached to a base; contacts are folded to one flag row a case first."""
    inp = inputs(spark, sf_dir)
    keys = ["dpd_bucket", "strategy_name"]
    flags = inp.contact_events.groupBy("case_id").agg(
        F.max(F.when(F.col("contact_result") == "RPC", 1).otherwise(0)).alias("rpc_flag"))
    hits = inp.collection_cases.select("case_id", *keys).join(flags, "case_id")
    metrics = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("contacted"), F.sum("rpc_flag").alias("rpc"))
    base = inp.collection_cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"))
    return base.join(metrics, keys, "left").select(
        *keys, "cases", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("contacted", "rpc")])


@query(
    "fill_missing_constant",
    oracle=with_inputs(
        ["train"],
        "SELECT row_id, " + ", ".join(f"coalesce({c}, 'missing') AS {c}" for c in CAT_COLS)
        + ", coalesce(contacts_last_7d, 0) AS contacts_last_7d FROM train",
    ),
)
def fill_missing_constant(spark, sf_dir):
    """Categories to ``"missing"``, counts to 0."""
    train = fill_categories(inputs(spark, sf_dir).train)
    return train.fillna({"contacts_last_7d": 0}).select("row_id", *CAT_COLS, "contacts_last_7d")


@query(
    "columns_by_type",
    oracle=with_inputs(
        ["train"],
        """SELECT column_name, kind, n FROM (
             SELECT unnest(['dpd_bucket', 'region', 'product_type']) AS column_name, 'text' AS kind
             UNION ALL SELECT unnest(['outstanding_amount', 'income', 'contacts_last_7d', 'rpc_last_30d',
                                      'promises_last_30d', 'payments_amount_last_30d']), 'number') c
           JOIN (UNPIVOT (SELECT count(dpd_bucket) AS dpd_bucket, count(region) AS region, count(product_type) AS product_type,
                   count(outstanding_amount) AS outstanding_amount, count(income) AS income,
                   count(contacts_last_7d) AS contacts_last_7d, count(rpc_last_30d) AS rpc_last_30d,
                   count(promises_last_30d) AS promises_last_30d, count(payments_amount_last_30d) AS payments_amount_last_30d
                   FROM train) ON COLUMNS(*) INTO NAME column_name VALUE n) USING (column_name)""",
    ),
)
def columns_by_type(spark, sf_dir):
    """Without ids, dates and the target, the text and number columns with their non-null counts."""
    features = inputs(spark, sf_dir).train.drop("row_id", "customer_id", "snapshot_date", "target_paid_30d")
    numbers, texts = pr.split_by_dtype(features)
    counts = features.agg(*[F.count(c).alias(c) for c in features.columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.col(c).alias("n"))
            for kind, cols in (("text", texts), ("number", numbers)) for c in cols]
    return counts.select(F.inline(F.array(*rows)))


@query(
    "case_significance",
    oracle=with_inputs(
        ["collection_cases", "payments"],
        """SELECT s.strategy_name, round(s.z, 6) AS z, CASE WHEN abs(s.z) > 1.959963984540054 THEN 1 ELSE 0 END AS is_significant
           FROM (SELECT strategy_name, (avg(flag) - 0.5) / sqrt(0.25 / count(*)) AS z
                 FROM (SELECT c.strategy_name, CASE WHEN p.account_id IS NULL THEN 0.0 ELSE 1.0 END AS flag
                       FROM collection_cases c LEFT JOIN (SELECT DISTINCT account_id FROM payments) p USING (account_id))
                 GROUP BY 1) s""",
    ),
)
def case_significance(spark, sf_dir):
    """z of the share of cases whose account ever paid against one half, and whether p < 0.05."""
    inp = inputs(spark, sf_dir)
    paid = inp.payments.groupBy("account_id").agg(F.lit(1.0).alias("flag"))
    cases = inp.collection_cases.select("account_id", "strategy_name").join(paid, "account_id", "left")
    z = (F.avg(F.coalesce("flag", F.lit(0.0))) - 0.5) / F.sqrt(F.lit(0.25) / F.count(F.lit(1)))
    out = cases.groupBy("strategy_name").agg(z.alias("z")).withColumn("p", two_sided_normal_p("z"))
    return out.select("strategy_name", F.round("z", 6).alias("z"), F.when(F.col("p") < 0.05, 1).otherwise(0).alias("is_significant"))
