"""Data-quality and profile queries (S4-S6, A14-A25, J8, W1) over the fixture inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.operators import profile as pr
from arrears.operators.anchors import latest_per_key
from arrears.operators.ordered import exact_quantiles
from arrears.sources.fixtures import inputs

TRAIN_START, TRAIN_END = "1997-01-01", "1997-09-30"
VAL_START, VAL_END = "1997-10-01", "1997-12-31"


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query(
    "preview_rows",
    oracle=with_inputs(
        ["collection_cases"],
        """(SELECT * FROM collection_cases ORDER BY case_id LIMIT 5)
           UNION ALL (SELECT * FROM collection_cases ORDER BY case_id DESC LIMIT 5)""",
    ),
)
def preview_rows(spark, sf_dir):
    """head(5) and tail(5) by key."""
    cc = inputs(spark, sf_dir).collection_cases
    return pr.preview_rows(cc, ["case_id"], 5).unionByName(pr.preview_rows(cc, ["case_id"], 5, tail=True))


@query(
    "profile_columns",
    oracle=with_inputs(
        ["contacts"],
        """SELECT * FROM (VALUES
             (0, 'event_id', 'bigint', (SELECT count(event_id) FROM contacts)),
             (1, 'case_id', 'bigint', (SELECT count(case_id) FROM contacts)),
             (2, 'event_dttm', 'timestamp_ntz', (SELECT count(event_dttm) FROM contacts)),
             (3, 'channel', 'string', (SELECT count(channel) FROM contacts)),
             (4, 'contact_result', 'string', (SELECT count(contact_result) FROM contacts))
           ) t(position, column_name, data_type, non_null)""",
    ),
)
def profile_columns(spark, sf_dir):
    """S5."""
    return pr.profile_columns(inputs(spark, sf_dir).contacts)


@query(
    "table_shape",
    oracle=with_inputs(["contacts"], "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM contacts"),
)
def table_shape(spark, sf_dir):
    """S6."""
    return pr.table_shape(inputs(spark, sf_dir).contacts)


@query(
    "distinct_values",
    oracle=with_inputs(
        ["collection_cases", "contact_events"],
        """SELECT DISTINCT 'strategy_name' AS attribute, strategy_name AS value FROM collection_cases
           UNION ALL SELECT DISTINCT 'dpd_bucket', dpd_bucket FROM collection_cases
           UNION ALL SELECT DISTINCT 'channel', channel FROM contact_events
           UNION ALL SELECT DISTINCT 'contact_result', contact_result FROM contact_events""",
    ),
)
def distinct_values(spark, sf_dir):
    """A14."""
    inp = inputs(spark, sf_dir)
    parts = [(inp.collection_cases, ["strategy_name", "dpd_bucket"]), (inp.contact_events, ["channel", "contact_result"])]
    # one pass per table: each row gives a (column, value) pair for every column asked for
    return _union([
        df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in cols]))).distinct()
        for df, cols in parts
    ])


@query(
    "category_counts",
    oracle=with_inputs(["contact_events"], "SELECT contact_result, count(*) AS cnt FROM contact_events GROUP BY 1"),
)
def category_counts(spark, sf_dir):
    """A15."""
    return pr.category_counts(inputs(spark, sf_dir).contact_events, "contact_result")


@query(
    "flag_value_counts",
    oracle=with_inputs(
        ["sms_ab_test"],
        """SELECT v.value,
                  nullif((SELECT count(*) FROM sms_ab_test WHERE CAST(delivered_flg AS VARCHAR) = v.value), 0)
                      AS delivered_flg,
                  nullif((SELECT count(*) FROM sms_ab_test WHERE CAST(paid_7d_flg AS VARCHAR) = v.value), 0)
                      AS paid_7d_flg
           FROM (SELECT CAST(delivered_flg AS VARCHAR) AS value FROM sms_ab_test
                 UNION SELECT CAST(paid_7d_flg AS VARCHAR) FROM sms_ab_test) v""",
    ),
)
def flag_value_counts(spark, sf_dir):
    """A16."""
    return pr.flag_value_counts(inputs(spark, sf_dir).sms_ab_test, ["delivered_flg", "paid_7d_flg"])


def _within(at, lo, hi):
    return at.between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))


def _splits(at):
    """The splits a row of this time belongs to: all rows, the train and the validation period."""
    return F.array_compact(F.array(F.lit("all"), F.when(_within(at, TRAIN_START, TRAIN_END), F.lit("train")),
                                   F.when(_within(at, VAL_START, VAL_END), F.lit("validation"))))


_SPLITS_SQL = f"""
    splits AS (
        SELECT 'all' AS split, * FROM train
        UNION ALL SELECT 'train', * FROM train
            WHERE snapshot_date BETWEEN TIMESTAMP '{TRAIN_START}' AND TIMESTAMP '{TRAIN_END}'
        UNION ALL SELECT 'validation', * FROM train
            WHERE snapshot_date BETWEEN TIMESTAMP '{VAL_START}' AND TIMESTAMP '{VAL_END}')"""


@query(
    "target_distribution",
    oracle=with_inputs(
        ["train"],
        """SELECT split, target_paid_30d AS target, count(*) AS cnt,
                  round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
           FROM splits GROUP BY split, target_paid_30d""",
        _SPLITS_SQL,
    ),
)
def target_distribution(spark, sf_dir):
    """Class counts and shares for all rows, the train and the validation period."""
    train = inputs(spark, sf_dir).train
    counts = train.select(F.explode(_splits(F.col("snapshot_date"))).alias("split"), F.col("target_paid_30d").alias("target")) \
        .groupBy("split", "target").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("split"))  # a few classes per split
    return counts.withColumn("share", F.round(F.col("cnt") / total, 6))


@query(
    "date_ranges",
    oracle=with_inputs(
        ["collection_cases", "contact_events", "payments"],
        """SELECT 'start_date' AS column_name, CAST(min(start_date) AS VARCHAR) AS min_value,
                  CAST(max(start_date) AS VARCHAR) AS max_value FROM collection_cases
           UNION ALL SELECT 'event_dttm', CAST(min(event_dttm) AS VARCHAR), CAST(max(event_dttm) AS VARCHAR)
           FROM contact_events
           UNION ALL SELECT 'payment_dttm', CAST(min(payment_dttm) AS VARCHAR), CAST(max(payment_dttm) AS VARCHAR)
           FROM payments""",
    ),
)
def date_ranges(spark, sf_dir):
    """A18."""
    inp = inputs(spark, sf_dir)
    return _union([
        pr.ranges(inp.collection_cases, ["start_date"]),
        pr.ranges(inp.contact_events, ["event_dttm"]),
        pr.ranges(inp.payments, ["payment_dttm"]),
    ])


@query(
    "amount_range",
    oracle=with_inputs(
        ["payments"],
        "SELECT CAST(min(payment_amount) AS DOUBLE) AS min_amount, CAST(max(payment_amount) AS DOUBLE) AS max_amount "
        "FROM payments",
    ),
)
def amount_range(spark, sf_dir):
    """A19."""
    p = inputs(spark, sf_dir).payments
    return p.agg(F.min("payment_amount").cast("double").alias("min_amount"),
                 F.max("payment_amount").cast("double").alias("max_amount"))


@query(
    "duplicate_keys",
    oracle=with_inputs(
        ["collection_cases", "accounts", "contact_events"],
        """SELECT 'collection_cases.case_id' AS key_name, case_id AS key_value, count(*) AS cnt
           FROM collection_cases GROUP BY case_id HAVING count(*) > 1
           UNION ALL SELECT 'accounts.account_id', account_id, count(*) FROM accounts
           GROUP BY account_id HAVING count(*) > 1
           UNION ALL SELECT 'contact_events.event_id', event_id, count(*) FROM contact_events
           GROUP BY event_id HAVING count(*) > 1""",
    ),
)
def duplicate_keys(spark, sf_dir):
    """A20 (plus the event ids that the pandas side de-duplicates)."""
    inp = inputs(spark, sf_dir)
    parts = [(inp.collection_cases, "collection_cases", "case_id"), (inp.accounts, "accounts", "account_id"),
             (inp.contact_events, "contact_events", "event_id")]
    return _union([
        pr.duplicate_keys(df, k).select(F.lit(f"{t}.{k}").alias("key_name"), F.col(k).alias("key_value"), "cnt")
        for df, t, k in parts
    ])


@query(
    "distinct_vs_rows",
    oracle=with_inputs(["contacts"], "SELECT count(DISTINCT event_id) AS n_unique, count(*) AS n_rows FROM contacts"),
)
def distinct_vs_rows(spark, sf_dir):
    """A21."""
    return pr.distinct_vs_rows(inputs(spark, sf_dir).contacts, "event_id")


_TRAIN_COLS = ["customer_id", "snapshot_date", "dpd_bucket", "outstanding_amount", "income", "region",
               "product_type", "contacts_last_7d", "rpc_last_30d", "promises_last_30d",
               "payments_amount_last_30d", "target_paid_30d"]


@query(
    "nunique_per_column",
    oracle=with_inputs(
        ["train"],
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM train" for c in _TRAIN_COLS),
    ),
)
def nunique_per_column(spark, sf_dir):
    """A22 (on the modelling table, without the added row_id)."""
    return pr.nunique_per_column(inputs(spark, sf_dir).train.select(*_TRAIN_COLS))


@query(
    "describe_numeric",
    oracle=with_inputs(
        ["payments"],
        """SELECT count(a) AS cnt, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS std, min(a) AS min,
                  round(quantile_cont(a, 0.25), 6) AS q25, round(quantile_cont(a, 0.5), 6) AS q50,
                  round(quantile_cont(a, 0.75), 6) AS q75, max(a) AS max
           FROM (SELECT CAST(payment_amount AS DOUBLE) AS a FROM payments WHERE payment_amount > 0)""",
    ),
)
def describe_numeric(spark, sf_dir):
    """``describe()`` of the positive payment amounts; quartiles exact (linear interpolation)."""
    a = inputs(spark, sf_dir).payments.where(F.col("payment_amount") > 0).select(
        F.col("payment_amount").cast("double").alias("a")
    )
    stats = a.agg(
        F.count("a").alias("cnt"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_samp("a"), 6).alias("std"),
        F.min("a").alias("min"), F.max("a").alias("max"),
    )
    q = exact_quantiles(a, "a", [0.25, 0.5, 0.75])
    qs = q.agg(F.struct(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                          for p, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]])).scalar()
    quartiles = [F.round(qs[n], 6).alias(n) for n in ("q25", "q50", "q75")]
    return stats.select("cnt", "mean", "std", "min", *quartiles, "max")


@query(
    "missing_table",
    oracle=with_inputs(
        ["train"],
        "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_share FROM train"
            for c in _TRAIN_COLS) + ") WHERE missing > 0",
    ),
)
def missing_table(spark, sf_dir):
    """A24."""
    return pr.missing_table(inputs(spark, sf_dir).train.select(*_TRAIN_COLS))


_NUM_COLS = ["income", "outstanding_amount", "contacts_last_7d", "rpc_last_30d", "promises_last_30d",
             "payments_amount_last_30d"]


@query(
    "column_medians",
    oracle=with_inputs(
        ["train"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM train "
            f"WHERE snapshot_date BETWEEN TIMESTAMP '{TRAIN_START}' AND TIMESTAMP '{TRAIN_END}'"
            for c in _NUM_COLS
        ),
    ),
)
def column_medians(spark, sf_dir):
    """Exact medians of the numeric features on the train period (long format, one pass)."""
    tr = inputs(spark, sf_dir).train.where(_within(F.col("snapshot_date"), TRAIN_START, TRAIN_END))
    long = tr.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in _NUM_COLS
    ])).alias("kv")).select("kv.column_name", "kv.v")
    med = exact_quantiles(long, "v", [0.5], by=["column_name"])
    return med.select("column_name", F.round("value", 6).alias("median"))


@query(
    "orphan_counts",
    oracle=with_inputs(
        ["collection_cases", "accounts", "payments", "contact_events"],
        """SELECT (SELECT count(*) FROM collection_cases c LEFT JOIN accounts a ON c.account_id = a.account_id
                   WHERE a.account_id IS NULL) AS orphan_cases,
                  (SELECT count(*) FROM payments p LEFT JOIN accounts a ON p.account_id = a.account_id
                   WHERE a.account_id IS NULL) AS orphan_payments,
                  (SELECT count(*) FROM contact_events e LEFT JOIN collection_cases c ON e.case_id = c.case_id
                   WHERE c.case_id IS NULL) AS orphan_contacts""",
    ),
)
def orphan_counts(spark, sf_dir):
    """The three anti-join checks as one row."""
    inp = inputs(spark, sf_dir)
    a = pr.orphan_count(inp.collection_cases, inp.accounts, "account_id").withColumnRenamed("orphans", "orphan_cases")
    b = pr.orphan_count(inp.payments, inp.accounts, "account_id").withColumnRenamed("orphans", "orphan_payments")
    c = pr.orphan_count(inp.contact_events, inp.collection_cases, "case_id").withColumnRenamed("orphans", "orphan_contacts")
    return a.select("orphan_cases", b.scalar().alias("orphan_payments"), c.scalar().alias("orphan_contacts"))


@query(
    "dedupe_keep_latest",
    oracle=with_inputs(
        ["contacts"],
        """SELECT event_id, case_id, event_dttm, channel, contact_result FROM (
             SELECT *, row_number() OVER (PARTITION BY event_id
                        ORDER BY event_dttm DESC NULLS LAST, case_id DESC, channel DESC, contact_result DESC) AS rn
             FROM contacts) WHERE rn = 1""",
    ),
)
def dedupe_keep_latest(spark, sf_dir):
    """One row per event_id, the latest event time."""
    return latest_per_key(inputs(spark, sf_dir).contacts, "event_id", "event_dttm", ["case_id", "channel", "contact_result"])
