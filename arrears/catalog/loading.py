"""Files, views and the preprocessed frames of the bucket summary.

The CSV entries write an input to the session's shared folder and read it back, as a user's files would be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.catalog.strategy import C1_END, C1_START
from arrears.oracle_fixtures import with_inputs
from arrears.plans import bucket_summary as bs
from arrears.plans import strategy as st
from arrears.sources import files
from arrears.sources.fixtures import inputs


def _as_csv(spark, df, name):
    path = files.shared_folder(spark, name)
    files.write_csv(df, path)
    return path


@query("scan_typed_csv", oracle=with_inputs(["contact_events"], "SELECT * FROM contact_events"))
def scan_typed_csv(spark, sf_dir):
    """Header CSV in the declared schema (dates, timestamps, decimals, NULLs)."""
    path = _as_csv(spark, inputs(spark, sf_dir).contact_events, "contact_events")
    return files.scan_typed_csv(spark, path, "contact_events")


# payments as a dirty export: some amounts and some times are not of their type
_DIRTY = """
    dirty AS (
        SELECT payment_id, account_id,
               CASE WHEN payment_id % 89 = 0 THEN 'soon' ELSE strftime(payment_dttm, '%Y-%m-%d %H:%M:%S') END AS payment_dttm,
               CASE WHEN payment_id % 97 = 0 THEN 'n/a' ELSE CAST(payment_amount AS VARCHAR) END AS payment_amount
        FROM payments)"""


def _dirty_csv(spark, sf_dir):
    dirty = inputs(spark, sf_dir).payments.select(
        "payment_id", "account_id",
        F.when(F.col("payment_id") % 89 == 0, "soon").otherwise(F.date_format("payment_dttm", "yyyy-MM-dd HH:mm:ss"))
        .alias("payment_dttm"),
        F.when(F.col("payment_id") % 97 == 0, "n/a").otherwise(F.col("payment_amount").cast("string")).alias("payment_amount"),
    )
    return _as_csv(spark, dirty, "dirty_payments")


@query(
    "csv_accepted_rows",
    oracle=with_inputs(["payments"], "SELECT * FROM payments WHERE payment_id % 89 <> 0 AND payment_id % 97 <> 0"),
)
def csv_accepted_rows(spark, sf_dir):
    """S1 on a dirty file: the rows that fit the declared schema."""
    accepted, _ = files.scan_csv_with_rejects(spark, _dirty_csv(spark, sf_dir), "payments")
    return accepted


@query(
    "csv_rejected_rows",
    oracle=with_inputs(
        ["payments"],
        """SELECT payment_id, payment_id || ',' || account_id || ',' || payment_dttm || ',' || payment_amount AS record
           FROM dirty WHERE payment_id % 89 = 0 OR payment_id % 97 = 0""",
        _DIRTY,
    ),
)
def csv_rejected_rows(spark, sf_dir):
    """S1 on a dirty file: the lines that do not fit, as they stand there."""
    _, rejected = files.scan_csv_with_rejects(spark, _dirty_csv(spark, sf_dir), "payments")
    return rejected.select("payment_id", "record")


@query("scan_inferred_csv", oracle=with_inputs(["contacts"], "SELECT * FROM contacts"))
def scan_inferred_csv(spark, sf_dir):
    """Header CSV with inferred types and one parsed datetime column."""
    path = _as_csv(spark, inputs(spark, sf_dir).contacts, "contacts")
    return files.scan_inferred_csv(spark, path, ["event_dttm"])


@query(
    "parse_datetime",
    oracle=with_inputs(
        ["cases", "payments"],
        """SELECT 'start_date' AS column_name, case_id AS id, start_date AS value FROM cases
           UNION ALL SELECT 'payment_dttm', payment_id, payment_dttm FROM payments""",
    ),
)
def parse_datetime(spark, sf_dir):
    """datetime text of two files (dates of the cases, times of the payments) as TIMESTAMP_NTZ."""
    inp = inputs(spark, sf_dir)
    cases = inp.cases.select("case_id", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"))
    cases = files.scan_inferred_csv(spark, _as_csv(spark, cases, "case_dates"), ["start_date"])
    times = files.scan_inferred_csv(spark, _as_csv(spark, inp.payments, "payment_times"), ["payment_dttm"])
    return cases.select(F.lit("start_date").alias("column_name"), F.col("case_id").alias("id"), F.col("start_date").alias("value")) \
        .unionAll(times.select(F.lit("payment_dttm"), "payment_id", "payment_dttm"))


@query(
    "view_scan",
    oracle=with_inputs(
        ["collection_cases"],
        f"""SELECT strategy_name, dpd_bucket, count(*) AS cases, min(start_date) AS first_start FROM collection_cases
            WHERE start_date BETWEEN DATE '{C1_START}' AND DATE '{C1_END}' GROUP BY ALL""",
    ),
)
def view_scan(spark, sf_dir):
    """A mart published as a view and read back by name, in SQL."""
    cases = st.cases_in_period(inputs(spark, sf_dir).collection_cases, C1_START, C1_END)
    files.publish_view(cases, "arrears_period_cases")
    return spark.sql(
        "SELECT strategy_name, dpd_bucket, count(*) AS cases, min(start_date) AS first_start "
        "FROM arrears_period_cases GROUP BY ALL")


_PRE_IN = ["cases", "contacts", "payments"]


@query("preprocessed_cases", oracle=with_inputs(_PRE_IN, "SELECT * FROM cases"))
def preprocessed_cases(spark, sf_dir):
    """The cases with their start as a timestamp."""
    inp = inputs(spark, sf_dir)
    return bs.preprocess(inp.cases, inp.contacts, inp.payments)[0]


@query(
    "preprocessed_contacts",
    oracle=with_inputs(
        _PRE_IN,
        """SELECT event_id, case_id, event_dttm, channel, contact_result FROM (
             SELECT *, row_number() OVER (PARTITION BY event_id
                        ORDER BY event_dttm DESC NULLS LAST, case_id DESC, channel DESC, contact_result DESC) AS rn
             FROM contacts) WHERE rn = 1""",
    ),
)
def preprocessed_contacts(spark, sf_dir):
    """One contact per event id."""
    inp = inputs(spark, sf_dir)
    return bs.preprocess(inp.cases, inp.contacts, inp.payments)[1]


@query("preprocessed_payments", oracle=with_inputs(_PRE_IN, "SELECT * FROM payments WHERE payment_amount > 0"))
def preprocessed_payments(spark, sf_dir):
    """The positive payments."""
    inp = inputs(spark, sf_dir)
    return bs.preprocess(inp.cases, inp.contacts, inp.payments)[2]
