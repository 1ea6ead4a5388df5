"""Collection summary per overdue bucket.

pandas-side semantics (trap T1): the window is ``start <= ts <= start + days`` on timestamps with
``start`` at midnight — days ``0 .. days-1`` in full plus events at exactly 00:00:00 of day ``days``.
Contacts are first de-duplicated by ``event_id`` (latest time wins, T7), payments keep ``> 0``.
Missing metrics become 0 (T19), the average maps division by zero to 0, and buckets outside the
known four become NULL and sort last (T6).
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.functions import BUCKET_ORDER, bucket_rank, ratio_or_zero
from arrears.operators.anchors import latest_per_key
from arrears.operators.intervals import DAY, explode_days, join_on, timestamp_window_daily, timestamp_window_value, window_join_rows
from arrears.session import ensure_checkpoint_dir


def preprocess(cases: DataFrame, contacts: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed inputs, one contact per event_id (latest), positive payments only."""
    cases = cases.withColumn("start_date", F.col("start_date").cast("timestamp_ntz"))
    contacts = latest_per_key(contacts, "event_id", "event_dttm", [c for c in contacts.columns if c not in ("event_id", "event_dttm")])
    payments = payments.where(F.col("payment_amount") > 0)
    return cases, contacts, payments


def window_filter(df: DataFrame, event_col: str, start_col: str, days: int = 6) -> DataFrame:
    """P7 (row level): keep ``start <= event <= start + days`` (timestamps)."""
    start = F.col(start_col)
    return df.where((F.col(event_col) >= start) & (F.col(event_col) <= start + F.make_dt_interval(F.lit(days))))


def contacts_in_window(cases: DataFrame, contacts: DataFrame, days: int = 6) -> DataFrame:
    """J5 + P7: contacts with their case's ``start_date`` and ``dpd_bucket``, those inside
    ``start <= ts <= start + days``.

    The reference merges on ``case_id`` (NULL matches NULL, trap T2) and filters. Here each case is
    exploded into its days and meets the contacts of (case, day), with the timestamps as a residual: the
    contacts of a hot case are dealt by day, and those outside the windows are never paired.
    """
    anchors = cases.select("case_id", "start_date", "dpd_bucket")
    merged = window_join_rows(anchors, contacts, "case_id", "start_date", "event_dttm", 0, days, null_safe=True)
    return window_filter(merged, "event_dttm", "start_date", days).select(*contacts.columns, "start_date", "dpd_bucket")


def contacted_pairs(cases: DataFrame, contacts: DataFrame, days: int = 6) -> DataFrame:
    """The distinct (dpd_bucket, case_id) with a contact in the window.

    Only the distinct times of a case enter the window join: copies of a contact are folded before it.
    """
    times = contacts.select("case_id", "event_dttm").distinct()
    return contacts_in_window(cases, times, days).select("dpd_bucket", "case_id").distinct()


def _contact_days(contacts: DataFrame) -> DataFrame:
    return timestamp_window_daily(contacts, "case_id", "event_dttm", {"contacts": F.lit(1)})


def _payment_days(payments: DataFrame) -> DataFrame:
    return timestamp_window_daily(
        payments, "account_id", "payment_dttm", {"amount": F.col("payment_amount"), "payments": F.lit(1)}
    )


def collection_summary(cases: DataFrame, contacts: DataFrame, payments: DataFrame, days: int = 6) -> DataFrame:
    """C4 on preprocessed inputs: per bucket total / contacted / paid cases, collected amount and
    average payment per paid case (suffix ``_7d`` as in the reference for ``days = 6``).

    One pass: each case is exploded once into the days of its window and left-joined with the
    daily contact counts (by case) and the daily payment totals (by account); the flags and amounts
    are reduced per (bucket, case) and then per bucket — two plain aggregations, no Expand for the
    three distinct counts.
    """
    summary = _summary(cases, _contact_days(contacts), _payment_days(payments), days)
    return summary.orderBy(bucket_rank("dpd_bucket").asc_nulls_last())


def _summary(cases: DataFrame, c_daily: DataFrame, p_daily: DataFrame, days: int) -> DataFrame:
    anchors = cases.select("case_id", "account_id", "dpd_bucket", "start_date").where(F.col("dpd_bucket").isNotNull())
    # pandas merges match NULL keys with each other (trap T2): null-safe keys
    rows = join_on(
        join_on(explode_days(anchors, "start_date", 0, days), c_daily, ["case_id", DAY], "left", null_safe=True),
        p_daily, ["account_id", DAY], "left", null_safe=True,
    )
    pays = timestamp_window_value("payments", days)
    per_case = rows.groupBy("dpd_bucket", "case_id").agg(
        F.max(F.coalesce(timestamp_window_value("contacts", days), F.lit(0)) > 0).alias("_contacted"),
        F.max(F.coalesce(pays, F.lit(0)) > 0).alias("_paid"),
        F.sum(F.when(pays > 0, timestamp_window_value("amount", days))).alias("_amount"),
    )
    # nunique() ignores a NULL case_id; its payments still add to the bucket's amount
    known_case = F.col("case_id").isNotNull()
    out = per_case.groupBy("dpd_bucket").agg(
        F.count_if(known_case).alias("total_cases"),
        F.count_if(F.col("_contacted") & known_case).alias("contacted_cases_7d"),
        F.count_if(F.col("_paid") & known_case).alias("paid_cases_7d"),
        F.sum("_amount").alias("collected_amount_7d"),
    )
    known = F.col("dpd_bucket").isin(*BUCKET_ORDER)
    return out.select(
        F.when(known, F.col("dpd_bucket")).alias("dpd_bucket"),
        F.col("total_cases").cast("bigint").alias("total_cases"),
        F.col("contacted_cases_7d").cast("bigint").alias("contacted_cases_7d"),
        F.col("paid_cases_7d").cast("bigint").alias("paid_cases_7d"),
        F.coalesce(F.col("collected_amount_7d").cast("double"), F.lit(0.0)).alias("collected_amount_7d"),
        ratio_or_zero("collected_amount_7d", "paid_cases_7d").alias("avg_payment_per_paid_case_7d"),
    )


def _counted(daily: DataFrame, name: str):
    """Total of a daily count; asking for every column makes it read the exchange that the summary reads."""
    return daily.agg(F.struct(*[F.sum(c).alias(c) for c in daily.columns if c == name or "__" in c or c == "amount"])).scalar()[name]


def build_collection_summary(cases: DataFrame, contacts: DataFrame, payments: DataFrame, days: int = 6) -> DataFrame:
    """Public entry — empty ``cases`` raises, empty contacts / payments only warn.

    Contacts and payments are counted in the pass that makes the summary (one row per bucket, which is
    checkpointed), so they are read once; only what that pass cannot tell is asked for apart."""
    if cases.isEmpty():
        raise ValueError("cases is empty")
    ensure_checkpoint_dir(cases.sparkSession)
    clean_cases, clean_contacts, positive = preprocess(cases, contacts, payments)
    c_daily, p_daily = _contact_days(clean_contacts), _payment_days(positive)
    counts = {"_contacts": _counted(c_daily, "contacts"), "_payments": _counted(p_daily, "payments")}
    summary = _summary(clean_cases, c_daily, p_daily, days).withColumns(counts).checkpoint(eager=True)
    seen = summary.select(*counts).first()  # no row where no case has a bucket
    if not (seen["_contacts"] if seen else not contacts.isEmpty()):
        warnings.warn("contacts is empty", stacklevel=2)
    if not (seen["_payments"] if seen else not positive.isEmpty()):
        if payments.isEmpty():
            warnings.warn("payments is empty", stacklevel=2)
        warnings.warn("no valid payments after filtering", stacklevel=2)
    return summary.drop(*counts).orderBy(bucket_rank("dpd_bucket").asc_nulls_last())
