"""Last contact per case and the payments in the days after it.

Semantics reproduced literally (traps T3, T20): only cases with a contact appear; contacts at the
same maximal time all count; detail rows that are equal in all grouped columns collapse into one
output row while their payments are counted once per collapsed row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrears.operators.anchors import extreme_time, rows_at_latest
from arrears.operators.intervals import DAY, daily_totals, explode_days, join_on, window_join
from arrears.plans.strategy import cases_in_period, in_period

DETAIL_COLS = ["case_id", "account_id", "strategy_name", "last_contact_dttm", "last_channel", "last_contact_result"]


def last_contact_time(cases: DataFrame, contacts: DataFrame, start: str, end: str) -> DataFrame:
    """``max(event_dttm)`` per case for cases starting in the period.

    The maximum is partial in each task, so a hot case is one row per task in the shuffle; it is taken
    before the cases are chosen, so no contact is dealt for that alone.
    """
    ids = cases_in_period(cases, start, end).select("case_id").distinct()
    return extreme_time(contacts, "case_id", "event_dttm", "last_contact_dttm", "max").join(ids, "case_id")


def _cases_of_period_ids(cases: DataFrame, start: str, end: str) -> DataFrame:
    """Account and strategy of every case row whose id has a row starting in the period, in one read."""
    of_id = Window.partitionBy("case_id")
    begins = F.coalesce(in_period("start_date", start, end), F.lit(False))
    return cases.withColumn("_wanted", F.max(begins).over(of_id)).where("_wanted").select(
        "case_id", "account_id", "strategy_name")


def last_contact_details(cases: DataFrame, contacts: DataFrame, start: str, end: str) -> DataFrame:
    """The full row(s) of the last contact, with the case's account and strategy.

    Contacts are read once and reduced in each task to the rows at each case's latest time, before they meet
    the period's cases.
    """
    rows = rows_at_latest(contacts.select("case_id", "event_dttm", "channel", "contact_result"), "case_id", "event_dttm")
    return rows.join(_cases_of_period_ids(cases, start, end), "case_id").select(
        "case_id",
        "account_id",
        "strategy_name",
        F.col("event_dttm").alias("last_contact_dttm"),
        F.col("channel").alias("last_channel"),
        F.col("contact_result").alias("last_contact_result"),
    )


def positive_payment_days(payments: DataFrame) -> DataFrame:
    """Positive payments per ``(account_id, day)``: amount and count."""
    return daily_totals(
        payments,
        "account_id",
        "payment_dttm",
        [F.sum("payment_amount").alias("amount"), F.count(F.lit(1)).alias("payments")],
        where=F.col("payment_amount") > 0,
    )


def _contact_day() -> Column:
    return F.to_date("last_contact_dttm")


def _detail_groups(cases: DataFrame, contacts: DataFrame, start: str, end: str) -> DataFrame:
    """The distinct last-contact details with the number of rows each has (``_copies``).

    They are used three times: for the days that bound the payments, for the distinct (account, contact
    day) keys and for the result. Every use reads all their columns, the number of copies included, so
    Spark runs them once and reuses the exchange: contacts are read and ranked once. The exchange is asked
    for, as the details may be dealt by the case already; equal rows are folded before it. Their joins
    compare keys null-safe against payments that have an account: a filter on keys that one use needs would
    be pushed below the exchange.
    """
    folded = last_contact_details(cases, contacts, start, end).groupBy(*DETAIL_COLS).agg(F.count(F.lit(1)).alias("_n"))
    return folded.repartition(*DETAIL_COLS).groupBy(*DETAIL_COLS).agg(F.sum("_n").alias("_copies"))


def _reachable_payments(payments: DataFrame, groups: DataFrame, days: int) -> DataFrame:
    """Payments of an account on the days some contact reaches; others can't match and are not dealt."""
    span = groups.agg(
        F.struct(F.min(_contact_day()).alias("lo"), F.max(_contact_day()).alias("hi"), F.sum("_copies").alias("rows"))
    ).scalar()
    reached = F.to_date("payment_dttm").between(span["lo"], F.date_add(span["hi"], days - 1))
    return payments.where(F.col("account_id").isNotNull() & reached)


def _contact_days(groups: DataFrame) -> DataFrame:
    """The distinct (account, contact day) of the details."""
    keys = groups.groupBy("account_id", _contact_day().alias("_anchor_day")).agg(F.sum("_copies").alias("_rows"))
    return keys.where(F.col("_rows") > 0)


def last_contact_payments(
    cases: DataFrame, contacts: DataFrame, payments: DataFrame, start: str, end: str, days: int = 5
) -> DataFrame:
    """One row per distinct last-contact detail with ``payment_in_{days}d_flag`` and
    ``payment_amount_{days}d`` (payments from the contact day to ``days-1`` days after it)."""
    groups = _detail_groups(cases, contacts, start, end)
    daily = positive_payment_days(_reachable_payments(payments, groups, days))
    hits = window_join(_contact_days(groups), daily, "account_id", "_anchor_day", 0, days - 1, null_safe=True)
    after = hits.groupBy("account_id", "_anchor_day").agg(
        F.sum("amount").alias("amount"), F.sum("payments").alias("payments")
    )
    joined = join_on(groups.withColumn("_anchor_day", _contact_day()), after, ["account_id", "_anchor_day"], "left", null_safe=True)
    return joined.select(
        *DETAIL_COLS,
        F.when(F.coalesce(F.col("payments"), F.lit(0)) > 0, 1).otherwise(0).alias(f"payment_in_{days}d_flag"),
        (F.col("amount") * F.col("_copies")).cast("double").alias(f"payment_amount_{days}d"),
    )


def payments_after_last_contact_rows(
    cases: DataFrame, contacts: DataFrame, payments: DataFrame, start: str, end: str, days: int = 5
) -> DataFrame:
    """J6 (rows): each last-contact detail row with every positive payment of its account in the
    ``days`` days from the contact day, or NULL payment columns when there is none."""
    groups = _detail_groups(cases, contacts, start, end)
    pay = _reachable_payments(payments, groups, days).where(F.col("payment_amount") > 0).select(
        "account_id", "payment_id", "payment_dttm", "payment_amount", F.to_date("payment_dttm").alias(DAY)
    )
    days_asked = explode_days(_contact_days(groups), "_anchor_day", 0, days - 1)
    matches = join_on(days_asked, pay, ["account_id", DAY], null_safe=True).select(
        "account_id", "_anchor_day", "payment_id", "payment_dttm", "payment_amount")
    copies = join_on(groups.withColumn("_anchor_day", _contact_day()), matches, ["account_id", "_anchor_day"], "left", null_safe=True)
    rows = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return rows.select("account_id", *(c for c in DETAIL_COLS if c != "account_id"), "payment_id", "payment_dttm", "payment_amount")
