"""Strategy effectiveness in the first days of a case (C1) and its building blocks.

SQL-side semantics: windows compare whole days (``event::date BETWEEN start AND start + days-1``),
payments hang on the account (one payment counts for every case of the account whose window covers
it), and only positive payments count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.functions import ratio
from arrears.operators.intervals import DAY, day_bounds, daily_totals, explode_days, window_join, window_join_rows


def in_period(day: str, start: str, end: str) -> Column:
    """Predicate ``day BETWEEN start AND end`` (inclusive)."""
    return F.col(day).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))


def cases_in_period(cases: DataFrame, start: str, end: str) -> DataFrame:
    """Cases with ``start_date BETWEEN start AND end`` (inclusive)."""
    return cases.where(in_period("start_date", start, end))


def cases_by_strategy(cases: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A1: ``count(*)`` per strategy, optionally within a period."""
    df = cases if start is None else cases_in_period(cases, start, end)
    return df.groupBy("strategy_name").agg(F.count(F.lit(1)).alias("total_cases"))


def contact_days(contacts: DataFrame, start: str, end: str, last: int, where=None) -> DataFrame:
    """Distinct ``(case_id, day)`` with a contact, for cases starting in ``[start, end]``."""
    cond = day_bounds("event_dttm", start, end, 0, last)
    if where is not None:
        cond = cond & where
    return daily_totals(contacts, "case_id", "event_dttm", [F.count(F.lit(1)).alias("contacts")], where=cond)


def payment_days(payments: DataFrame, start: str, end: str, last: int) -> DataFrame:
    """Positive payments per ``(account_id, day)`` for windows of cases starting in ``[start, end]``."""
    cond = (F.col("payment_amount") > 0) & day_bounds("payment_dttm", start, end, 0, last)
    return daily_totals(
        payments,
        "account_id",
        "payment_dttm",
        [F.sum("payment_amount").alias("amount"), F.count(F.lit(1)).alias("payments")],
        where=cond,
    )


def contacts_in_window(cases: DataFrame, contacts: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """(case, contact) rows with the contact day in ``[start_date, start_date + days-1]``."""
    cp = cases_in_period(cases, start, end).select("case_id", "strategy_name", "start_date")
    ev = contacts.where(day_bounds("event_dttm", start, end, 0, days - 1)).select(
        "case_id", "event_id", "event_dttm", "channel", "contact_result"
    )
    return window_join_rows(cp, ev, "case_id", "start_date", "event_dttm", 0, days - 1)


def contacts_in_window_left(cases: DataFrame, contacts: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Every case of the period, with its in-window contacts or NULLs when it has none."""
    cp = cases_in_period(cases, start, end).select("case_id", "strategy_name", "start_date")
    ev = contacts.where(day_bounds("event_dttm", start, end, 0, days - 1)).select(
        F.col("case_id").alias("_case"), "event_id", "event_dttm", "channel", "contact_result"
    )
    day = F.to_date("event_dttm")
    in_window = (F.col("case_id") == F.col("_case")) & (day >= F.col("start_date")) & (
        day <= F.date_add("start_date", days - 1))
    return cp.join(ev, in_window, "left").drop("_case")


def payments_in_window(cases: DataFrame, payments: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """(case, positive payment) rows with the payment day in the case's window."""
    cp = cases_in_period(cases, start, end).select("case_id", "account_id", "strategy_name", "start_date")
    pay = payments.where(
        (F.col("payment_amount") > 0) & day_bounds("payment_dttm", start, end, 0, days - 1)
    ).select("account_id", "payment_id", "payment_dttm", "payment_amount")
    return window_join_rows(cp, pay, "account_id", "start_date", "payment_dttm", 0, days - 1)


def contacted_by_strategy(cases: DataFrame, contacts: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Distinct cases with a contact in their window, per strategy (A3 by group)."""
    cp = cases_in_period(cases, start, end).select("case_id", "strategy_name", "start_date")
    hits = window_join(cp, contact_days(contacts, start, end, days - 1), "case_id", "start_date", 0, days - 1)
    return hits.groupBy("strategy_name").agg(F.countDistinct("case_id").alias(f"contacted_cases_{days}d"))


def payment_day_hits(cases: DataFrame, payments: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """(case, day) rows with the day's positive payments of the case's account inside its window."""
    cp = cases_in_period(cases, start, end).select("case_id", "account_id", "strategy_name", "start_date")
    return window_join(cp, payment_days(payments, start, end, days - 1), "account_id", "start_date", 0, days - 1)


def paid_by_strategy(cases: DataFrame, payments: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Distinct paying cases and collected amount per strategy."""
    hits = payment_day_hits(cases, payments, start, end, days)
    return hits.groupBy("strategy_name").agg(
        F.countDistinct("case_id").alias(f"paid_cases_{days}d"),
        F.sum("amount").alias(f"collected_amount_{days}d"),
    )


def principal_by_strategy(cases: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """J1 + A1: cases joined (inner) with their account, count and principal per strategy."""
    cp = cases_in_period(cases, start, end).select("account_id", "strategy_name")
    acc = accounts.select("account_id", "principal_amount")
    return (
        cp.join(acc, "account_id")
        .groupBy("strategy_name")
        .agg(F.count(F.lit(1)).alias("total_cases"), F.sum("principal_amount").alias("total_principal_amount"))
    )


def strategy_effectiveness(
    cases: DataFrame,
    accounts: DataFrame,
    contacts: DataFrame,
    payments: DataFrame,
    start: str,
    end: str,
    days: int = 7,
) -> DataFrame:
    """Per strategy — cases, contacted / paid cases and collected amount in the first ``days``
    days, average per paid case and collection rate (collected / principal, each aggregated first so
    that payments do not multiply principal).

    Cases without an account drop out of ``total_cases`` but still count as contacted or paid
    (trap T19); a strategy without contacts or payments keeps NULL metrics.

    Contacts and payments come from one pass: the period's cases are exploded once into their
    window days and left-joined with the daily contact counts (by case) and the daily payment
    totals (by account); distinct cases are counted per (strategy, case) first, then per strategy.
    """
    last = days - 1
    cp = cases_in_period(cases, start, end).select("case_id", "account_id", "strategy_name", "start_date")
    c_daily = contact_days(contacts, start, end, last).select("case_id", DAY, "contacts")
    p_daily = payment_days(payments, start, end, last)
    rows = explode_days(cp, "start_date", 0, last).join(c_daily, ["case_id", DAY], "left").join(
        p_daily, ["account_id", DAY], "left"
    )
    per_case = rows.groupBy("strategy_name", "case_id").agg(
        F.max(F.col("contacts").isNotNull()).alias("_contacted"),
        F.max(F.col("payments").isNotNull()).alias("_paid"),
        F.sum("amount").alias("_amount"),
    )
    suffix = f"{days}d"
    per_strategy = per_case.groupBy("strategy_name").agg(
        F.nullif(F.count_if("_contacted"), F.lit(0)).alias(f"contacted_cases_{suffix}"),
        F.nullif(F.count_if("_paid"), F.lit(0)).alias(f"paid_cases_{suffix}"),
        F.sum("_amount").alias(f"collected_amount_{suffix}"),
    )
    base = principal_by_strategy(cases, accounts, start, end)
    out = base.join(per_strategy, "strategy_name", "left")
    return out.select(
        "strategy_name",
        F.col("total_cases").cast("bigint").alias("total_cases"),
        F.col(f"contacted_cases_{suffix}").cast("bigint").alias(f"contacted_cases_{suffix}"),
        F.col(f"paid_cases_{suffix}").cast("bigint").alias(f"paid_cases_{suffix}"),
        F.col(f"collected_amount_{suffix}").cast("double").alias(f"collected_amount_{suffix}"),
        ratio(f"collected_amount_{suffix}", f"paid_cases_{suffix}").alias(f"avg_collected_per_paid_case_{suffix}"),
        ratio(f"collected_amount_{suffix}", "total_principal_amount").alias(f"collection_rate_{suffix}"),
    )


def fanout_biased_rate(
    cases: DataFrame, accounts: DataFrame, payments: DataFrame, start: str, end: str, days: int = 7
) -> DataFrame:
    """The labelled-wrong collection rate of the reference, kept as a data-quality contrast.

    Joining accounts and payments in one pass repeats a case's principal once per matching payment,
    so ``sum(payment) / sum(principal)`` is biased low. Same numbers as that join, computed from
    per-case aggregates: each case contributes ``n_payments × principal`` to the denominator.
    """
    hits = payment_day_hits(cases, payments, start, end, days)
    per_case = hits.groupBy("case_id", "account_id", "strategy_name").agg(
        F.sum("amount").alias("amount"), F.sum("payments").alias("n")
    )
    acc = accounts.select("account_id", "principal_amount")
    joined = per_case.join(acc, "account_id")
    return joined.groupBy("strategy_name").agg(
        ratio(F.sum("amount"), F.sum(F.col("principal_amount") * F.col("n"))).alias(f"collection_rate_{days}d")
    )
