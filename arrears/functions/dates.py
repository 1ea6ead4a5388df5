"""Date and timestamp helpers (F1-F3, F6-F8). Everything is TIMESTAMP_NTZ / DATE: no zone shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_of(ts: Column | str) -> Column:
    """``ts::date`` (F1)."""
    return F.to_date(_c(ts))


def plus_days(d: Column | str, n: int | Column) -> Column:
    """``date + n`` (F2): a DATE ``n`` days later."""
    return F.date_add(_c(d), F.lit(n) if isinstance(n, int) else n)


def shift_days(ts: Column | str, n: int | Column) -> Column:
    """``ts + Timedelta(days=n)`` (F8): the same time of day ``n`` days later (negative: earlier)."""
    return _c(ts) + F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def days_ago(ts: Column | str, n: int) -> Column:
    """``ts - Timedelta(days=n)`` (F8)."""
    return shift_days(ts, -n)


def week_start(d: Column | str) -> Column:
    """``date_trunc('week', d)`` as a DATE; weeks start on Monday (F3, trap T10)."""
    return F.date_trunc("week", _c(d)).cast("date")


def floor_days_between(later: str, earlier: str) -> Column:
    """pandas ``(later - earlier).dt.days`` for two timestamp columns (by name): whole days,
    floored (23 h → 0; trap T8). ``datediff`` would count calendar days instead."""
    seconds = F.expr(f"timestampdiff(SECOND, `{earlier}`, `{later}`)")
    return F.floor(seconds / F.lit(86400)).cast("bigint")
