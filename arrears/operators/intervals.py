"""Anchor-relative day windows as equi-joins.

Each anchor (a case with its start day, a last contact, ...) needs the events of its key that fall in
``[anchor_day + first, anchor_day + last]``. Joining on the key alone and filtering the range would
enumerate every (anchor, event) pair of a key — a hot account with a third of all cases *and* a third
of all payments would then pair everything with everything in one task. Instead:

1. events are pre-aggregated per ``(key, day)`` (map-side partial aggregation, so a hot key shrinks
   to at most one row per calendar day before the shuffle), and
2. each anchor is exploded into its ``last - first + 1`` days,

so the join is an equi-join on ``(key, day)`` with at most one partner per exploded anchor row. The
output grows with ``anchors × window length`` only, whatever the skew, and the join key spreads a
hot key over its days.

Date windows (SQL side, trap T1) compare whole days. The pandas-side timestamp window
``start <= ts <= start + n days`` (start at midnight) is the same as days ``0 .. n-1`` in full plus
events at exactly midnight of day ``n``; :func:`timestamp_window_daily` keeps that split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "_day"
OFFSET = "_day_offset"


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def daily_totals(
    events: DataFrame,
    keys: str | Sequence[str],
    ts_col: str,
    aggs: Sequence[Column],
    where: Column | None = None,
) -> DataFrame:
    """Per ``(keys, day of ts_col)`` aggregates; ``where`` filters events first."""
    df = events if where is None else events.where(where)
    return df.groupBy(*[F.col(k) for k in _cols(keys)], F.to_date(ts_col).alias(DAY)).agg(*aggs)


def explode_days(anchors: DataFrame, anchor_day: Column | str, first: int, last: int) -> DataFrame:
    """One row per anchor and day of its window, with ``_day`` and ``_day_offset``."""
    day0 = F.col(anchor_day) if isinstance(anchor_day, str) else anchor_day
    return anchors.withColumn(OFFSET, F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(
        DAY, F.date_add(F.to_date(day0), F.col(OFFSET))
    )


def window_join(
    anchors: DataFrame,
    daily: DataFrame,
    keys: str | Sequence[str],
    anchor_day: Column | str,
    first: int,
    last: int,
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Anchors joined with the daily aggregates of their window (one row per matched day).

    ``daily`` must be keyed by ``keys + ['_day']`` (see :func:`daily_totals`). With ``how='left'``
    every exploded anchor-day row is kept. ``null_safe`` makes NULL keys match each other, like a
    pandas merge (trap T2).
    """
    return join_on(explode_days(anchors, anchor_day, first, last), daily, _cols(keys) + [DAY], how, null_safe)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False):
    """``left.join(right, keys, how)``; with ``null_safe`` the keys compare with ``<=>`` (still an
    equi-join for the planner) and the left side's key columns are kept."""
    if not null_safe:
        return left.join(right, on=list(keys), how=how)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def day_bounds(ts_col: str, start: str, end: str, first: int, last: int) -> Column:
    """Predicate on an event timestamp: its day is one that some anchor in ``[start, end]`` reaches.

    Anchors are filtered to a period, so events outside ``[start + first, end + last]`` can never
    match; filtering them before the daily aggregation prunes most of the event table.
    """
    lo = F.date_add(F.to_date(F.lit(start)), first)
    hi = F.date_add(F.to_date(F.lit(end)), last)
    return F.to_date(ts_col).between(lo, hi)


def window_join_rows(
    anchors: DataFrame,
    events: DataFrame,
    keys: str | Sequence[str],
    anchor_day: Column | str,
    ts_col: str,
    first: int,
    last: int,
    null_safe: bool = False,
) -> DataFrame:
    """Row-level interval join: every (anchor, event) with the event day in the anchor's window.

    Same equi-join on ``(keys, day)`` as :func:`window_join`, but against the raw events, for
    callers that need the matched rows themselves. The events of a hot key meet its anchors day by
    day. With ``null_safe`` NULL keys match each other.
    """
    ev = events.withColumn(DAY, F.to_date(ts_col))
    return join_on(explode_days(anchors, anchor_day, first, last), ev, _cols(keys) + [DAY], null_safe=null_safe).drop(DAY, OFFSET)


def timestamp_window_daily(
    events: DataFrame,
    keys: str | Sequence[str],
    ts_col: str,
    measures: dict[str, Column],
) -> DataFrame:
    """Daily aggregates plus the same aggregates restricted to events at exactly 00:00:00.

    ``measures`` maps output name → per-row value to sum (use ``F.lit(1)`` to count). The result has
    ``name`` (whole day) and ``name__midnight`` for each measure.
    """
    at_midnight = F.col(ts_col) == F.to_date(ts_col).cast("timestamp_ntz")
    aggs = []
    for name, value in measures.items():
        aggs.append(F.sum(value).alias(name))
        aggs.append(F.sum(F.when(at_midnight, value)).alias(f"{name}__midnight"))
    return daily_totals(events, keys, ts_col, aggs)


def timestamp_window_value(name: str, days: int) -> Column:
    """Value of measure ``name`` inside ``[start, start + days]`` for one exploded anchor-day row."""
    return F.when(F.col(OFFSET) < days, F.col(name)).when(F.col(OFFSET) == days, F.col(f"{name}__midnight"))
