"""Ordered aggregates without a single-task global window: running totals, global ranks, exact
quantiles and top-k fractions (K4, K5, A23, A25, M8-M10).

A window ``OVER (ORDER BY x)`` without ``PARTITION BY`` moves every row into one task. Here:

1. rows are range-partitioned on ``(by..., order...)`` — each partition holds one contiguous slice
   of the order, balanced by Spark's sampling range partitioner as long as the order key is unique
   (callers pass a unique tie-break, or pre-aggregate to distinct values first);
2. the slice number is materialised and the result is checkpointed to the reliable checkpoint
   directory, so a recomputation after a lost executor sees the same slices;
3. running totals are computed per slice (a window partitioned by the slice: bounded by slice size),
   and per-slice totals (at most ``#slices + #groups`` rows) give each slice its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrears.session import ensure_checkpoint_dir

PART = "_slice"


def _n_slices(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _order(items: Sequence[str | tuple[str, str]]) -> list[Column]:
    """Order expressions of names (ascending) and ``(name, "desc")`` pairs; NULL comes last either way."""
    pairs = [(i, "asc") if isinstance(i, str) else i for i in items]
    return [F.col(n).desc_nulls_last() if d == "desc" else F.col(n).asc_nulls_last() for n, d in pairs]


def prefix_sums(
    df: DataFrame,
    order: Sequence[str | tuple[str, str]],
    sums: Sequence[str],
    by: Sequence[str] = (),
    n_slices: int | None = None,
) -> DataFrame:
    """Add ``<s>_cum`` (inclusive running total in ``order`` within ``by``) and ``<s>_total`` (the
    group's total, from the per-slice table) for each ``s`` in ``sums``.

    ``by + order`` must identify rows uniquely (ties would make the running total order-dependent).
    """
    by, order, sums = list(by), list(order), list(sums)
    ensure_checkpoint_dir(df.sparkSession)
    order_exprs = _order(order)
    ranged = (
        df.repartitionByRange(_n_slices(df, n_slices), *[F.col(b) for b in by], *order_exprs)
        .withColumn(PART, F.spark_partition_id())
        .checkpoint(eager=True)
    )
    w_local = (
        Window.partitionBy(*by, PART).orderBy(*order_exprs).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *[F.sum(s).over(w_local).alias(f"{s}_local") for s in sums])
    totals = ranged.groupBy(*by, PART).agg(*[F.sum(s).alias(f"{s}_slice") for s in sums])
    w_prev = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    w_group = Window.partitionBy(*by)
    offsets = totals.select(
        *by, PART,
        *[F.coalesce(F.sum(f"{s}_slice").over(w_prev), F.lit(0)).alias(f"{s}_offset") for s in sums],
        *[F.sum(f"{s}_slice").over(w_group).alias(f"{s}_total") for s in sums],
    )
    # at most #slices + #groups rows; the running totals above are already partitioned by these
    # keys, so a shuffled join moves only the offsets, and AQE broadcasts them where they are small
    out = join_null_safe(local, offsets, [*by, PART])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"{s}_local") + F.col(f"{s}_offset")).alias(f"{s}_cum") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (group keys may be NULL); keeps left's keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def global_rank(
    df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "rank", n_slices: int | None = None
) -> DataFrame:
    """1-based row number in ``order`` (within ``by``), computed without a single-task window.

    ``order`` items are column names (ascending) or ``(name, 'desc')`` pairs, NULL last; the order
    must be a total order (include a unique tie-break column).
    """
    ranked = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], by=by, n_slices=n_slices)
    return ranked.withColumnRenamed("_one_cum", out).withColumnRenamed("_one_total", f"{out}_of").drop("_one")


def _per_group(df: DataFrame, table: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a table of one row per group (NULL where a group has none)."""
    if by:
        return join_null_safe(df, table.select(*by, *cols), by, "left")
    row = table.agg(F.first(F.struct(*cols))).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in cols])


def fraction_cut(counted: DataFrame, score: str, fraction: float, by: Sequence[str]) -> DataFrame:
    """Where the first ``floor(n * fraction)`` rows by score end, from :func:`prefix_sums` over counts
    ``_c`` per (by, score): one row (by, _cut, _need, _of) per group that selects any row. ``_need``
    of the ``_of`` rows of score ``_cut`` are selected."""
    k = F.floor(F.col("_c_total").cast("double") * F.lit(float(fraction)))
    before = F.col("_c_cum") - F.col("_c")
    return counted.where((before < k) & (F.col("_c_cum") >= k)).select(
        *by, F.col(score).alias("_cut"), (k - before).alias("_need"), F.col("_c").alias("_of"), F.lit(True).alias("_any"))


def top_fraction(
    df: DataFrame,
    score: str,
    tie_break: str,
    fraction: float,
    by: Sequence[str] = (),
    n_slices: int | None = None,
) -> DataFrame:
    """K4: the first ``floor(n * fraction)`` rows by ``score`` descending, NULL last (ties by
    ``tie_break`` ascending), per ``by`` group; ``n`` counts the group's rows (trap T16: the product
    is taken in double precision, like ``int(len(df) * 0.3)``).

    Only counts per distinct score are ordered; among the rows of the score at the cut, only their
    tie-break values. The rows themselves are filtered where they are. Without groups the cut is one row,
    which the driver reads: tie-break values are ordered only if the cut goes through a score, and
    the filter is a plain comparison that reaches the scan.
    """
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    cut = fraction_cut(prefix_sums(counts, [(score, "desc")], ["_c"], by=by, n_slices=n_slices), score, fraction, by)
    if not by:
        row = cut.first()
        return df.where(_above_cut(df, score, tie_break, row, n_slices) if row else F.lit(False))
    at_cut = F.col("_any") & F.col(score).eqNullSafe(F.col("_cut"))
    marked = _per_group(df, cut, by, ["_cut", "_need", "_of", "_any"])
    ties = marked.where(at_cut & (F.col("_need") < F.col("_of"))).select(*by, tie_break, "_need")
    ranked = global_rank(ties, [tie_break], by=by, out="_rank", n_slices=n_slices)
    last = ranked.where(F.col("_rank") == F.col("_need")).select(*by, F.col(tie_break).alias("_last"))
    marked = _per_group(marked, last, by, ["_last"])
    above = F.when(F.col("_cut").isNull(), F.col(score).isNotNull()).otherwise(F.col(score) > F.col("_cut"))
    whole = F.col("_need") == F.col("_of")
    keep = F.col("_any") & (F.coalesce(above, F.lit(False)) | at_cut & (whole | (F.col(tie_break) <= F.col("_last"))))
    return marked.where(keep).select(*df.columns)


def _above_cut(df: DataFrame, score: str, tie_break: str, cut, n_slices: int | None) -> Column:
    """The rows selected by one cut row of :func:`fraction_cut`, as a condition on score and tie-break."""
    def value(name: str, v) -> Column:
        return F.lit(v).cast(df.schema[name].dataType)

    at = F.col(score).eqNullSafe(value(score, cut["_cut"]))
    if cut["_need"] < cut["_of"]:
        ranked = global_rank(df.where(at).select(tie_break), [tie_break], out="_rank", n_slices=n_slices)
        last = ranked.where(F.col("_rank") == cut["_need"]).select(tie_break).first()[0]
        at = at & (F.col(tie_break) <= value(tie_break, last))
    above = F.col(score).isNotNull() if cut["_cut"] is None else F.col(score) > value(score, cut["_cut"])
    return F.coalesce(above, F.lit(False)) | at


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics (pandas/numpy default):
    position ``p * (n - 1)`` over the non-NULL values. One row per ``by`` group and probability:
    ``(by..., prob, value)``.

    Values are first counted per distinct value (partial aggregation), then ranked with
    :func:`prefix_sums`. Each ranked value carries its group's target ranks (an array with one entry
    per probability: a scalar subquery, or an equi-join on the group) and emits only the targets
    that fall into its rank range — no range join — then one aggregation per (group, probability)
    interpolates between the two order statistics.
    """
    by = list(by)
    vals = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(vals, [col], ["_c"], by=by).withColumn("_prev", F.col("_c_cum") - F.col("_c"))

    def targets(n: Column) -> Column:
        items = []
        for p in probs:
            pos = F.lit(float(p)) * (n - 1)
            items.append(F.struct(
                F.lit(float(p)).alias("prob"), F.floor(pos).cast("bigint").alias("lo"),
                F.ceil(pos).cast("bigint").alias("hi"), (pos - F.floor(pos)).alias("frac"),
            ))
        return F.array(*items)

    if by:
        # one row per group: the group's count comes with the per-slice totals
        per_group = cum.groupBy(*by).agg(targets(F.first("_c_total")).alias("_targets"))
        ranked = join_null_safe(cum, per_group, by)
    else:
        ranked = cum.withColumn("_targets", cum.agg(targets(F.first("_c_total"))).scalar())
    inside = lambda r: (F.col("_prev") <= r) & (r < F.col("_c_cum"))  # noqa: E731  (0-based rank r)
    hits = ranked.select(
        *by, F.col(col).cast("double").alias("_v"), "_prev", "_c_cum",
        F.explode(F.filter("_targets", lambda t: inside(t["lo"]) | inside(t["hi"]))).alias("_t"),
    ).select(*by, "_v", "_t.prob", "_t.frac", inside(F.col("_t.lo")).alias("_is_lo"), inside(F.col("_t.hi")).alias("_is_hi"))
    res = hits.groupBy(*by, "prob").agg(
        F.max(F.when(F.col("_is_lo"), F.col("_v"))).alias("_v_lo"),
        F.max(F.when(F.col("_is_hi"), F.col("_v"))).alias("_v_hi"),
        F.first("frac").alias("_frac"),
    )
    value = F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * F.col("_frac")
    return res.select(*by, "prob", value.alias("value"))
