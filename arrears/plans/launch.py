"""Score-based contact strategy: selection, economics and score drift (C9, K4, K5, P13, B1-B6,
A29-A31).

Selection takes the first ``floor(n * fraction)`` customers by score (ties by row id, trap T16)
without a global sort into one task (:func:`arrears.operators.ordered.top_fraction`).
Histograms follow ``numpy.histogram`` (trap T17): edges ``lo + i * step`` with the last edge exactly
``hi``, bins closed on the left and the last one on both sides, values outside ``[lo, hi]`` dropped
from counts *and* totals. The bin of a value is computed arithmetically and corrected against the
neighbouring edges, so no join with an edge table is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrears.operators.ordered import exact_quantiles, fraction_cut, global_rank, prefix_sums, top_fraction


def _whole():
    """The whole (tiny) bin table as one window frame."""
    return Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

METRICS = ["selected_customers", "revenue", "contact_cost", "economic_effect"]
PSI_EPS = 1e-6


# money is summed as DECIMAL: exact whatever the order of a distributed sum
MONEY_SUM = "decimal(18,2)"


def with_revenue(scoring: DataFrame) -> DataFrame:
    """revenue = recovered amount when the customer paid, else 0 (DECIMAL, two places)."""
    return scoring.withColumn(
        "revenue",
        F.when(F.col("target_paid_30d") == 1, F.col("recovered_amount_30d")).otherwise(F.lit(0.0)).cast(MONEY_SUM),
    )


def select_top(scoring: DataFrame, fraction: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """K4: the contacted set of the new strategy (``by=['snapshot_date']`` for a per-day capacity)."""
    return top_fraction(scoring, "score", "row_id", fraction, by=by or [])


def threshold(selected: DataFrame) -> DataFrame:
    """K5: the lowest score inside the selection."""
    return selected.agg(F.min("score").alias("threshold"), F.count(F.lit(1)).alias("selected_customers"))


def strategy_effect(selected: DataFrame, cost_per_contact: float = 35.0) -> DataFrame:
    """B1/B2: one row — customers, revenue, contact cost, effect."""
    r = with_revenue(selected)
    rev = F.coalesce(F.col("rev"), F.lit(0).cast(MONEY_SUM))
    cost = (F.col("n") * F.lit(cost_per_contact)).cast(MONEY_SUM)
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("rev")).select(
        F.col("n").cast("double").alias("selected_customers"),
        rev.cast("double").alias("revenue"),
        cost.cast("double").alias("contact_cost"),
        (rev - cost).cast("double").alias("economic_effect"),
    )


def _as_rows(one: DataFrame, value_name: str) -> DataFrame:
    parts = ", ".join(f"'{m}', {m}" for m in METRICS)
    return one.selectExpr(f"stack({len(METRICS)}, {parts}) as (metric, {value_name})")


def strategy_comparison(scoring: DataFrame, fraction: float = 0.25, cost_per_contact: float = 35.0) -> DataFrame:
    """Metric rows × current / new strategy and their difference."""
    new = _as_rows(strategy_effect(select_top(scoring, fraction), cost_per_contact), "new_strategy")
    cur = _as_rows(
        strategy_effect(scoring.where(F.col("current_contact_flg") == 1), cost_per_contact), "current_strategy"
    )
    return cur.join(new, "metric").select(
        "metric", "current_strategy", "new_strategy",
        (F.col("new_strategy").cast(MONEY_SUM) - F.col("current_strategy").cast(MONEY_SUM)).cast("double").alias(
            "difference"
        ),
    )


def _with_bin(values: DataFrame, v: str, rng: Column, n: int) -> DataFrame:
    """Add ``bin``: the numpy-compatible index in ``0 .. n-1`` of column ``v`` for the edges
    ``linspace(lo, hi, n+1)`` of the struct ``rng`` (one scalar subquery); NULL outside the range.

    Every step is a column of its own, so no step's expression is copied into the next. Equal edges
    put everything into the last bin, which is closed on both sides.
    """
    lo, hi, x = F.col("_r.lo"), F.col("_r.hi"), F.col("_v")

    def edge(i: Column) -> Column:
        return F.when(i >= n, hi).otherwise(i.cast("double") * F.col("_step") + lo)

    guess = F.floor((x - lo) / F.nullif(F.col("_step"), F.lit(0.0))).cast("int")
    staged = (
        values.withColumn("_v", F.col(v).cast("double")).withColumn("_r", rng)
        .withColumn("_step", (hi - lo) / F.lit(float(n)))
        .withColumn("_guess", F.least(F.greatest(F.coalesce(guess, F.lit(n - 1)), F.lit(0)), F.lit(n - 1)))
        .withColumn("_down", F.when((x < edge(F.col("_guess"))) & (F.col("_guess") > 0), F.col("_guess") - 1).otherwise(F.col("_guess")))
    )
    up = (x >= edge(F.col("_down") + 1)) & (F.col("_down") < n - 1)
    inside = (x >= lo) & (x <= hi)
    return staged.withColumn("bin", F.when(inside, F.when(up, F.col("_down") + 1).otherwise(F.col("_down")))).drop(
        "_v", "_r", "_step", "_guess", "_down")


def _bin_edges(spark, rng: Column, n: int) -> DataFrame:
    """``(bin, bin_left, bin_right)`` of all ``n`` bins of the range struct."""
    step = (F.col("_r.hi") - F.col("_r.lo")) / F.lit(float(n))
    bins = spark.range(n).select(F.col("id").cast("int").alias("bin"), rng.alias("_r")).withColumn("_step", step)
    return bins.select(
        "bin",
        (F.col("bin").cast("double") * F.col("_step") + F.col("_r.lo")).alias("bin_left"),
        F.when(F.col("bin") == n - 1, F.col("_r.hi"))
        .otherwise((F.col("bin") + 1).cast("double") * F.col("_step") + F.col("_r.lo")).alias("bin_right"),
    )


def value_range(df: DataFrame, col: str, widen: bool = False) -> Column:
    """``struct(lo, hi)`` of a column as one scalar subquery (one pass over the data). ``widen``: a
    constant column gets half a unit on both sides, as ``numpy.histogram`` does for its own range."""
    lo, hi = F.min(col).cast("double"), F.max(col).cast("double")
    half = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0)) if widen else F.lit(0.0)
    return df.agg(F.struct((lo - half).alias("lo"), (hi + half).alias("hi"))).scalar()


def histogram(values: DataFrame, col: str, n_bins: int) -> DataFrame:
    """Counts per equal-width bin on the column's own range.

    ``(bin, bin_left, bin_right, count)`` for all ``n_bins`` bins (empty ones with 0). Rows are
    binned where they are, so at most ``n_bins`` rows leave a task. No values: edges are NULL."""
    rng = value_range(values, col, widen=True)
    per_bin = _with_bin(values.select(col), col, rng, n_bins).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"))
    return _bin_edges(values.sparkSession, rng, n_bins).join(per_bin, "bin", "left").select(
        "bin", "bin_left", "bin_right", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")
    )


def psi_bins(
    train_scores: DataFrame, scoring: DataFrame, n_bins: int = 10, eps: float = PSI_EPS, method: str = "uniform"
) -> DataFrame:
    """Bins on the train scores; shares of train and scoring per bin (0 → ``eps``).

    ``method="uniform"``: equal-width bins on the train range (the reference's rule).
    ``method="quantile"``: edges at the train quantiles ``i / n_bins`` (linear interpolation), the
    alternative the reference describes; repeated edges give empty bins. Values outside the train
    range are dropped from counts and totals in both (``numpy.histogram``)."""
    if method == "uniform":
        rng = value_range(train_scores, "score")
        scores = train_scores.select("score", F.lit(True).alias("_train")).unionByName(
            scoring.select("score", F.lit(False).alias("_train")))
        counts = _with_bin(scores, "score", rng, n_bins).where(F.col("bin").isNotNull()).groupBy("bin").agg(
            F.count_if(F.col("_train")).alias("train_count"), F.count_if(~F.col("_train")).alias("scoring_count"))
        both = _bin_edges(train_scores.sparkSession, rng, n_bins).join(counts, "bin", "left").select(
            "bin", "bin_left", "bin_right",
            *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("train_count", "scoring_count")])
    elif method == "quantile":
        edges = exact_quantiles(train_scores.select("score"), "score", [i / n_bins for i in range(n_bins + 1)])
        edges = edges.select(F.round(F.col("prob") * n_bins).cast("int").alias("i"), F.col("value").alias("edge"))
        tr = _edge_binned(train_scores.select("score"), edges, n_bins).withColumnRenamed("count", "train_count")
        sc = _edge_binned(scoring.select("score"), edges, n_bins).select("bin", F.col("count").alias("scoring_count"))
        both = tr.join(sc, "bin")
    else:
        raise ValueError(f"unknown binning method {method}")
    return _distributions(both, eps)


def _distributions(both: DataFrame, eps: float) -> DataFrame:
    """Shares of the ``train_count`` and ``scoring_count`` of every bin (0 → ``eps``)."""
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(_whole()), F.lit(0))  # noqa: E731  (n_bins rows: a bounded window)
    out = both.select(
        "bin", "bin_left", "bin_right",
        share("train_count").alias("_t"), share("scoring_count").alias("_s"),
    )
    return out.select(
        "bin", "bin_left", "bin_right",
        F.when(F.col("_t") == 0, F.lit(eps)).otherwise(F.col("_t")).alias("train_dist"),
        F.when(F.col("_s") == 0, F.lit(eps)).otherwise(F.col("_s")).alias("scoring_dist"),
    )


def _edge_binned(values: DataFrame, edges: DataFrame, n_bins: int) -> DataFrame:
    """Counts per bin for explicit edges ``i = 0 .. n_bins``: bins left-closed, the last one closed
    (``numpy.histogram``). The bin of a value is ``searchsorted(edges, v, 'right') - 1`` over the
    sorted edge array (``n_bins + 1`` values, a scalar subquery); rows are binned where they are."""
    # the edge array enters as its own column: a subquery may not sit inside the lambda below
    counts = values.withColumn("_edges", edges.agg(F.sort_array(F.collect_list("edge"))).scalar())
    v, edge_arr = F.col("score"), F.col("_edges")
    right = F.size(F.filter(edge_arr, lambda e: e <= v)) - 1
    last = F.element_at(edge_arr, -1)
    bin_of = F.when((v >= F.element_at(edge_arr, 1)) & (v <= last), F.when(v == last, F.lit(n_bins - 1)).otherwise(right))
    hits = counts.select(bin_of.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count")
    )
    left = edges.where(F.col("i") < n_bins).select(F.col("i").alias("bin"), F.col("edge").alias("bin_left"))
    right_edge = edges.where(F.col("i") > 0).select((F.col("i") - 1).alias("bin"), F.col("edge").alias("bin_right"))
    return left.join(right_edge, "bin").join(hits, "bin", "left").select(
        "bin", "bin_left", "bin_right", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")
    )


def psi(bins: DataFrame) -> DataFrame:
    """``sum((train - scoring) * ln(train / scoring))``."""
    t, s = F.col("train_dist"), F.col("scoring_dist")
    return bins.agg(F.round(F.sum((t - s) * F.log(t / s)), 6).alias("psi"))


def score_shift(train_scores: DataFrame, scoring: DataFrame) -> DataFrame:
    """Mean, sample std, min, max of both score sets (rows ``train`` / ``scoring``)."""
    both = train_scores.select(F.lit("train").alias("dataset"), "score").unionByName(
        scoring.select(F.lit("scoring").alias("dataset"), "score")
    )
    return both.groupBy("dataset").agg(
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"), F.count(F.lit(1)).alias("n"),
    )


# bandwidths; beyond this distance the kernel exp(-z * z / 2) is exactly 0.0 in double precision
KDE_REACH = 38.7


def score_density(sets: dict[str, DataFrame], points: int = 1000) -> DataFrame:
    """Gaussian KDE (Scott's rule: ``h = std * n^(-1/5)``) of each score set on ``points`` grid
    points spanning the set's range widened by half of it on both sides (``numpy.linspace``).

    Scores are pre-counted per distinct value, and each value is spread onto the grid points within
    ``KDE_REACH`` bandwidths (the grid is uniform, so they are an index range). A set without a
    bandwidth (one score, or all equal) has no density: NULL on all grid points."""
    frames = []
    for name, df in sets.items():
        st = df.agg(F.struct(
            F.min("score").alias("lo"), F.max("score").alias("hi"),
            F.stddev_samp("score").alias("sd"), F.count("score").alias("n"),
        )).scalar()  # one pass, one scalar subquery
        start = F.col("_st.lo") - F.lit(0.5) * (F.col("_st.hi") - F.col("_st.lo"))
        stop = F.col("_st.hi") + F.lit(0.5) * (F.col("_st.hi") - F.col("_st.lo"))

        def staged(rows: DataFrame) -> DataFrame:
            """The set's statistics, grid and bandwidth as columns, each computed once."""
            return (
                rows.withColumn("_st", st).withColumn("_start", start).withColumn("_stop", stop)
                .withColumn("_step", (F.col("_stop") - F.col("_start")) / F.lit(float(points - 1)))
                .withColumn("_h", F.nullif(F.col("_st.sd") * F.pow(F.col("_st.n").cast("double"), F.lit(-0.2)), F.lit(0.0)))
            )

        # numpy.linspace: start + i * step, the last point exactly stop
        grid_x = F.when(F.col("i") == points - 1, F.col("_stop")).otherwise(F.col("i").cast("double") * F.col("_step") + F.col("_start"))
        counts = staged(df.where(F.col("score").isNotNull()).groupBy("score").agg(F.count(F.lit(1)).alias("_c")))
        counts = counts.where(F.col("_h").isNotNull()).withColumn("_reach", F.lit(KDE_REACH) * F.col("_h"))
        first = F.greatest(F.lit(0.0), F.ceil((F.col("score") - F.col("_reach") - F.col("_start")) / F.col("_step"))).cast("int")
        last = F.least(F.lit(points - 1.0), F.floor((F.col("score") + F.col("_reach") - F.col("_start")) / F.col("_step"))).cast("int")
        near = counts.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").select(
            "score", "_c", "_h", "_step", "_start", "_stop", F.explode(F.sequence("_first", "_last")).alias("i"))
        z = (grid_x - F.col("score")) / F.col("_h")
        sums = near.withColumn("_z", z).groupBy("i").agg(
            F.sum(F.col("_c") * F.exp(-0.5 * F.col("_z") * F.col("_z")) / (F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("_s"))
        grid = staged(df.sparkSession.range(points).select(F.col("id").cast("int").alias("i")))
        dens = grid.join(sums, "i", "left").select(
            F.lit(name).alias("dataset"), "i", grid_x.alias("x"),
            F.when(F.col("_h").isNotNull(), F.round(F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_st.n"), 6)).alias("density"),
        )
        frames.append(dens)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def boxplot_stats(df: DataFrame, col: str, whis: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the furthest values within
    ``whis * IQR`` of the box, and the number of values beyond them."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    qs = q.agg(F.struct(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                          for p, n in [(0.25, "q1"), (0.5, "med"), (0.75, "q3")]])).scalar()
    q1, med, q3 = qs["q1"], qs["med"], qs["q3"]
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    lo_f = q1 - F.lit(whis) * (q3 - q1)
    hi_f = q3 + F.lit(whis) * (q3 - q1)
    stats = v.agg(
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).alias("outliers"),
    )
    return stats.select(
        F.round(q1, 6).alias("q1"), F.round(med, 6).alias("median"), F.round(q3, 6).alias("q3"),
        F.round(q3 - q1, 6).alias("iqr"), F.round("whisker_low", 6).alias("whisker_low"),
        F.round("whisker_high", 6).alias("whisker_high"), "outliers",
    )


def full_report(
    train_scores: DataFrame, scoring: DataFrame, fraction: float = 0.25, cost_per_contact: float = 35.0,
    n_bins: int = 10, eps: float = PSI_EPS,
) -> DataFrame:
    """C9 in long form, ``(section, key, metric, value)``: K5 (``selection``), B1-B3 (``new``, ``current``,
    ``difference``), B4 and B5 (``psi_bin`` with the bin as key, ``psi``) and B6 (``score_shift`` per dataset).

    Both score sets are reduced to counts and revenue per distinct score in one read, and these are
    put into order; everything else is computed from them. Only if the cut goes through a score are
    the rows of that score read once more, to take those with the smallest ids.
    """
    spark = scoring.sparkSession
    both = with_revenue(scoring).select(
        F.lit("scoring").alias("dataset"), F.col("score").cast("double").alias("score"), "revenue",
        (F.col("current_contact_flg") == 1).alias("current"),
    ).unionByName(train_scores.select(F.lit("train").alias("dataset"), F.col("score").cast("double").alias("score")), allowMissingColumns=True)
    counts = both.groupBy("dataset", "score").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("revenue").alias("revenue"), F.count_if("current").alias("current"),
        F.sum(F.when(F.col("current"), F.col("revenue"))).alias("current_revenue"))
    ordered = prefix_sums(counts, [("score", "desc")], ["_c"], by=["dataset"])
    scored = ordered.where(F.col("dataset") == "scoring")
    cut = fraction_cut(scored, "score", fraction, []).agg(F.first(F.struct("_cut", "_need", "_of"))).scalar()

    def pairs(df: DataFrame, section, key, columns: dict) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in columns.items()]))
        return df.select(section.alias("section"), key.alias("key"), rows.alias("_m")).select("section", "key", "_m.*")

    # the new selection: whole scores above the cut, and of the score at the cut the first ids
    at_cut = with_revenue(scoring).where(F.col("score").cast("double").eqNullSafe(cut["_cut"])).where(cut["_need"] < cut["_of"])
    ranked = global_rank(at_cut.select("row_id", "revenue"), ["row_id"], out="_rank")
    part = ranked.where(F.col("_rank") <= cut["_need"]).agg(F.sum("revenue")).scalar()
    zero = F.lit(0).cast(MONEY_SUM)
    any_row = cut["_need"].isNotNull()
    above = any_row & F.when(cut["_cut"].isNull(), F.col("score").isNotNull()).otherwise(F.col("score") > cut["_cut"])
    at = any_row & F.col("score").eqNullSafe(cut["_cut"])
    effects = scored.agg(
        F.coalesce(F.sum(F.when(above, F.col("_c")).when(at, cut["_need"])), F.lit(0)).alias("new_n"),
        (F.coalesce(F.sum(F.when(above | (at & (cut["_need"] == cut["_of"])), F.col("revenue"))), zero)
         + F.coalesce(part, zero)).alias("new_revenue"),
        F.coalesce(F.sum("current"), F.lit(0)).alias("current_n"), F.coalesce(F.sum("current_revenue"), zero).alias("current_revenue"),
    )

    def effect(prefix: str) -> dict:
        n, revenue = F.col(f"{prefix}_n"), F.col(f"{prefix}_revenue").cast(MONEY_SUM)
        cost = (n * F.lit(cost_per_contact)).cast(MONEY_SUM)
        return dict(zip(METRICS, (n, revenue, cost, revenue - cost)))

    new, current = effect("new"), effect("current")
    difference = {m: new[m].cast(MONEY_SUM) - current[m].cast(MONEY_SUM) for m in METRICS}
    sections = F.explode(F.array(*[
        F.struct(F.lit(name).alias("section"), F.lit(m).alias("metric"), c.cast("double").alias("value"))
        for name, columns in (("new", new), ("current", current), ("difference", difference)) for m, c in columns.items()]))
    effects = effects.select(sections.alias("_e")).select("_e.section", F.lit("all").alias("key"), "_e.metric", "_e.value")
    selection = pairs(scored.agg(F.coalesce(F.sum(F.when(above, F.col("_c")).when(at, cut["_need"])), F.lit(0)).alias("n")),
                      F.lit("selection"), F.lit("all"), {"threshold": cut["_cut"], "selected_customers": F.col("n")})

    rng = value_range(ordered.where(F.col("dataset") == "train"), "score")
    binned = _with_bin(ordered.select("dataset", "score", "_c"), "score", rng, n_bins).where(F.col("bin").isNotNull())
    per_bin = binned.groupBy("bin").agg(*[
        F.sum(F.when(F.col("dataset") == d, F.col("_c"))).alias(f"{d}_count") for d in ("train", "scoring")])
    bins = _distributions(_bin_edges(spark, rng, n_bins).join(per_bin, "bin", "left").select(
        "bin", "bin_left", "bin_right",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("train_count", "scoring_count")]), eps)
    bin_rows = pairs(bins, F.lit("psi_bin"), F.col("bin").cast("string"),
                     {c: F.col(c) for c in ("bin_left", "bin_right", "train_dist", "scoring_dist")})
    total = pairs(psi(bins), F.lit("psi"), F.lit("all"), {"psi": F.col("psi")})

    known = F.when(F.col("score").isNotNull(), F.col("_c"))
    moments = ordered.groupBy("dataset").agg(
        F.sum("_c").alias("n"), F.sum(known).alias("_k"), F.sum(known * F.col("score")).alias("_s"),
        F.sum(known * F.col("score") * F.col("score")).alias("_q"), F.min("score").alias("min"), F.max("score").alias("max"))
    mean = F.col("_s") / F.col("_k")
    spread = F.sqrt(F.greatest(F.col("_q") - F.col("_k") * mean * mean, F.lit(0.0)) / F.nullif(F.col("_k") - 1, F.lit(0)))
    shift = pairs(moments, F.lit("score_shift"), F.col("dataset"),
                  {"mean": mean, "std": spread, "min": F.col("min"), "max": F.col("max"), "n": F.col("n")})
    return effects.unionByName(selection).unionByName(bin_rows).unionByName(total).unionByName(shift)
