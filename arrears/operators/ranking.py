"""Ranking metrics of scored binary labels, overall or per segment.

Rows are counted per (group, score); only these counts are ordered, with the distributed prefix sums
of :mod:`arrears.operators.ordered`, and the metrics are sums over them. A NULL score ranks last. A
group with one class only has no ROC-AUC (NULL), one without positives no PR-AUC.

* ROC-AUC: trapezoids of the ROC curve over distinct thresholds = Mann-Whitney with ties counted
  half: ``sum_s neg(s) * (TP(>s) + pos(s)/2) / (P * N)``.
* average precision (sklearn's step sum, trap T18): ``sum_s pos(s)/P * TP(>=s) / (TP(>=s) + FP(>=s))``.
* precision at a fraction: mean label of the first ``floor(n * f)`` rows by score (ties by id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.operators.ordered import fraction_cut, global_rank, join_null_safe, prefix_sums, top_fraction


def stack_scores(df: DataFrame, label: str, scores: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Long format ``(keep..., model, score, y)`` — one row per input row and model."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    return df.select(*keep, F.col(label).cast("int").alias("y"), F.explode(arr).alias("_m")).select(
        *keep, "_m.model", "_m.score", "y"
    )


def precision_at(long: DataFrame, by: Sequence[str], id_col: str, fraction: float = 0.3) -> DataFrame:
    """Mean label among the top ``floor(n * fraction)`` rows of each group."""
    top = top_fraction(long, "score", id_col, fraction, by=by)
    return top.groupBy(*by).agg(F.round(F.avg("y"), 6).alias("precision_at"))


def binary_metrics(
    df: DataFrame,
    label: str,
    scores: dict[str, str],
    id_col: str,
    by: Sequence[str] = (),
    fraction: float = 0.3,
) -> DataFrame:
    """M8-M10 for each model (and ``by`` group): ``(by..., model, roc_auc, pr_auc, precision_at)``.

    Running positive / negative counts over the distinct scores give the ROC / PR curve points.
    Precision at the fraction counts whole scores above the cut; of the score at the cut only ids
    and labels are ranked, where the cut goes through it.
    """
    keys = [*by, "model"]
    long = stack_scores(df, label, scores, keep=[*by, id_col])
    counts = long.groupBy(*keys, "score").agg(
        F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg"), F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(counts, [("score", "desc")], ["_pos", "_neg", "_c"], by=keys)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("_pos", "_neg", "_pos_cum", "_neg_cum"))
    k = F.floor(F.col("_c_total").cast("double") * F.lit(float(fraction)))
    curve = cum.groupBy(*keys).agg(
        F.sum(neg * (tp - pos / 2)).alias("_area"),
        F.sum(F.when(pos > 0, pos * tp / (tp + fp))).alias("_ap"),
        F.sum(F.when(F.col("_c_cum") <= k, F.col("_pos"))).alias("_above"),
        F.first(k).alias("_k"),
        F.first("_pos_total").cast("double").alias("_P"),
        F.first("_neg_total").cast("double").alias("_N"),
    )
    cut = fraction_cut(cum, "score", fraction, keys).where(F.col("_need") < F.col("_of"))
    at_cut = join_null_safe(long, cut.select(*keys, F.col("_cut").alias("score"), "_need"), [*keys, "score"])
    ranked = global_rank(at_cut.select(*keys, id_col, "y", "_need"), [id_col], by=keys, out="_rank")
    partial = ranked.where(F.col("_rank") <= F.col("_need")).groupBy(*keys).agg(F.sum("y").alias("_at_cut"))
    g = join_null_safe(curve, partial, keys, "left")
    in_top = F.coalesce("_above", F.lit(0)) + F.coalesce("_at_cut", F.lit(0))
    pairs = F.nullif(F.col("_P") * F.col("_N"), F.lit(0.0))
    return g.select(
        *keys,
        F.round(F.col("_area") / pairs, 6).alias("roc_auc"),
        F.round(F.coalesce("_ap", F.lit(0.0)) / F.nullif(F.col("_P"), F.lit(0.0)), 6).alias("pr_auc"),
        F.round(in_top / F.nullif(F.col("_k"), F.lit(0)), 6).alias("precision_at"),
    )


def segment_metrics(
    df: DataFrame, label: str, scores: dict[str, str], id_col: str, segments: Sequence[str], fraction: float = 0.3
) -> DataFrame:
    """The metrics per value of each segment column, models side by side:
    ``(segment_type, segment, roc_auc_<m>, pr_auc_<m>, p30_<m>, ...)``."""
    seg = F.explode(F.array(*[F.struct(F.lit(s).alias("segment_type"), F.col(s).cast("string").alias("segment")) for s in segments]))
    cols = [c for c in df.columns if c not in segments]
    long = df.select(*cols, seg.alias("_s")).select(*cols, "_s.segment_type", "_s.segment")
    m = binary_metrics(long, label, scores, id_col, by=["segment_type", "segment"], fraction=fraction)
    aggs = []
    for model in scores:
        sel = F.col("model") == model
        aggs += [
            F.max(F.when(sel, F.col("roc_auc"))).alias(f"roc_auc_{model}"),
            F.max(F.when(sel, F.col("pr_auc"))).alias(f"pr_auc_{model}"),
            F.max(F.when(sel, F.col("precision_at"))).alias(f"p30_{model}"),
        ]
    return m.groupBy("segment_type", "segment").agg(*aggs)


def model_comparison(df: DataFrame, label: str, scores: dict[str, str], id_col: str, fraction: float = 0.3) -> DataFrame:
    """Rows ``ROC-AUC``, ``PR-AUC``, ``precision@top30%`` with one column per model."""
    m = binary_metrics(df, label, scores, id_col, fraction=fraction)
    long = m.selectExpr(
        "model",
        "stack(3, 'ROC-AUC', roc_auc, 'PR-AUC', pr_auc, 'precision@top30%', precision_at) as (metric, value)",
    )
    return long.groupBy("metric").pivot("model", list(scores)).agg(F.first("value"))
