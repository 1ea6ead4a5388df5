"""M8-M12 on the deterministic ``eval_scores`` (baseline and boosted probabilities per row)."""

from __future__ import annotations

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.operators import ranking as rk
from arrears.sources.fixtures import inputs

MODELS = {"baseline": "baseline_proba", "boosted": "boosted_proba"}

# long form: one row per (segment, model, row); metrics written the textbook way (rank-sum AUC,
# per-positive precision for AP, row_number for the top fraction)
_LONG = """
    long AS (
        SELECT s.segment_type, s.segment, m.model, m.score, e.y_true AS y, e.row_id
        FROM eval_scores e
        CROSS JOIN LATERAL (VALUES ('baseline', e.baseline_proba), ('boosted', e.boosted_proba)) m(model, score)
        CROSS JOIN LATERAL (VALUES ('all', 'all'), ('dpd_bucket', e.dpd_bucket), ('region', e.region)) s(segment_type, segment)),
    ranked AS (
        SELECT *,
               rank() OVER w + (count(*) OVER (PARTITION BY segment_type, segment, model, score) - 1) / 2.0 AS avg_rank,
               sum(y) OVER (PARTITION BY segment_type, segment, model ORDER BY score DESC
                            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_at,
               count(*) OVER (PARTITION BY segment_type, segment, model ORDER BY score DESC
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_at,
               row_number() OVER (PARTITION BY segment_type, segment, model ORDER BY score DESC, row_id) AS rn,
               count(*) OVER (PARTITION BY segment_type, segment, model) AS n_grp
        FROM long
        WINDOW w AS (PARTITION BY segment_type, segment, model ORDER BY score)),
    metrics AS (
        SELECT segment_type, segment, model,
               round((sum(avg_rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0)
                     / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc,
               round(avg(CAST(tp_at AS DOUBLE) / n_at) FILTER (WHERE y = 1), 6) AS pr_auc,
               round(avg(y) FILTER (WHERE rn <= floor(n_grp * 0.3::DOUBLE)), 6) AS precision_at
        FROM ranked GROUP BY 1, 2, 3)"""


def _o(body):
    return with_inputs(["eval_scores"], body, _LONG)


@query(
    "roc_auc",
    oracle=_o("SELECT model, roc_auc FROM metrics WHERE segment_type = 'all'"),
)
def roc_auc(spark, sf_dir):
    """M8."""
    m = rk.binary_metrics(inputs(spark, sf_dir).eval_scores, "y_true", MODELS, "row_id")
    return m.select("model", "roc_auc")


@query("average_precision", oracle=_o("SELECT model, pr_auc FROM metrics WHERE segment_type = 'all'"))
def average_precision(spark, sf_dir):
    """M9."""
    m = rk.binary_metrics(inputs(spark, sf_dir).eval_scores, "y_true", MODELS, "row_id")
    return m.select("model", "pr_auc")


@query("precision_at_fraction", oracle=_o("SELECT model, precision_at FROM metrics WHERE segment_type = 'all'"))
def precision_at_fraction(spark, sf_dir):
    """M10."""
    ev = inputs(spark, sf_dir).eval_scores
    long = rk.stack_scores(ev, "y_true", MODELS, keep=["row_id"])
    return rk.precision_at(long, ["model"], "row_id", 0.3)


@query(
    "model_comparison",
    oracle=_o(
        """SELECT metric,
                  max(value) FILTER (WHERE model = 'baseline') AS baseline,
                  max(value) FILTER (WHERE model = 'boosted') AS boosted
           FROM (SELECT model, 'ROC-AUC' AS metric, roc_auc AS value FROM metrics WHERE segment_type = 'all'
                 UNION ALL SELECT model, 'PR-AUC', pr_auc FROM metrics WHERE segment_type = 'all'
                 UNION ALL SELECT model, 'precision@top30%', precision_at FROM metrics WHERE segment_type = 'all')
           GROUP BY metric"""
    ),
)
def model_comparison(spark, sf_dir):
    """M11."""
    return rk.model_comparison(inputs(spark, sf_dir).eval_scores, "y_true", MODELS, "row_id")


@query(
    "segment_model_metrics",
    oracle=_o(
        """SELECT segment_type, segment,
                  max(roc_auc) FILTER (WHERE model = 'baseline') AS roc_auc_baseline,
                  max(pr_auc) FILTER (WHERE model = 'baseline') AS pr_auc_baseline,
                  max(precision_at) FILTER (WHERE model = 'baseline') AS p30_baseline,
                  max(roc_auc) FILTER (WHERE model = 'boosted') AS roc_auc_boosted,
                  max(pr_auc) FILTER (WHERE model = 'boosted') AS pr_auc_boosted,
                  max(precision_at) FILTER (WHERE model = 'boosted') AS p30_boosted
           FROM metrics WHERE segment_type <> 'all' GROUP BY 1, 2"""
    ),
)
def segment_model_metrics(spark, sf_dir):
    """M12 (D3): metrics of both models per dpd_bucket and per region."""
    ev = inputs(spark, sf_dir).eval_scores
    return rk.segment_metrics(ev, "y_true", MODELS, "row_id", ["dpd_bucket", "region"])
