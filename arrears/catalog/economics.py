"""Selection by score, economics of the new vs the current strategy, score drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.plans import launch as ln
from arrears.sources.fixtures import inputs

_IN = ["scoring_results", "train_scores", "train"]
_CTES = """
    rev AS (SELECT *, CAST(CASE WHEN target_paid_30d = 1 THEN recovered_amount_30d ELSE 0.0 END AS DECIMAL(18,2))
                      AS revenue
            FROM scoring_results),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rn FROM rev)
            WHERE rn <= floor((SELECT count(*) FROM rev) * 0.25::DOUBLE)),
    cur AS (SELECT * FROM rev WHERE current_contact_flg = 1),
    eff AS (
        SELECT 'new' AS s, CAST(count(*) AS DOUBLE) AS selected_customers,
               CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue,
               CAST(count(*) * 35.0 AS DOUBLE) AS contact_cost,
               CAST(coalesce(sum(revenue), 0) - count(*) * 35 AS DOUBLE) AS economic_effect FROM top
        UNION ALL
        SELECT 'current', CAST(count(*) AS DOUBLE), CAST(coalesce(sum(revenue), 0) AS DOUBLE),
               CAST(count(*) * 35.0 AS DOUBLE), CAST(coalesce(sum(revenue), 0) - count(*) * 35 AS DOUBLE) FROM cur),
    eff_long AS (
        SELECT s, 'selected_customers' AS metric, selected_customers AS v FROM eff
        UNION ALL SELECT s, 'revenue', revenue FROM eff
        UNION ALL SELECT s, 'contact_cost', contact_cost FROM eff
        UNION ALL SELECT s, 'economic_effect', economic_effect FROM eff),
    rng AS (SELECT min(score) AS lo, max(score) AS hi FROM train_scores),
    edges AS (SELECT CAST(b AS INTEGER) AS b, b * ((hi - lo) / 10.0) + lo AS bin_left,
                     CASE WHEN b = 9 THEN hi ELSE (b + 1) * ((hi - lo) / 10.0) + lo END AS bin_right
              FROM rng CROSS JOIN range(0, 10) t(b)),
    t_bin AS (SELECT e.b, count(t.score) AS c FROM edges e LEFT JOIN train_scores t
                ON t.score >= e.bin_left AND (t.score < e.bin_right OR (e.b = 9 AND t.score <= e.bin_right))
              GROUP BY e.b),
    s_bin AS (SELECT e.b, count(s.score) AS c FROM edges e LEFT JOIN scoring_results s
                ON s.score >= e.bin_left AND (s.score < e.bin_right OR (e.b = 9 AND s.score <= e.bin_right))
              GROUP BY e.b),
    psi_b AS (
        SELECT e.b AS bin, e.bin_left, e.bin_right,
               CASE WHEN t.c = 0 THEN 1e-6 ELSE t.c / (SELECT sum(c) FROM t_bin) END AS train_dist,
               CASE WHEN s.c = 0 THEN 1e-6 ELSE s.c / (SELECT sum(c) FROM s_bin) END AS scoring_dist
        FROM edges e JOIN t_bin t USING (b) JOIN s_bin s USING (b))"""


def _o(body):
    return with_inputs(_IN, body, _CTES)


@query("conditional_revenue", oracle=_o("SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, "
                "round(CAST(sum(revenue) AS DOUBLE) / count(*), 6) AS mean_revenue FROM rev"))
def conditional_revenue(spark, sf_dir):
    """P13."""
    r = ln.with_revenue(inputs(spark, sf_dir).scoring_results)
    return r.agg(
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.round(F.sum("revenue").cast("double") / F.count(F.lit(1)), 6).alias("mean_revenue"),
    )


@query("top_fraction", oracle=_o("SELECT customer_id, snapshot_date, score, row_id FROM top"))
def top_fraction(spark, sf_dir):
    """K4: the top 25 % by score (ties by row id)."""
    return ln.select_top(inputs(spark, sf_dir).scoring_results, 0.25).select("customer_id", "snapshot_date", "score", "row_id")


@query("score_threshold", oracle=_o("SELECT min(score) AS threshold, count(*) AS selected_customers FROM top"))
def score_threshold(spark, sf_dir):
    """K5."""
    return ln.threshold(ln.select_top(inputs(spark, sf_dir).scoring_results, 0.25))


@query("new_strategy_effect", oracle=_o("SELECT metric, v AS new_strategy FROM eff_long WHERE s = 'new'"))
def new_strategy_effect(spark, sf_dir):
    """B1."""
    one = ln.strategy_effect(ln.select_top(inputs(spark, sf_dir).scoring_results, 0.25))
    return ln._as_rows(one, "new_strategy")


@query("current_strategy_effect", oracle=_o("SELECT metric, v AS current_strategy FROM eff_long WHERE s = 'current'"))
def current_strategy_effect(spark, sf_dir):
    """B2."""
    sc = inputs(spark, sf_dir).scoring_results
    return ln._as_rows(ln.strategy_effect(sc.where(F.col("current_contact_flg") == 1)), "current_strategy")


@query(
    "strategy_comparison",
    oracle=_o(
        """SELECT c.metric, c.v AS current_strategy, n.v AS new_strategy,
                  CAST(CAST(n.v AS DECIMAL(18,2)) - CAST(c.v AS DECIMAL(18,2)) AS DOUBLE) AS difference
           FROM eff_long c JOIN eff_long n ON c.metric = n.metric AND c.s = 'current' AND n.s = 'new'"""
    ),
)
def strategy_comparison(spark, sf_dir):
    """B3."""
    return ln.strategy_comparison(inputs(spark, sf_dir).scoring_results)


@query("psi_bins", oracle=_o("SELECT * FROM psi_b"))
def psi_bins(spark, sf_dir):
    """B4."""
    inp = inputs(spark, sf_dir)
    return ln.psi_bins(inp.train_scores, inp.scoring_results)


@query(
    "psi",
    oracle=_o("SELECT round(sum((train_dist - scoring_dist) * ln(train_dist / scoring_dist)), 6) AS psi FROM psi_b"),
)
def psi(spark, sf_dir):
    """B5."""
    inp = inputs(spark, sf_dir)
    return ln.psi(ln.psi_bins(inp.train_scores, inp.scoring_results))


@query(
    "score_shift",
    oracle=_o(
        """SELECT 'train' AS dataset, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std,
                  min(score) AS min, max(score) AS max, count(*) AS n FROM train_scores
           UNION ALL SELECT 'scoring', round(avg(score), 6), round(stddev_samp(score), 6), min(score), max(score),
                  count(*) FROM scoring_results"""
    ),
)
def score_shift(spark, sf_dir):
    """B6."""
    inp = inputs(spark, sf_dir)
    return ln.score_shift(inp.train_scores, inp.scoring_results)


@query(
    "histogram",
    oracle=_o(
        """SELECT e.b AS bin, e.bin_left, e.bin_right, count(s.score) AS count
           FROM (SELECT CAST(b AS INTEGER) AS b, b * ((hi - lo) / 30.0) + lo AS bin_left,
                        CASE WHEN b = 29 THEN hi ELSE (b + 1) * ((hi - lo) / 30.0) + lo END AS bin_right
                 FROM (SELECT min(score) AS lo, max(score) AS hi FROM scoring_results) CROSS JOIN range(0, 30) t(b)) e
           LEFT JOIN scoring_results s
             ON s.score >= e.bin_left AND (s.score < e.bin_right OR (e.b = 29 AND s.score <= e.bin_right))
           GROUP BY ALL"""
    ),
)
def histogram(spark, sf_dir):
    """30 equal-width bins of the scoring scores over their own range."""
    return ln.histogram(inputs(spark, sf_dir).scoring_results.select("score"), "score", 30)


@query(
    "boxplot_stats",
    oracle=_o(
        """SELECT round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
                  round(min(income) FILTER (WHERE income >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
                  round(max(income) FILTER (WHERE income <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
                  count(*) FILTER (WHERE income < q1 - 1.5 * (q3 - q1) OR income > q3 + 1.5 * (q3 - q1)) AS outliers
           FROM train CROSS JOIN (SELECT quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.5) AS med,
                                         quantile_cont(income, 0.75) AS q3 FROM train) q
           GROUP BY q1, med, q3"""
    ),
)
def boxplot_stats(spark, sf_dir):
    """Numbers behind the income box plot."""
    return ln.boxplot_stats(inputs(spark, sf_dir).train, "income")


@query(
    "score_density",
    oracle=_o(
        """SELECT d.dataset, CAST(g.i AS INTEGER) AS i, g.x,
                  round(sum(exp(-0.5 * ((g.x - d.score) / g.h) * ((g.x - d.score) / g.h)) / (g.h * sqrt(2 * pi())))
                        / g.n, 6) AS density
           FROM (SELECT 'train' AS dataset, score FROM train_scores
                 UNION ALL SELECT 'scoring', score FROM scoring_results) d
           JOIN (SELECT st.dataset, t.i,
                        CASE WHEN t.i = 999 THEN st.stop ELSE t.i * ((st.stop - st.start) / 999.0) + st.start END AS x,
                        st.sd * power(CAST(st.n AS DOUBLE), -0.2) AS h, st.n
                 FROM (SELECT dataset, min(score) - 0.5 * (max(score) - min(score)) AS start,
                              max(score) + 0.5 * (max(score) - min(score)) AS stop,
                              stddev_samp(score) AS sd, count(*) AS n
                       FROM (SELECT 'train' AS dataset, score FROM train_scores
                             UNION ALL SELECT 'scoring', score FROM scoring_results) GROUP BY dataset) st
                 CROSS JOIN range(0, 1000) t(i)) g
             ON g.dataset = d.dataset
           GROUP BY d.dataset, g.i, g.x, g.n"""
    ),
)
def score_density(spark, sf_dir):
    """KDE of the train and scoring scores on 1000 grid points."""
    inp = inputs(spark, sf_dir)
    return ln.score_density({"train": inp.train_scores.select("score"), "scoring": inp.scoring_results.select("score")})


@query(
    "strategy_launch_report",
    oracle=_o(
        """SELECT (SELECT min(score) FROM top) AS threshold,
                  (SELECT v FROM eff_long WHERE s = 'new' AND metric = 'economic_effect') AS new_effect,
                  (SELECT v FROM eff_long WHERE s = 'current' AND metric = 'economic_effect') AS current_effect,
                  (SELECT round(sum((train_dist - scoring_dist) * ln(train_dist / scoring_dist)), 6) FROM psi_b) AS psi,
                  (SELECT round(avg(score), 6) FROM train_scores) AS mean_score_train,
                  (SELECT round(avg(score), 6) FROM scoring_results) AS mean_score_scoring"""
    ),
)
def strategy_launch_report(spark, sf_dir):
    """C9 (headline row): threshold, effects of both strategies, PSI and the score means."""
    inp = inputs(spark, sf_dir)
    sc, tr = inp.scoring_results, inp.train_scores
    sel = ln.select_top(sc, 0.25)
    thr = ln.threshold(sel).select("threshold")
    new = ln.strategy_effect(sel).select(F.col("economic_effect").alias("new_effect"))
    cur = ln.strategy_effect(sc.where(F.col("current_contact_flg") == 1)).select(F.col("economic_effect").alias("current_effect"))
    p = ln.psi(ln.psi_bins(tr, sc))
    shift = ln.score_shift(tr, sc)
    means = shift.agg(
        F.max(F.when(F.col("dataset") == "train", F.col("mean"))).alias("mean_score_train"),
        F.max(F.when(F.col("dataset") == "scoring", F.col("mean"))).alias("mean_score_scoring"),
    )
    m_struct = means.select(F.struct("mean_score_train", "mean_score_scoring")).scalar()
    return thr.select(
        "threshold", new.scalar().alias("new_effect"), cur.scalar().alias("current_effect"),
        p.scalar().alias("psi"), *[m_struct[c].alias(c) for c in ("mean_score_train", "mean_score_scoring")],
    )


@query(
    "strategy_launch_full_report",
    oracle=_o(
        """SELECT section, key, metric, round(value, 6) AS value FROM (
             SELECT s AS section, 'all' AS key, metric, v AS value FROM eff_long
             UNION ALL SELECT 'difference', 'all', metric, (n.v::DECIMAL(18,2) - c.v::DECIMAL(18,2))::DOUBLE
                       FROM (SELECT * FROM eff_long WHERE s = 'new') n JOIN (SELECT * FROM eff_long WHERE s = 'current') c USING (metric)
             UNION ALL SELECT 'selection', 'all', 'threshold', min(score) FROM top
             UNION ALL SELECT 'selection', 'all', 'selected_customers', count(*)::DOUBLE FROM top
             UNION ALL SELECT 'psi_bin', bin::VARCHAR, metric, value
                       FROM (UNPIVOT psi_b ON bin_left, bin_right, train_dist, scoring_dist INTO NAME metric VALUE value)
             UNION ALL SELECT 'psi', 'all', 'psi', sum((train_dist - scoring_dist) * ln(train_dist / scoring_dist)) FROM psi_b
             UNION ALL SELECT 'score_shift', dataset, metric, value FROM (
                       UNPIVOT (SELECT 'train' AS dataset, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min,
                                       max(score) AS max, count(*)::DOUBLE AS n FROM train_scores
                                UNION ALL SELECT 'scoring', avg(score), stddev_samp(score), min(score), max(score),
                                       count(*)::DOUBLE FROM scoring_results)
                       ON mean, std, min, max, n INTO NAME metric VALUE value))"""
    ),
)
def strategy_launch_full_report(spark, sf_dir):
    """C9 in full: selection, effects of both strategies and their difference, PSI bins, PSI and score shift."""
    inp = inputs(spark, sf_dir)
    return ln.full_report(inp.train_scores, inp.scoring_results).withColumn("value", F.round("value", 6))
