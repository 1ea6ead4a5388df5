"""C8 and M1-M7, M13, M14 over the ``train`` fixture (train: Jan-Sep 1997, validation: Oct-Dec 1997).

Splits and preprocessing are value-checked against SQL; fitted-model outputs (probabilities,
importances, metric tables) are checked by rows only, since they depend on the optimiser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.operators import ranking as rk
from arrears.plans import payment_model as pm
from arrears.sources.fixtures import inputs

TRAIN = ("1997-01-01", "1997-09-30")
VALID = ("1997-10-01", "1997-12-31")
SCORING_FROM = "1998-01-01"

def _splits(spark, sf_dir):
    return pm.time_split(inputs(spark, sf_dir).train, TRAIN, VALID)


def _fitted(spark, sf_dir, kind):
    """The model, fitted anew: what a query returns never depends on queries before it."""
    tr, va = _splits(spark, sf_dir)
    return pm.fit_pipeline(tr) if kind == "pipeline" else pm.boosted_trees(tr, va)


_SPLIT_SQL = f"""
    tr AS (SELECT * FROM train WHERE snapshot_date BETWEEN TIMESTAMP '{TRAIN[0]}' AND TIMESTAMP '{TRAIN[1]}'),
    va AS (SELECT * FROM train WHERE snapshot_date BETWEEN TIMESTAMP '{VALID[0]}' AND TIMESTAMP '{VALID[1]}'),
    both_sets AS (SELECT 'train' AS split, * FROM tr UNION ALL SELECT 'validation', * FROM va),
    med AS (SELECT {", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in pm.NUM_COLS)} FROM tr),
    imputed AS (
        SELECT b.split, b.row_id, {", ".join(f"coalesce(CAST(b.{c} AS DOUBLE), m.{c}) AS {c}" for c in pm.NUM_COLS)}
        FROM both_sets b CROSS JOIN med m),
    mom AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in pm.NUM_COLS)}
            FROM imputed WHERE split = 'train')"""


@query(
    "time_split",
    oracle=with_inputs(["train"], "SELECT * FROM both_sets", _SPLIT_SQL),
)
def time_split(spark, sf_dir):
    """M1."""
    tr, va = _splits(spark, sf_dir)
    return tr.select(F.lit("train").alias("split"), "*").unionByName(va.select(F.lit("validation").alias("split"), "*"))


def _both_imputed(spark, sf_dir):
    tr, va = _splits(spark, sf_dir)
    imp = pm.ExactMedianImputer(pm.NUM_COLS).fit(tr)
    return imp, tr, va


@query(
    "median_impute",
    oracle=with_inputs(
        ["train"],
        f"SELECT split, row_id, {', '.join(f'round({c}, 6) AS {c}' for c in pm.NUM_COLS)} FROM imputed",
        _SPLIT_SQL,
    ),
)
def median_impute(spark, sf_dir):
    """M2: train medians applied to train and validation."""
    imp, tr, va = _both_imputed(spark, sf_dir)
    cols = [F.round(F.col(c), 6).alias(c) for c in pm.NUM_COLS]
    return imp.transform(tr).select(F.lit("train").alias("split"), "row_id", *cols).unionByName(
        imp.transform(va).select(F.lit("validation").alias("split"), "row_id", *cols)
    )


@query(
    "standard_scale",
    oracle=with_inputs(
        ["train"],
        "SELECT split, row_id, " + ", ".join(
            f"round((i.{c} - m.m_{c}) / CASE WHEN m.s_{c} = 0 THEN 1 ELSE m.s_{c} END, 6) AS {c}" for c in pm.NUM_COLS
        ) + " FROM imputed i CROSS JOIN mom m",
        _SPLIT_SQL,
    ),
)
def standard_scale(spark, sf_dir):
    """M3: z-scores with the train mean and population std (after M2)."""
    imp, tr, va = _both_imputed(spark, sf_dir)
    tr_i, va_i = imp.transform(tr), imp.transform(va)
    sc = pm.PopulationScaler(pm.NUM_COLS).fit(tr_i)
    cols = [F.round(F.col(c), 6).alias(c) for c in pm.NUM_COLS]
    return sc.transform(tr_i).select(F.lit("train").alias("split"), "row_id", *cols).unionByName(
        sc.transform(va_i).select(F.lit("validation").alias("split"), "row_id", *cols)
    )


@query(
    "one_hot_encode",
    oracle=with_inputs(
        ["train"],
        " UNION ALL ".join(
            f"""SELECT b.split, b.row_id, '{c}' AS column_name, coalesce(b.{c}, 'missing') AS category,
                       k.slot, w.width
                FROM both_sets b LEFT JOIN (
                    SELECT cat, CAST(row_number() OVER (ORDER BY cat) - 1 AS INTEGER) AS slot
                    FROM (SELECT DISTINCT coalesce({c}, 'missing') AS cat FROM tr)) k
                  ON k.cat = coalesce(b.{c}, 'missing')
                CROSS JOIN (SELECT CAST(count(DISTINCT coalesce({c}, 'missing')) AS INTEGER) AS width FROM tr) w"""
            for c in pm.CAT_COLS
        ),
        _SPLIT_SQL,
    ),
)
def one_hot_encode(spark, sf_dir):
    """M4 as a long table: every non-zero slot of the encoded vectors of each row and categorical column, with
    the vector's width; a row of zeros (unseen category) keeps one line with a NULL slot."""
    from pyspark.ml import Pipeline

    tr, va = (pm.fill_categories(df) for df in _splits(spark, sf_dir))
    encoder = Pipeline(stages=pm.one_hot_stages()).fit(tr)
    both = tr.select(F.lit("train").alias("split"), "*").unionByName(va.select(F.lit("validation").alias("split"), "*"))
    return pm.encoded_slots(encoder.transform(both), ["split", "row_id"])


@query("logistic_baseline")
def logistic_baseline(spark, sf_dir):
    """M5: hand-made preprocessing + logistic regression; validation probabilities."""
    tr, va = _splits(spark, sf_dir)
    return pm.handmade_baseline(tr, va)


@query("ml_pipeline")
def ml_pipeline(spark, sf_dir):
    """M6: the same as one Spark ML pipeline; validation probabilities."""
    _, va = _splits(spark, sf_dir)
    return pm.positive_probability(_fitted(spark, sf_dir, "pipeline"), pm.fill_categories(va))


@query("boosted_trees")
def boosted_trees(spark, sf_dir):
    """M7: gradient-boosted trees with patience-based early stopping; validation probabilities."""
    _, va = _splits(spark, sf_dir)
    model, _best = _fitted(spark, sf_dir, "gbt")
    return pm.positive_probability(model, pm.fill_categories(va))


@query("predict_probability")
def predict_probability(spark, sf_dir):
    """The fitted pipeline applied to another set (the rows after the validation period)."""
    later = inputs(spark, sf_dir).train.where(F.col("snapshot_date") >= F.lit(SCORING_FROM).cast("timestamp_ntz"))
    return pm.positive_probability(_fitted(spark, sf_dir, "pipeline"), pm.fill_categories(later))


@query("feature_importance_top10")
def feature_importance_top10(spark, sf_dir):
    """The boosted model's importances per input column (model metadata, at most #features rows)."""
    model, _best = _fitted(spark, sf_dir, "gbt")
    rows = pm.feature_importance(model, 10)
    return spark.createDataFrame(rows, "feature string, importance double")


@query("payment_model_report")
def payment_model_report(spark, sf_dir):
    """Validation metrics of the hand-made baseline, the pipeline and the boosted model."""
    tr, va = _splits(spark, sf_dir)
    va = pm.fill_categories(va)
    base = pm.handmade_baseline(tr, va).withColumnRenamed("proba", "baseline")
    pipe = pm.positive_probability(_fitted(spark, sf_dir, "pipeline"), va).withColumnRenamed("proba", "pipeline")
    gbt_model, _ = _fitted(spark, sf_dir, "gbt")
    boost = pm.positive_probability(gbt_model, va).withColumnRenamed("proba", "boosted")
    joined = va.select("row_id", pm.LABEL).join(base, "row_id").join(pipe, "row_id").join(boost, "row_id")
    return rk.model_comparison(joined, pm.LABEL, {"baseline": "baseline", "pipeline": "pipeline", "boosted": "boosted"}, "row_id")


_MODELS = {"baseline": "baseline", "pipeline": "pipeline", "boosted": "boosted"}


@query(
    "logistic_certificate",
    oracle=with_inputs(
        ["train"],
        """SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT count(*) FROM va) AS validation_rows,
                  0.0::DOUBLE AS largest_gradient, 0.0::DOUBLE AS largest_difference, 0.0::DOUBLE AS largest_score_error""",
        _SPLIT_SQL,
    ),
)
def logistic_certificate(spark, sf_dir):
    """M5, M6, M14 checked: rows, the largest component of the penalised gradient per row at the fit (zero at
    the optimum), the largest difference of the two models' validation probabilities, and that of an emitted
    probability from the logistic function of its features."""
    tr, va = _splits(spark, sf_dir)
    regression, encode = pm.handmade_fit(tr)
    train_scored, scored = regression.transform(encode(tr)), regression.transform(encode(va))
    gradient = pm.penalised_gradient(train_scored, regression).agg(F.max(F.abs("gradient"))).scalar()
    n = tr.agg(F.count(F.lit(1))).scalar()
    by_hand = scored.select("row_id", "probability", "features", pm.vector_to_array("probability")[1].alias("hand"))
    pipe = pm.positive_probability(_fitted(spark, sf_dir, "pipeline"), pm.fill_categories(va))
    both = by_hand.join(pipe, "row_id").agg(
        F.count(F.lit(1)).alias("validation_rows"), F.max(F.abs(F.col("hand") - F.col("proba"))).alias("difference"))
    return both.select(
        n.alias("train_rows"), "validation_rows",
        F.round(F.abs(gradient) / n, 6).alias("largest_gradient"), F.round("difference", 6).alias("largest_difference"),
        F.round(pm.emitted_score_error(scored, regression).scalar(), 9).alias("largest_score_error"))


@query(
    "boosted_certificate",
    oracle=with_inputs(
        ["train"],
        f"""SELECT (SELECT count(*) FROM va) AS validation_rows, {len(pm.NUM_COLS) + len(pm.CAT_COLS)} AS features,
                   1.0::DOUBLE AS importance_total, true AS best_is_last, 0.0::DOUBLE AS loss_error""",
        _SPLIT_SQL,
    ),
)
def boosted_certificate(spark, sf_dir):
    """M7, M13 checked: the importances of all inputs sum to one; no shorter stage of the kept model has a lower
    validation loss; the staged loss of its last tree is the loss of its emitted probabilities."""
    _, va = _splits(spark, sf_dir)
    model, best = _fitted(spark, sf_dir, "gbt")
    boosted = model.stages[-1]
    scored = model.transform(pm.fill_categories(va))
    losses = pm.staged_losses(boosted, scored.select("features", pm.LABEL))
    last = losses.agg(F.struct(F.max(F.when(F.col("trees") == best, F.col("loss"))).alias("loss"), F.min("loss").alias("least"))).scalar()
    p = F.element_at(pm.vector_to_array("probability"), F.col(pm.LABEL) + 1)
    importances = pm.feature_importance(model, len(pm.NUM_COLS) + len(pm.CAT_COLS))
    return scored.agg(F.count(F.lit(1)).alias("validation_rows"), F.avg(-2 * F.log(p)).alias("_emitted")).select(
        "validation_rows", F.lit(len(importances)).alias("features"),
        F.lit(round(sum(value for _, value in importances), 6)).alias("importance_total"),
        (last["loss"] == last["least"]).alias("best_is_last"),
        F.round(F.abs(last["loss"] - F.col("_emitted")), 6).alias("loss_error"))


@query("payment_model_full_report")
def payment_model_full_report(spark, sf_dir):
    """C8 in long form, ``(section, key, metric, value)``: rows per split, metrics of the three models, metrics per
    segment, and the boosted model's importances; every metric is computed from the emitted scores."""
    tr, va = _splits(spark, sf_dir)
    va = pm.fill_categories(va)
    base = pm.handmade_baseline(tr, va).withColumnRenamed("proba", "baseline")
    pipe = pm.positive_probability(_fitted(spark, sf_dir, "pipeline"), va).withColumnRenamed("proba", "pipeline")
    gbt_model, best = _fitted(spark, sf_dir, "gbt")
    boost = pm.positive_probability(gbt_model, va).withColumnRenamed("proba", "boosted")
    scores = va.select("row_id", pm.LABEL, "dpd_bucket", "region").join(base, "row_id").join(pipe, "row_id").join(boost, "row_id")
    return pm.full_report(tr, scores, _MODELS, pm.feature_importance(gbt_model, 10), best)
