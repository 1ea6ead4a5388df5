"""Payment-probability model: split, preprocessing, logistic baseline, gradient-boosted trees and
their evaluation (C8, M1-M7, M13, M14).

Equivalences with the single-machine originals, and where they are deliberately not equal:

* median imputation uses the *exact* median (trap T13: Spark's ``Imputer`` is approximate);
* scaling divides by the *population* standard deviation (T12: Spark's ``StandardScaler`` uses the
  sample one); zero variance divides by 1;
* one-hot slots are the train categories in alphabetical order; unseen categories map to all zeros;
* ``C = 1`` L2 logistic regression ⇔ Spark's ``regParam = 1 / n_train`` without standardisation (T14);
* boosting re-aims ordered-target-statistics trees as Spark GBT on indexed categories; early stopping
  is patience-based on the validation log-loss (T15: Spark's own rule stops at the first
  non-improving round). Quality, not equality, is compared.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.operators.ordered import exact_quantiles
from arrears.operators.ranking import binary_metrics

NUM_COLS = ["income", "outstanding_amount", "contacts_last_7d", "rpc_last_30d", "promises_last_30d",
            "payments_amount_last_30d"]
CAT_COLS = ["region", "product_type", "dpd_bucket"]
LABEL = "target_paid_30d"
MISSING = "missing"


def time_split(df: DataFrame, train: tuple[str, str], validation: tuple[str, str], col: str = "snapshot_date"):
    """M1: two inclusive date ranges (bounds at midnight, like comparing with date strings)."""
    def rng(lo, hi):
        return df.where(F.col(col).between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")))

    return rng(*train), rng(*validation)


# -- preprocessing as Spark ML estimators (fit on train, SQL transformers as fitted models) -------------------


class _ColsParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to transform", typeConverter=TypeConverters.toListString)

    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))

    def cols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


def _replace_sql(df_cols: Sequence[str], exprs: dict[str, str]) -> str:
    sel = ", ".join(f"{exprs[c]} AS `{c}`" if c in exprs else f"`{c}`" for c in df_cols)
    return f"SELECT {sel} FROM __THIS__"


def _literal(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


class ExactMedianImputer(Estimator, _ColsParams):
    """M2: fill NULLs with the exact train median (numeric columns, in place)."""

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        cols = self.cols()
        med = column_medians(dataset, cols)
        exprs = {c: f"coalesce(CAST(`{c}` AS DOUBLE), {_literal(med[c])})" for c in cols}
        return SQLTransformer(statement=_replace_sql(dataset.columns, exprs))


class PopulationScaler(Estimator, _ColsParams):
    """M3: ``(x - mean) / std_pop`` with train statistics; zero variance divides by 1."""

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        cols = self.cols()
        row = dataset.agg(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
        ).first()
        exprs = {}
        for i, c in enumerate(cols):
            sd = row[f"s_{i}"] or 0.0
            exprs[c] = f"(CAST(`{c}` AS DOUBLE) - {_literal(row[f'm_{i}'])}) / {_literal(sd if sd != 0 else 1.0)}"
        return SQLTransformer(statement=_replace_sql(dataset.columns, exprs))


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of ``cols`` — one distributed pass over the long form; returns one number per
    column (the only thing collected)."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols]))
        .alias("kv")
    ).select("kv.column_name", "kv.v")
    rows = exact_quantiles(long, "v", [0.5], by=["column_name"]).collect()
    return {r["column_name"]: r["value"] for r in rows}


def fill_categories(df: DataFrame, cols: Sequence[str] = CAT_COLS) -> DataFrame:
    """Categorical NULLs → ``"missing"``."""
    return df.fillna({c: MISSING for c in cols})


def one_hot_stages(cols: Sequence[str] = CAT_COLS) -> list:
    """M4: alphabetical train categories; unseen → the extra index, dropped by ``dropLast`` → zeros."""
    idx = StringIndexer(
        inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols], dropLast=True)
    return [idx, ohe]


def encoded_slots(encoded: DataFrame, keep: Sequence[str], cols: Sequence[str] = CAT_COLS) -> DataFrame:
    """M4 as rows: ``(keep..., column_name, category, slot, width)``, one for each non-zero slot of a one-hot
    vector; a vector of zeros gives one row with a NULL slot."""
    def vector(c: str):
        values = vector_to_array(f"{c}_ohe")
        slots = F.filter(F.transform(values, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
        return F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category"), slots.alias("slots"),
                        F.size(values).alias("width"))

    each = encoded.select(*keep, F.explode(F.array(*[vector(c) for c in cols])).alias("_v")).select(*keep, "_v.*")
    return each.select(*keep, "column_name", "category", F.explode_outer("slots").alias("slot"), "width")


def baseline_pipeline(n_train: int, num_cols=NUM_COLS, cat_cols=CAT_COLS, max_iter: int = 1000) -> Pipeline:
    """M6: impute + scale + one-hot + assembler + L2 logistic regression (``C = 1``)."""
    assembler = VectorAssembler(inputCols=[*num_cols, *[f"{c}_ohe" for c in cat_cols]], outputCol="features")
    lr = LogisticRegression(
        featuresCol="features", labelCol=LABEL, regParam=1.0 / n_train, elasticNetParam=0.0,
        standardization=False, fitIntercept=True, maxIter=max_iter, tol=1e-10,
    )
    return Pipeline(stages=[
        ExactMedianImputer(num_cols), PopulationScaler(num_cols), *one_hot_stages(cat_cols), assembler, lr,
    ])


def positive_probability(model, df: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Apply a fitted model, keep the class-1 probability."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("proba"))


def handmade_fit(train: DataFrame, num_cols=NUM_COLS, cat_cols=CAT_COLS):
    """M2-M5 as explicit DataFrame steps (the "by hand" path): ``(fitted regression, encode)``, where
    ``encode`` applies the train statistics to another frame."""
    train = fill_categories(train, cat_cols)
    imputer = ExactMedianImputer(num_cols).fit(train)
    tr = imputer.transform(train)
    scaler = PopulationScaler(num_cols).fit(tr)
    tr = scaler.transform(tr)
    enc = Pipeline(stages=one_hot_stages(cat_cols)).fit(tr)
    assembler = VectorAssembler(inputCols=[*num_cols, *[f"{c}_ohe" for c in cat_cols]], outputCol="features")

    def encode(df: DataFrame) -> DataFrame:
        return assembler.transform(enc.transform(scaler.transform(imputer.transform(fill_categories(df, cat_cols)))))

    lr = LogisticRegression(
        featuresCol="features", labelCol=LABEL, regParam=1.0 / tr.count(), elasticNetParam=0.0,
        standardization=False, fitIntercept=True, maxIter=1000, tol=1e-10,
    ).fit(assembler.transform(enc.transform(tr)))
    return lr, encode


def handmade_baseline(train: DataFrame, validation: DataFrame, num_cols=NUM_COLS, cat_cols=CAT_COLS) -> DataFrame:
    """M2-M5 by hand; returns validation probabilities."""
    lr, encode = handmade_fit(train, num_cols, cat_cols)
    return positive_probability(lr, encode(validation))


def penalised_gradient(scored: DataFrame, regression, label: str = LABEL) -> DataFrame:
    """Gradient of the ``C = 1`` objective (sum of log-losses + half the squared weights, intercept free) at a
    fitted regression: ``(slot, gradient)``, slot -1 for the intercept. Zero everywhere at the optimum.

    One aggregate over emitted features and probabilities; rows leave a task as one sum per slot.
    """
    p = vector_to_array("probability")[1]
    features = F.array_append(vector_to_array("features"), F.lit(1.0))
    each = scored.select((p - F.col(label)).alias("_r"), F.posexplode(features).alias("slot", "_x"))
    sums = each.groupBy("slot").agg(F.sum(F.col("_r") * F.col("_x")).alias("_g"))
    weights = [*map(float, regression.coefficients.toArray()), 0.0]  # as many numbers as features
    return sums.select(
        F.when(F.col("slot") == len(weights) - 1, -1).otherwise(F.col("slot")).alias("slot"),
        (F.col("_g") + F.element_at(F.array(*map(F.lit, weights)), F.col("slot") + 1)).alias("gradient"))


def emitted_score_error(scored: DataFrame, regression) -> DataFrame:
    """Largest difference between the emitted probability and the logistic function of features and weights."""
    weights = F.array(*map(F.lit, map(float, regression.coefficients.toArray())))
    products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    margin = F.aggregate(products, F.lit(float(regression.intercept)), lambda acc, x: acc + x)
    p = vector_to_array("probability")[1]
    return scored.agg(F.max(F.abs(p - 1 / (1 + F.exp(-margin)))).alias("largest_score_error"))


def fit_pipeline(train: DataFrame, num_cols=NUM_COLS, cat_cols=CAT_COLS) -> PipelineModel:
    train = fill_categories(train, cat_cols)
    return baseline_pipeline(train.count(), num_cols, cat_cols).fit(train)


def staged_losses(model, df: DataFrame, label: str = LABEL) -> DataFrame:
    """Mean log-loss of a boosted model after each of its trees: ``(trees, loss)``, in one pass.

    The model emits the leaf that each tree sends a row to; a leaf's output is looked up in an array and added
    once to the row's running margin. Losses leave a task as one sum per tree.
    """
    outputs = [[float(x) for x in re.findall(r"Predict: (\S+)", tree)]  # leaves in the order of their indices
               for tree in re.split(r"\n  Tree \d+ ", model.toDebugString)[1:]]
    values = F.array(*[F.array(*[F.lit(w * x) for x in leaves]) for w, leaves in zip(model.treeWeights, outputs)])
    leaves = vector_to_array(F.col("_leaves"))
    steps = F.transform(leaves, lambda leaf, i: F.element_at(F.element_at(F.col("_values"), i + 1), leaf.cast("int") + 1))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("seen"))
    margins = F.aggregate(steps, start, lambda acc, x: F.struct(
        (acc["sum"] + x).alias("sum"), F.array_append(acc["seen"], acc["sum"] + x).alias("seen")))["seen"]
    sign = F.lit(2.0) * F.col(label) - 1.0
    located = model.copy().setLeafCol("_leaves").transform(df).withColumn("_values", values)
    each = located.select(sign.alias("_y"), F.posexplode(margins).alias("_i", "_f"))
    return each.groupBy((F.col("_i") + 1).alias("trees")).agg(
        F.avg(2 * F.log1p(F.exp(-2 * F.col("_y") * F.col("_f")))).alias("loss"))


def first_trees(model, n: int):
    """A boosted model of the first ``n`` trees of ``model``."""
    jvm = model._java_obj.getClass().getClassLoader()  # the session's JVM holds the trees; none is refitted
    spark = SparkSession.active()
    tree_class = spark._jvm.java.lang.Class.forName(
        "org.apache.spark.ml.regression.DecisionTreeRegressionModel", True, jvm)
    trees = spark._jvm.java.lang.reflect.Array.newInstance(tree_class, n)
    weights = spark.sparkContext._gateway.new_array(spark._jvm.double, n)
    for i in range(n):
        spark._jvm.java.lang.reflect.Array.set(trees, i, model._java_obj.trees()[i])
        weights[i] = model.treeWeights[i]
    java = spark._jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights)
    return GBTClassificationModel(model._java_obj.copyValues(java, model._java_obj.extractParamMap()))


def boosted_trees(
    train: DataFrame,
    validation: DataFrame,
    num_cols=NUM_COLS,
    cat_cols=CAT_COLS,
    max_iter: int = 2000,
    step_size: float = 0.03,
    max_depth: int = 5,
    patience: int = 50,
    first_chunk: int | None = None,
    seed: int = 81,
):
    """M7: GBT with patience-based early stopping on the validation log-loss.

    The losses after every tree come from one scoring pass (:func:`staged_losses`), and the model kept is the
    first trees of the fit that settled it: nothing is refitted for the best count. Only if the best
    count is less than ``patience`` rounds behind the last one is a longer model grown (Spark GBT is
    deterministic without subsampling, so it begins with the same trees).
    Returns ``(fitted pipeline model, best iteration count)``.
    """
    train, validation = fill_categories(train, cat_cols), fill_categories(validation, cat_cols)
    imputer = ExactMedianImputer(num_cols).fit(train)
    idx = StringIndexer(
        inputCols=list(cat_cols), outputCols=[f"{c}_idx" for c in cat_cols],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    assembler = VectorAssembler(inputCols=[*num_cols, *[f"{c}_idx" for c in cat_cols]], outputCol="features")
    prep = Pipeline(stages=[imputer, idx, assembler]).fit(train)
    tr, va = prep.transform(train), prep.transform(validation)
    # a tree needs a bin for every category of a feature, and the index of unseen ones
    categories = max((len(labels) + 1 for labels in prep.stages[1].labelsArray), default=0)

    def gbt(n: int) -> GBTClassifier:
        return GBTClassifier(
            featuresCol="features", labelCol=LABEL, maxIter=n, stepSize=step_size, maxDepth=max_depth,
            maxBins=max(64, categories), seed=seed, lossType="logistic", subsamplingRate=1.0, featureSubsetStrategy="all",
        )

    n = min(first_chunk or patience + 1, max_iter)
    while True:
        model = gbt(n).fit(tr)
        best = staged_losses(model, va).orderBy("loss", "trees").first()  # as many rows as trees
        best = best["trees"] if best else n
        if n >= max_iter or n - best >= patience:
            break
        n = min(max_iter, n * 2)
    return PipelineModel(stages=[*prep.stages, first_trees(model, best)]), best


def feature_importance(model: PipelineModel, top: int = 10) -> list[tuple[str, float]]:
    """Importances of the last stage mapped to the assembler's input columns, sorted."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = assembler.getInputCols()
    imp = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(names, map(float, imp)), key=lambda t: (-t[1], t[0]))
    return ranked[:top]


def full_report(
    train: DataFrame, scores: DataFrame, models: dict[str, str], importances: Sequence[tuple[str, float]], trees: int,
    segments: Sequence[str] = ("dpd_bucket", "region"), id_col: str = "row_id",
) -> DataFrame:
    """``(section, key, metric, value)`` from ``scores`` (id, label, segments, one probability per model).

    Sections: ``rows`` per split, ``model`` (metrics of each model), ``segment`` (metrics of each model per
    segment value, key ``column=value/model``), ``importance`` (at most ten rows) and the number of trees kept.
    """
    names = ["roc_auc", "pr_auc", "precision_at"]

    def long(df: DataFrame, section: str, key) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
        return df.select(F.lit(section).alias("section"), key.alias("key"), rows.alias("_m")).select("section", "key", "_m.*")

    plain = scores.select(id_col, LABEL, *models.values())
    overall = long(binary_metrics(plain, LABEL, models, id_col), "model", F.col("model"))
    segment = F.explode(F.array(*[F.concat(F.lit(f"{s}="), F.coalesce(s, F.lit(MISSING))) for s in segments]))
    by_segment = binary_metrics(scores.select(id_col, LABEL, *models.values(), segment.alias("segment")), LABEL, models,
                                id_col, by=["segment"])
    by_segment = long(by_segment, "segment", F.concat_ws("/", "segment", "model"))
    rows = train.select(F.lit("train").alias("key")).unionAll(scores.select(F.lit("validation"))).groupBy("key").agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    rows = rows.select(F.lit("rows").alias("section"), "key", F.lit("rows").alias("metric"), "value")
    fixed = [("importance", name, "importance", value) for name, value in importances]
    fixed.append(("importance", "boosted", "trees", float(trees)))
    known = train.sparkSession.createDataFrame(fixed, "section string, key string, metric string, value double")
    return rows.unionByName(overall).unionByName(by_segment).unionByName(known)
