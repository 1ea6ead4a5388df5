"""A/B test of an SMS text.

Metrics per segment × group and per group, uplift of the payment rate, and two tests on the 2×2
table (paid / not paid × control / treatment): the pooled two-proportion z-test and the χ² test with
Yates' continuity correction (trap T11; Spark's ``ChiSquareTest`` has no correction). p-values come
from :func:`arrears.functions.erfc`, evaluated in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.functions import erfc, round6

CONTROL, TREATMENT = "control", "treatment"


def _metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.countDistinct("customer_id").alias("customers_cnt"),
        round6(F.avg("delivered_flg")).alias("delivered_rate"),
        round6(F.avg("paid_7d_flg")).alias("payment_rate_7d"),
        round6(F.avg("paid_amount_7d")).alias("avg_paid_amount_per_customer_7d"),
    )


def segment_metrics(ab: DataFrame) -> DataFrame:
    """A26."""
    return _metrics(ab, ["segment", "group_name"])


def overall_metrics(ab: DataFrame) -> DataFrame:
    """A27."""
    return _metrics(ab, ["group_name"])


def pivot_metric(ab: DataFrame, metric: str = "paid_7d_flg", by: str = "segment") -> DataFrame:
    """Mean of ``metric`` per ``by`` with the groups as columns."""
    return ab.groupBy(by).pivot("group_name", [CONTROL, TREATMENT]).agg(round6(F.avg(metric)))


def ab_counts(ab: DataFrame) -> DataFrame:
    """Successes and non-NULL observations per arm, as one row."""
    def arm(g: str, what: str):
        flag = F.when(F.col("group_name") == g, F.col("paid_7d_flg"))
        return (F.sum(flag) if what == "s" else F.count(flag)).cast("bigint")

    return ab.agg(
        arm(CONTROL, "s").alias("success_control"),
        arm(CONTROL, "n").alias("n_control"),
        arm(TREATMENT, "s").alias("success_treatment"),
        arm(TREATMENT, "n").alias("n_treatment"),
    )


def uplift(ab: DataFrame) -> DataFrame:
    """Absolute and relative uplift of the payment rate (treatment vs control)."""
    return _uplift(ab_counts(ab))


def _uplift(c: DataFrame) -> DataFrame:
    pc = F.col("success_control") / F.col("n_control")
    pt = F.col("success_treatment") / F.col("n_treatment")
    return c.select(
        round6(pc).alias("control_rate"),
        round6(pt).alias("treatment_rate"),
        round6(pt - pc).alias("uplift_abs"),
        round6((pt - pc) / pc).alias("uplift_rel"),
    )


def two_proportion_z(ab: DataFrame) -> DataFrame:
    """Arm rates, pooled rate, standard error and z (one row)."""
    c = ab_counts(ab)
    sc, nc = F.col("success_control").cast("double"), F.col("n_control").cast("double")
    st, nt = F.col("success_treatment").cast("double"), F.col("n_treatment").cast("double")
    pool = (sc + st) / (nc + nt)
    se = F.sqrt(pool * (1 - pool) * (1 / nc + 1 / nt))
    return c.select(
        round6(sc / nc).alias("p_control"), round6(st / nt).alias("p_treatment"), round6(pool).alias("p_pool"),
        round6(se).alias("se"), round6((st / nt - sc / nc) / se).alias("z_stat"),
    )


def chi_square_2x2(ab: DataFrame) -> DataFrame:
    """Yates-corrected χ² of the 2×2 table with its degrees of freedom and expected counts."""
    c = ab_counts(ab)
    sc, nc = F.col("success_control").cast("double"), F.col("n_control").cast("double")
    st, nt = F.col("success_treatment").cast("double"), F.col("n_treatment").cast("double")
    total, paid, unpaid = nc + nt, sc + st, (nc - sc) + (nt - st)
    s = test_statistics(ab).select(F.struct("chi2_stat").alias("s")).scalar()
    return c.select(
        round6(s["chi2_stat"]).alias("chi2_stat"), F.lit(1).alias("dof"),
        round6(nc * paid / total).alias("expected_control_paid"),
        round6(nc * unpaid / total).alias("expected_control_unpaid"),
        round6(nt * paid / total).alias("expected_treatment_paid"),
        round6(nt * unpaid / total).alias("expected_treatment_unpaid"),
    )


def test_statistics(ab: DataFrame) -> DataFrame:
    """Z, χ² (Yates) and their two-sided p-values, unrounded, as one row."""
    return _statistics(ab_counts(ab))


def _statistics(c: DataFrame) -> DataFrame:
    sc, nc = F.col("success_control").cast("double"), F.col("n_control").cast("double")
    st, nt = F.col("success_treatment").cast("double"), F.col("n_treatment").cast("double")
    pc, pt = sc / nc, st / nt
    pool = (sc + st) / (nc + nt)
    z = (pt - pc) / F.sqrt(pool * (1 - pool) * (1 / nc + 1 / nt))
    total = nc + nt
    paid, unpaid = sc + st, (nc - sc) + (nt - st)
    cells = [(sc, nc, paid), (nc - sc, nc, unpaid), (st, nt, paid), (nt - st, nt, unpaid)]
    chi2 = None
    for observed, row, col in cells:
        expected = row * col / total
        dev = F.abs(observed - expected)
        term = F.pow(dev - F.least(F.lit(0.5), dev), 2) / expected
        chi2 = term if chi2 is None else chi2 + term
    return c.select(
        z.alias("z_stat"),
        erfc(F.abs(z) / F.lit(math.sqrt(2.0))).alias("p_value_z"),
        chi2.alias("chi2_stat"),
        erfc(F.sqrt(chi2 / 2)).alias("p_value_chi2"),
    )


def tests_table(ab: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per test — test_name, statistic, p_value (full precision) and is_significant at ``alpha``."""
    return _tests(test_statistics(ab), alpha)


def _tests(s: DataFrame, alpha: float) -> DataFrame:
    rows = s.selectExpr(
        "stack(2, 'z-test', z_stat, p_value_z, 'chi-square', chi2_stat, p_value_chi2) as (test_name, statistic, p_value)"
    )
    return rows.select(
        "test_name", "statistic", "p_value", (F.col("p_value") < F.lit(alpha)).alias("is_significant"),
    )


def full_report(ab: DataFrame, alpha: float = 0.05) -> DataFrame:
    """C5 in long form, ``(section, key, metric, value)``: A26 (``segment``, key ``segment/group``), A27
    (``group``), E2 (``counts``), E1 (``uplift``) and E6 (``z-test``, ``chi-square``; significance as 0 / 1).

    One grouping-sets aggregate gives the segment and group rows with the counts of each arm; the tests
    are arithmetic on its group rows. The input is read at most twice (tables, counts).
    """
    measures = {"customers_cnt": F.countDistinct("customer_id").cast("double"), "delivered_rate": F.avg("delivered_flg"),
                "payment_rate_7d": F.avg("paid_7d_flg"), "avg_paid_amount_per_customer_7d": F.avg("paid_amount_7d"),
                "paid": F.sum("paid_7d_flg").cast("double"), "observed": F.count("paid_7d_flg").cast("double")}
    cells = ab.groupingSets([["segment", "group_name"], ["group_name"]], "segment", "group_name").agg(
        F.grouping("segment").alias("all_segments"), *[v.cast("double").alias(k) for k, v in measures.items()])
    key = F.when(F.col("all_segments") == 1, F.col("group_name")).otherwise(F.concat_ws("/", "segment", "group_name"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in measures]))
    section = F.when(F.col("all_segments") == 1, "group").otherwise("segment")
    tables = cells.select(section.alias("section"), key.alias("key"), pairs.alias("_m")).select("section", "key", "_m.*")

    def arm(g: str, what: str):
        return F.max(F.when((F.col("all_segments") == 1) & (F.col("group_name") == g), F.col(what)))

    counts = cells.agg(arm(CONTROL, "paid").alias("success_control"), arm(CONTROL, "observed").alias("n_control"),
                       arm(TREATMENT, "paid").alias("success_treatment"), arm(TREATMENT, "observed").alias("n_treatment"))

    def row(one: DataFrame, section: str, names: list[str], key: str = "all") -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
        return one.select(F.lit(section).alias("section"), F.lit(key).alias("key"), rows.alias("_m")).select("section", "key", "_m.*")

    tests = _tests(_statistics(counts), alpha).withColumn("significant", F.col("is_significant").cast("int"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                               for n in ("statistic", "p_value", "significant")]))
    tests = tests.select(F.col("test_name").alias("section"), F.lit("all").alias("key"), rows.alias("_m")).select("section", "key", "_m.*")
    return (tables.unionByName(row(counts, "counts", counts.columns))
            .unionByName(row(_uplift(counts), "uplift", ["control_rate", "treatment_rate", "uplift_abs", "uplift_rel"]))
            .unionByName(tests))
