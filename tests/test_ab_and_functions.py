"""A/B statistics (E1-E6, T11) and scalar helpers (erfc, ratios, floor days, bucket order)."""

import math


from arrears.functions import bucket_rank, erfc, floor_days_between, ratio, ratio_or_zero
from arrears.plans import ab_test as ab


def _ab(spark, sc, nc, st, nt):
    rows = []
    i = 0
    for g, s, n in (("control", sc, nc), ("treatment", st, nt)):
        for k in range(n):
            rows.append((i, g, "seg", 1, int(k < s), 10.0 if k < s else 0.0))
            i += 1
    return spark.createDataFrame(rows, "customer_id long, group_name string, segment string, delivered_flg int, paid_7d_flg int, paid_amount_7d double")


def test_z_and_yates_chi2(spark):
    sc, nc, st, nt = 179, 750, 218, 750
    s = ab.test_statistics(_ab(spark, sc, nc, st, nt)).collect()[0]
    pc, pt, p = sc / nc, st / nt, (sc + st) / (nc + nt)
    z = (pt - pc) / math.sqrt(p * (1 - p) * (1 / nc + 1 / nt))
    assert math.isclose(s.z_stat, z, rel_tol=1e-12)
    assert math.isclose(s.p_value_z, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)
    obs = [[sc, nc - sc], [st, nt - st]]
    rows, cols, tot = [nc, nt], [sc + st, nc + nt - sc - st], nc + nt
    chi2 = 0.0
    for i in range(2):
        for j in range(2):
            e = rows[i] * cols[j] / tot
            dev = abs(obs[i][j] - e)
            chi2 += (dev - min(0.5, dev)) ** 2 / e
    assert math.isclose(s.chi2_stat, chi2, rel_tol=1e-12)
    assert s.chi2_stat < z * z  # Yates shrinks the statistic (uncorrected χ² = z²)
    assert math.isclose(s.p_value_chi2, math.erfc(math.sqrt(chi2 / 2)), rel_tol=1e-9)
    tests = {r.test_name: r for r in ab.tests_table(_ab(spark, sc, nc, st, nt)).collect()}
    assert tests["z-test"].is_significant is True


def test_erfc_accuracy(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 3.0, 3.5, 5.0, 8.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc("x").alias("e")).collect()
    for r in got:
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=1e-9, abs_tol=1e-300)


def test_ratios_and_days(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0), (None, 2.0)], "a double, b double")
    r = df.select(ratio("a", "b").alias("r"), ratio_or_zero("a", "b").alias("z")).collect()
    assert [(x.r, x.z) for x in r] == [(None, 0.0), (0.333333, 0.333333), (None, 0.0)]
    t = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' s, timestamp_ntz'2024-01-01 01:00:00' p")
    assert t.select(floor_days_between("s", "p").alias("d")).collect()[0].d == 0  # 23 h → 0 (T8)


def test_unknown_bucket_rank_is_null(spark):
    df = spark.createDataFrame([("90+",), ("1-30",), ("weird",)], "b string")
    got = {r.b: r.k for r in df.select("b", bucket_rank("b").alias("k")).collect()}
    assert got == {"90+": 4, "1-30": 1, "weird": None}
