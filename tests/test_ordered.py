"""Distributed prefix sums, ranks, top fractions and exact quantiles against brute force."""

import math
import random

import numpy as np

from arrears.operators.ordered import exact_quantiles, global_rank, prefix_sums, top_fraction


def test_prefix_sums_match_cumsum(spark):
    rnd = random.Random(1)
    rows = [(g, i, rnd.randint(0, 9)) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.v_cum for r in prefix_sums(df, ["k"], ["v"], by=["g"], n_slices=7).collect()}
    for g in ("a", "b", None):
        acc = 0
        for gg, k, v in rows:
            if gg == g:
                acc += v
                assert got[(g, k)] == acc


def test_prefix_sums_descending(spark):
    df = spark.createDataFrame([(i, 1) for i in range(50)], "k int, v int")
    got = {r.k: r.v_cum for r in prefix_sums(df, [("k", "desc")], ["v"], n_slices=4).collect()}
    assert got[49] == 1 and got[0] == 50


def test_global_rank_total_order(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0.1, 0.2, 0.3])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = {r.id: r.rank for r in global_rank(df, [("s", "desc"), "id"], n_slices=5).collect()}
    expect = sorted(rows, key=lambda t: (-t[1], t[0]))
    assert [got[i] for i, _ in expect] == list(range(1, 301))


def test_top_fraction_floor_and_ties(spark):
    rows = [(i, 1.0 if i < 5 else 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, score double")
    # int(10 * 0.3) = 3 → the three smallest ids among the equal top scores
    got = sorted(r.row_id for r in top_fraction(df, "score", "row_id", 0.3).collect())
    assert got == [0, 1, 2]
    n = 546
    assert top_fraction(spark.createDataFrame([(i, float(i)) for i in range(n)], "row_id long, score double"),
                        "score", "row_id", 0.3).count() == int(n * 0.3)


def test_top_fraction_per_group(spark):
    rows = [(i, float(i), "x" if i % 2 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, score double, g string")
    got = top_fraction(df, "score", "row_id", 0.25, by=["g"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"x": 2, "y": 2}


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.5, 2.0, 3.25, 7.0, 10.0, None]) for _ in range(101)] + [4.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.prob: r.value for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    arr = np.array([v for v in vals if v is not None])
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        assert math.isclose(got[p], float(np.quantile(arr, p)), rel_tol=1e-12)


def test_exact_median_differs_from_approximate_imputer_case(spark):
    # trap T13: the exact median of 1,2,3,4,100 is 3
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    assert exact_quantiles(df, "v", [0.5]).collect()[0].value == 3.0


def test_top_fraction_puts_null_scores_last(spark):
    rows = [(0, 0.9, "x"), (1, None, "x"), (2, 0.5, "x"), (3, 0.4, "x"), (4, None, "y"), (5, None, "y"), (6, 0.1, "y"), (7, None, "y")]
    df = spark.createDataFrame(rows, "row_id long, score double, g string")
    assert [r.row_id for r in top_fraction(df.where("g = 'x'"), "score", "row_id", 0.25).collect()] == [0]
    assert sorted(r.row_id for r in top_fraction(df, "score", "row_id", 0.75, by=["g"]).collect()) == [0, 2, 3, 4, 5, 6]
    assert top_fraction(df, "score", "row_id", 0.1).count() == 0
    assert top_fraction(df.limit(0), "score", "row_id", 0.5).count() == 0


def test_top_fraction_orders_only_counts(spark):
    import re

    df = spark.createDataFrame([(i, float(i % 3), "wide" * 9) for i in range(90)], "row_id long, score double, payload string")
    out = top_fraction(df, "score", "row_id", 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"rangepartitioning.*payload", plan)
    assert sorted(r.row_id for r in out.collect()) == sorted(
        i for i, _ in sorted(((i, i % 3) for i in range(90)), key=lambda t: (-t[1], t[0]))[:45])
