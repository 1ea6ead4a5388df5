"""Histogram / PSI like numpy (T17), selection economics, KDE and score shift."""

import math
import random

import numpy as np

from arrears.plans import launch as ln


def test_histogram_matches_numpy_including_edges(spark):
    rnd = random.Random(11)
    vals = [round(rnd.uniform(0.2, 0.9), 3) for _ in range(500)] + [0.2, 0.9, 0.55]
    df = spark.createDataFrame([(v,) for v in vals], "score double")
    got = ln.histogram(df, "score", 10).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(vals), bins=np.linspace(min(vals), max(vals), 11))
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.bin_left for r in got] == edges[:-1].tolist()
    assert got[-1].bin_right == edges[-1]


def test_psi_drops_values_outside_train_range(spark):
    train = spark.createDataFrame([(v / 10,) for v in range(1, 11)], "score double")
    scoring = spark.createDataFrame([(0.05,), (0.15,), (0.95,), (1.5,)], "score double")
    bins = ln.psi_bins(train, scoring).orderBy("bin").collect()
    tr = np.histogram([v / 10 for v in range(1, 11)], bins=np.linspace(0.1, 1.0, 11))[0]
    sc = np.histogram([0.05, 0.15, 0.95, 1.5], bins=np.linspace(0.1, 1.0, 11))[0]
    t = np.where(tr / tr.sum() == 0, 1e-6, tr / tr.sum())
    s = np.where(sc / sc.sum() == 0, 1e-6, sc / sc.sum())
    assert [r.scoring_dist for r in bins] == s.tolist()
    psi = ln.psi(ln.psi_bins(train, scoring)).collect()[0].psi
    assert psi == round(float(np.sum((t - s) * np.log(t / s))), 6)


def test_strategy_comparison(spark):
    rows = [(i, 0.1 * i, i % 2, 100.0 * i, i % 3 == 0) for i in range(1, 9)]
    df = spark.createDataFrame(
        [(i, s, y, amt, int(cur)) for i, s, y, amt, cur in rows],
        "row_id long, score double, target_paid_30d int, recovered_amount_30d double, current_contact_flg int",
    )
    comp = {r.metric: r for r in ln.strategy_comparison(df, 0.25, 35.0).collect()}
    # top 2 by score: ids 8 (target 0) and 7 (target 1) → revenue 700
    assert comp["selected_customers"].new_strategy == 2.0 and comp["revenue"].new_strategy == 700.0
    assert comp["economic_effect"].new_strategy == 700.0 - 70.0
    # current: ids 3, 6 → revenue 300 (id 3), cost 70
    assert comp["economic_effect"].current_strategy == 230.0
    assert comp["economic_effect"].difference == 400.0


def test_kde_matches_direct_formula(spark):
    vals = [0.1, 0.2, 0.2, 0.5, 0.9]
    df = spark.createDataFrame([(v,) for v in vals], "score double")
    got = ln.score_density({"s": df}, points=11).orderBy("i").collect()
    a = np.array(vals)
    h = a.std(ddof=1) * len(a) ** (-0.2)
    r = a.max() - a.min()
    xs = np.linspace(a.min() - 0.5 * r, a.max() + 0.5 * r, 11)
    dens = [np.mean(np.exp(-0.5 * ((x - a) / h) ** 2) / (h * math.sqrt(2 * math.pi))) for x in xs]
    assert [row.density for row in got] == [round(float(v), 6) for v in dens]


def test_psi_quantile_bins_match_numpy(spark):
    rnd = random.Random(4)
    tr_vals = [round(rnd.random(), 3) for _ in range(400)]
    sc_vals = [round(rnd.random() ** 1.5, 3) for _ in range(300)]
    tr = spark.createDataFrame([(v,) for v in tr_vals], "score double")
    sc = spark.createDataFrame([(v,) for v in sc_vals], "score double")
    for n in (10, 20):
        got = ln.psi_bins(tr, sc, n_bins=n, method="quantile").orderBy("bin").collect()
        edges = np.quantile(np.array(tr_vals), np.linspace(0, 1, n + 1))
        t = np.histogram(tr_vals, bins=edges)[0]
        s = np.histogram(sc_vals, bins=edges)[0]
        assert [r.bin_left for r in got] == [float(e) for e in edges[:-1]] or np.allclose([r.bin_left for r in got], edges[:-1])
        t = np.where(t / t.sum() == 0, 1e-6, t / t.sum())
        s = np.where(s / s.sum() == 0, 1e-6, s / s.sum())
        assert np.allclose([r.train_dist for r in got], t) and np.allclose([r.scoring_dist for r in got], s)


def test_top_fraction_per_day_capacity(spark):
    import datetime as dt

    rows = [(i, float(i % 7), dt.datetime(2026, 1, 1 + i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, score double, snapshot_date timestamp_ntz")
    per_day = ln.select_top(df, 0.25, by=["snapshot_date"]).groupBy("snapshot_date").count().collect()
    assert sorted(r["count"] for r in per_day) == [5, 5]


def test_histogram_of_a_constant_column(spark):
    from arrears.plans import launch as ln

    df = spark.createDataFrame([(2.0,)] * 5 + [(None,)], "score double")
    want, edges = np.histogram([2.0] * 5, bins=4)
    got = sorted(ln.histogram(df, "score", 4).collect())
    assert [r["count"] for r in got] == want.tolist()
    assert np.allclose([r.bin_left for r in got] + [got[-1].bin_right], edges)


def test_psi_bins_of_constant_train_scores(spark):
    from arrears.plans import launch as ln

    train = spark.createDataFrame([(0.5,)] * 4, "score double")
    scoring = spark.createDataFrame([(0.5,), (0.7,)], "score double")
    got = sorted(ln.psi_bins(train, scoring, n_bins=5).collect())
    assert [r.train_dist for r in got][-1] == 1.0 and [r.scoring_dist for r in got][-1] == 1.0


def test_density_without_a_bandwidth_is_null(spark):
    from arrears.plans import launch as ln

    for rows in ([(0.5,)] * 3, [(0.5,)]):
        got = ln.score_density({"a": spark.createDataFrame(rows, "score double")}, points=10).collect()
        assert len(got) == 10 and all(r.density is None for r in got)


def test_binned_plans_read_their_input_few_times(spark):
    from arrears.plans import launch as ln

    train = spark.createDataFrame([(i / 10,) for i in range(30)], "score double")
    plan = ln.psi_bins(train, train.select((train.score + 0.1).alias("score")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 10  # two inputs, and copies of the range subquery


def test_full_report_agrees_with_its_parts_on_ties_and_nulls(spark):
    scores = [(i, None if i % 11 == 0 else round((i * 37 % 5) / 10, 2)) for i in range(200)]
    rows = spark.createDataFrame(
        [(i, s, i % 2, 10.0 + i, int(i % 3 == 0)) for i, s in scores],
        "row_id long, score double, target_paid_30d int, recovered_amount_30d double, current_contact_flg int")
    train = spark.createDataFrame([(round((i * 29 % 7) / 11, 3),) for i in range(150)], "score double")
    for fraction in (0.25, 0.5, 0.97, 0.001):
        got = {(r.section, r.key, r.metric): r.value for r in ln.full_report(train, rows, fraction).collect()}
        for r in ln.strategy_comparison(rows, fraction).collect():
            assert got["new", "all", r.metric] == r.new_strategy
            assert got["current", "all", r.metric] == r.current_strategy and got["difference", "all", r.metric] == r.difference
        t = ln.threshold(ln.select_top(rows, fraction)).first()
        assert got["selection", "all", "selected_customers"] == t.selected_customers
        if 0 < t.selected_customers <= 181:
            assert got["selection", "all", "threshold"] == t.threshold
    for r in ln.psi_bins(train, rows).collect():
        for c in ("bin_left", "bin_right", "train_dist", "scoring_dist"):
            assert abs(got["psi_bin", str(r.bin), c] - r[c]) < 1e-12
    for r in ln.score_shift(train, rows).collect():
        for c in ("mean", "std", "min", "max", "n"):
            assert abs(got["score_shift", r.dataset, c] - r[c]) < 1e-6
