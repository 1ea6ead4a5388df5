"""ROC-AUC, average precision and precision@k against brute-force definitions."""

import random

from arrears.operators import ranking as rk


def _auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap(y, s):
    P = sum(y)
    out = 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        n_at = sum(1 for b in s if b >= t)
        pos_here = sum(1 for a, b in zip(y, s) if b == t and a == 1)
        out += pos_here / P * tp / n_at
    return out


def test_metrics_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random() < 0.4, round(rnd.random(), 1), "s1" if i % 3 else "s2") for i in range(240)]
    df = spark.createDataFrame([(i, int(y), s, g) for i, y, s, g in rows], "row_id long, y int, p double, g string")
    m = rk.binary_metrics(df, "y", {"m": "p"}, "row_id").collect()[0]
    y = [int(r[1]) for r in rows]
    s = [r[2] for r in rows]
    assert abs(m.roc_auc - round(_auc(y, s), 6)) < 1e-9
    assert abs(m.pr_auc - round(_ap(y, s), 6)) < 1e-9
    order = sorted(range(len(rows)), key=lambda i: (-s[i], i))[: int(len(rows) * 0.3)]
    assert abs(m.precision_at - round(sum(y[i] for i in order) / len(order), 6)) < 1e-9
    seg = {r.segment: r for r in rk.segment_metrics(df, "y", {"m": "p"}, "row_id", ["g"]).collect()}
    idx = [i for i in range(len(rows)) if rows[i][3] == "s2"]
    assert abs(seg["s2"].roc_auc_m - round(_auc([y[i] for i in idx], [s[i] for i in idx]), 6)) < 1e-9


def test_average_precision_is_step_sum_not_interpolated(spark):
    # trap T18 toy set: sklearn's AP = 0.8333…, trapezoid area would differ
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.4), (2, 1, 0.35), (3, 1, 0.8)], "row_id long, y int, p double")
    m = rk.binary_metrics(df, "y", {"m": "p"}, "row_id").collect()[0]
    assert m.pr_auc == round(0.5 * 1.0 + 0.5 * (2 / 3), 6)
    assert m.roc_auc == 0.75


def test_one_class_segment_and_null_scores(spark):
    rows = [(i, int(i % 3 == 0), None if i % 5 == 0 else i / 10, "mixed") for i in range(40)]
    rows += [(100 + i, 0, i / 10, "no positives") for i in range(7)] + [(200 + i, 1, i / 10, "no negatives") for i in range(7)]
    df = spark.createDataFrame(rows, "row_id long, y int, p double, g string")
    seg = {r.segment: r for r in rk.segment_metrics(df, "y", {"m": "p"}, "row_id", ["g"]).collect()}
    assert seg["no positives"].roc_auc_m is None and seg["no positives"].pr_auc_m is None
    assert seg["no positives"].p30_m == 0.0
    assert seg["no negatives"].roc_auc_m is None and seg["no negatives"].pr_auc_m == 1.0 and seg["no negatives"].p30_m == 1.0
    y = [r[1] for r in rows[:40]]
    s = [-1.0 if r[2] is None else r[2] for r in rows[:40]]
    assert abs(seg["mixed"].roc_auc_m - round(_auc(y, s), 6)) < 1e-9
    order = sorted(range(40), key=lambda i: (-s[i], i))[:12]
    assert abs(seg["mixed"].p30_m - round(sum(y[i] for i in order) / 12, 6)) < 1e-9
