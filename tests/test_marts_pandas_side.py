"""C4 (timestamp window, dedupe, unknown bucket, D2 validation) and C6/C7 (point in time)."""

import warnings

import pytest

from arrears import schemas as S
from arrears.plans import bucket_summary as bs
from arrears.plans import feature_mart as fm
from tests.helpers import money, ts


def _cases(spark, rows):
    return spark.createDataFrame(
        [(c, a, a, ts(s), b, "mixed", money(1000)) for c, a, s, b in rows], S.CASES
    )


def test_timestamp_window_excludes_after_midnight_of_day_six(spark):
    cases = _cases(spark, [(1, 10, "2026-01-01 00:00:00", "1-30"), (2, 11, "2026-01-01 00:00:00", "weird")])
    contacts = spark.createDataFrame(
        [(1, 1, ts("2026-01-07 00:00:00"), "call", "RPC"), (2, 2, ts("2026-01-07 00:00:01"), "call", "RPC")], S.CONTACTS
    )
    pays = spark.createDataFrame(
        [(1, 10, ts("2026-01-07 00:00:01"), money(5)), (2, 11, ts("2026-01-06 23:59:59"), money(7)),
         (3, 11, ts("2026-01-03 00:00:00"), money(-1))],
        S.PAYMENTS,
    )
    out = bs.build_collection_summary(cases, contacts, pays).collect()
    assert [r.dpd_bucket for r in out] == ["1-30", None]  # unknown bucket → NULL, sorted last (T6)
    r0, r1 = out
    assert (r0.contacted_cases_7d, r0.paid_cases_7d, r0.collected_amount_7d, r0.avg_payment_per_paid_case_7d) == (1, 0, 0.0, 0.0)
    assert (r1.contacted_cases_7d, r1.paid_cases_7d, r1.collected_amount_7d) == (0, 1, 7.0)


def test_dedupe_keeps_latest_contact(spark):
    cases = _cases(spark, [(1, 10, "2026-01-01 00:00:00", "1-30")])
    contacts = spark.createDataFrame(
        [(5, 1, ts("2026-01-02 00:00:00"), "call", "RPC"), (5, 1, ts("2026-01-20 00:00:00"), "call", "RPC")], S.CONTACTS
    )
    out = bs.build_collection_summary(cases, contacts, spark.createDataFrame([], S.PAYMENTS))
    assert out.collect()[0].contacted_cases_7d == 0  # the duplicate event keeps its later, out-of-window time


def test_empty_inputs(spark):
    empty_cases = spark.createDataFrame([], S.CASES)
    with pytest.raises(ValueError):
        bs.build_collection_summary(empty_cases, spark.createDataFrame([], S.CONTACTS), spark.createDataFrame([], S.PAYMENTS))
    cases = _cases(spark, [(1, 10, "2026-01-01 00:00:00", "1-30")])
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        out = bs.build_collection_summary(cases, spark.createDataFrame([], S.CONTACTS), spark.createDataFrame([], S.PAYMENTS))
        assert out.count() == 1
    assert any("contacts is empty" in str(x.message) for x in w)


def test_feature_mart_point_in_time(spark):
    snap = spark.createDataFrame([(1, ts("2024-01-10 00:00:00"), 5, 100.0), (2, ts("2024-01-10 00:00:00"), 1, 1.0)], S.DAILY_SNAPSHOT)
    acts = spark.createDataFrame(
        [
            (1, ts("2024-01-03 00:00:00"), "call", 0.0),  # exactly 7 days before → inside
            (1, ts("2024-01-02 23:59:59"), "call", 0.0),  # outside 7 d
            (1, ts("2024-01-09 23:00:00"), "sms", 0.0),
            (1, ts("2024-01-10 00:00:00"), "call", 0.0),  # on the snapshot → excluded (no leak)
            (1, ts("2023-12-11 00:00:00"), "promise", 50.0),  # exactly 30 days → inside
            (1, ts("2024-01-08 01:00:00"), "payment", 20.0),  # 1 d 23 h → 1 day since (T8)
            (1, ts("2023-11-01 00:00:00"), "payment", 9.0),  # outside 30 d, still the history
        ],
        S.ACTIONS_LOG,
    )
    out = {r.customer_id: r for r in fm.feature_mart(snap, acts).collect()}
    a, b = out[1], out[2]
    assert (a.calls_last_7d, a.sms_last_7d, a.promises_last_30d, a.promised_amount_last_30d) == (1, 1, 1, 50.0)
    assert (a.payments_amount_last_30d, a.days_since_last_payment) == (20.0, 1)
    assert (b.calls_last_7d, b.payments_amount_last_30d, b.days_since_last_payment) == (0, 0.0, None)
    top = fm.top_contacted_unpaid(fm.feature_mart(snap, acts)).collect()
    assert top == []  # customer 1 paid in the last 30 days, customer 2 had no contacts


def test_null_keys_match_like_pandas_merge(spark):
    # A payment with a NULL account matches a case with a NULL account; NULL case ids are not
    # counted as cases (nunique), but their payments add to the bucket amount
    cases = spark.createDataFrame(
        [(1, None, None, ts("2026-01-01 00:00:00"), "1-30", "m", money(1)),
         (None, 7, 7, ts("2026-01-01 00:00:00"), "1-30", "m", money(1))],
        S.CASES,
    )
    pays = spark.createDataFrame(
        [(1, None, ts("2026-01-02 00:00:00"), money(10)), (2, 7, ts("2026-01-02 00:00:00"), money(5))], S.PAYMENTS
    )
    out = bs.collection_summary(*bs.preprocess(cases, spark.createDataFrame([], S.CONTACTS), pays)).collect()[0]
    assert (out.total_cases, out.paid_cases_7d, out.collected_amount_7d) == (1, 1, 15.0)


def test_duplicate_snapshot_key_is_rejected(spark):
    # A repeated (customer_id, snapshot_date) would count actions twice
    snap = spark.createDataFrame([(1, ts("2024-01-10 00:00:00"), 5, 1.0)] * 2, S.DAILY_SNAPSHOT)
    acts = spark.createDataFrame([], S.ACTIONS_LOG)
    with pytest.raises(ValueError):
        fm.feature_mart(snap, acts, validate=True)


def test_bounds_with_no_anchors(spark):
    # the event-table bounds are NULL without anchors: everything is filtered, results stay empty
    from arrears.plans import last_contact as lc
    from arrears.plans import promise_funnel as pf

    empty_snap = spark.createDataFrame([], S.DAILY_SNAPSHOT)
    acts = spark.createDataFrame([(1, ts("2024-01-01 10:00:00"), "payment", 5.0)], S.ACTIONS_LOG)
    assert fm.feature_mart(empty_snap, acts).count() == 0
    cc = spark.createDataFrame([(1, 10, 10, ts("2026-03-02 00:00:00").date(), "m", "1-30")], S.COLLECTION_CASES)
    ev = spark.createDataFrame([], S.CONTACT_EVENTS)
    pays = spark.createDataFrame([(1, 10, ts("2026-03-03 00:00:00"), money(5))], S.PAYMENTS)
    assert lc.last_contact_payments(cc, ev, pays, "2026-03-01", "2026-03-31").count() == 0
    assert pf.kept_promises(cc, ev, pays, "2026-03-01", "2026-03-31").count() == 0
