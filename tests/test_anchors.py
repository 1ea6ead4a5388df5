"""Last contact (C2, T3, T20), first promise and kept promises (C3, T4, T5), dedupe."""

from arrears.operators.anchors import latest_per_key
from arrears.plans import last_contact as lc
from arrears.plans import promise_funnel as pf
from tests.helpers import cases, contacts, payments, ts
from arrears import schemas as S


def test_last_contact_ties_collapse_and_double_payments(spark):
    cs = [(1, 10, "2026-03-02", "mixed", "1-30"), (2, 11, "2026-03-03", "soft_call", "1-30")]
    ev = [
        (1, 1, "2026-03-04 10:00:00", "call", "RPC", None, None),
        (2, 1, "2026-03-04 10:00:00", "call", "RPC", None, None),  # identical tie → one row, payments ×2
        (3, 1, "2026-03-02 09:00:00", "sms", "No answer", None, None),
        (4, 2, "2026-03-05 08:00:00", "sms", "RPC", None, None),
        (5, 2, "2026-03-05 08:00:00", "call", "Promise", None, None),  # different tie → two rows
    ]
    ps = [(1, 10, "2026-03-08 23:00:00", 30.0), (2, 10, "2026-03-09 00:00:00", 99.0), (3, 11, "2026-03-04 12:00:00", 5.0)]
    out = lc.last_contact_payments(cases(spark, cs), contacts(spark, ev), payments(spark, ps), "2026-03-01", "2026-03-31")
    rows = sorted((r.case_id, r.last_channel, r.payment_in_5d_flag, r.payment_amount_5d) for r in out.collect())
    # case 1: window days 03-04..03-08 → 30 counted twice; case 2: payment before the contact day → none
    assert rows == [(1, "call", 1, 60.0), (2, "call", 0, None), (2, "sms", 0, None)]


def test_case_without_contact_is_absent(spark):
    cs = [(1, 10, "2026-03-02", "mixed", "1-30")]
    out = lc.last_contact_payments(cases(spark, cs), contacts(spark, []), payments(spark, []), "2026-03-01", "2026-03-31")
    assert out.count() == 0


def test_kept_promise_semantics(spark):
    cs = [
        (1, 10, "2026-01-05", "mixed", "1-30"),  # promise 100 by 01-20, paid 60 (01-01) + 50 (01-20) → kept
        (2, 11, "2026-01-05", "mixed", "1-30"),  # promise with NULL date → not kept
        (3, 12, "2026-01-05", "mixed", "1-30"),  # amount 0 with date, one payment → kept
        (4, 13, "2026-01-05", "mixed", "1-30"),  # amount 0 with date, no payment → not kept
        (5, 14, "2026-01-05", "mixed", "1-30"),  # NULL amount → not kept
    ]
    ev = [
        (1, 1, "2026-01-06 10:00:00", "call", "Promise", "2026-01-20", 100.0),
        (2, 2, "2026-01-06 10:00:00", "call", "Promise", None, 10.0),
        (3, 3, "2026-01-06 10:00:00", "call", "Promise", "2026-01-20", 0.0),
        (4, 4, "2026-01-06 10:00:00", "call", "Promise", "2026-01-20", 0.0),
        (5, 5, "2026-01-06 10:00:00", "call", "Promise", "2026-01-20", None),
    ]
    ps = [
        (1, 10, "2025-12-01 10:00:00", 60.0),  # before the case even started: still counts (T5)
        (2, 10, "2026-01-20 22:00:00", 50.0),
        (3, 10, "2026-01-21 00:00:00", 500.0),  # after the promise date
        (4, 12, "2026-01-10 10:00:00", 1.0),
        (5, 14, "2026-01-10 10:00:00", 1.0),
    ]
    kept = pf.kept_promises(cases(spark, cs), contacts(spark, ev), payments(spark, ps), "2026-01-01", "2026-03-31")
    assert [r.kept_promise_cases for r in kept.collect()] == [2]


def test_first_promise_join_back_adds_same_instant_events(spark):
    # T4: an RPC event at the first-promise instant becomes an extra detail row
    cs = [(1, 10, "2026-01-05", "mixed", "1-30")]
    ev = [
        (1, 1, "2026-01-06 10:00:00", "call", "Promise", "2026-01-20", 100.0),
        (2, 1, "2026-01-06 10:00:00", "sms", "RPC", None, None),
    ]
    rows = pf.first_promise_details(cases(spark, cs), contacts(spark, ev), "2026-01-01", "2026-03-31").collect()
    assert len(rows) == 2


def test_promise_rate_can_exceed_one(spark):
    cs = [(1, 10, "2026-01-05", "mixed", "1-30"), (2, 11, "2026-01-05", "mixed", "1-30")]
    ev = [
        (1, 1, "2026-01-06 10:00:00", "call", "RPC", None, None),
        (2, 1, "2026-01-06 11:00:00", "call", "Promise", "2026-01-20", 10.0),
        (3, 2, "2026-01-06 11:00:00", "call", "Promise", "2026-01-20", 10.0),
    ]
    r = pf.promise_funnel(cases(spark, cs), contacts(spark, ev), payments(spark, []), "2026-01-01", "2026-03-31").collect()[0]
    assert (r.rpc_cases_7d, r.promise_cases_7d, r.promise_rate_from_rpc) == (1, 2, 2.0)
    assert r.kept_promise_cases is None and r.recovery_amount_14d is None  # T19: NULL, not 0
    assert str(r.week_start) == "2026-01-05"  # Monday


def test_week_start_is_monday(spark):
    from pyspark.sql import functions as F
    from arrears.functions import week_start

    r = spark.range(1).select(week_start(F.lit("2026-01-01").cast("date")).alias("w")).collect()[0]
    assert str(r.w) == "2025-12-29"


def test_latest_per_key_prefers_non_null_time_and_breaks_ties(spark):
    rows = [
        (1, 7, ts("2026-01-01 10:00:00"), "call", "RPC"),
        (1, 7, None, "sms", "RPC"),  # NULL time never wins over a real one (T7)
        (2, 8, ts("2026-01-01 10:00:00"), "call", "RPC"),
        (2, 8, ts("2026-01-01 10:00:00"), "sms", "RPC"),  # tie → largest remaining columns
        (3, 9, None, "call", "RPC"),
    ]
    df = spark.createDataFrame(rows, S.CONTACTS)
    out = {r.event_id: (r.event_dttm, r.channel) for r in latest_per_key(df, "event_id", "event_dttm", ["case_id", "channel", "contact_result"]).collect()}
    assert out == {1: (ts("2026-01-01 10:00:00"), "call"), 2: (ts("2026-01-01 10:00:00"), "sms"), 3: (None, "call")}


def test_first_row_per_key_order_and_ties(spark):
    from arrears.operators.anchors import first_row_per_key
    import datetime as dt

    rows = [
        (1, 3, dt.date(2024, 1, 9), "a"),
        (1, 3, dt.date(2024, 1, 5), "b"),  # same count, earlier date wins
        (1, 2, dt.date(2024, 1, 1), "c"),
        (2, 1, dt.date(2024, 1, 3), "d"),
    ]
    df = spark.createDataFrame(rows, "k long, n long, day date, tag string")
    got = {r.k: r.tag for r in first_row_per_key(df, "k", [("n", "desc"), ("day", "asc")]).collect()}
    assert got == {1: "b", 2: "d"}


def test_last_contact_rows_keep_copies_null_accounts_and_repeated_cases(spark):
    cs = cases(spark, [(1, 10, "2026-03-02", "s", "b"), (1, 11, "2025-01-01", "t", "b"), (2, None, "2026-03-03", "s", "b"),
                       (3, 10, "2026-04-09", "s", "b"), (4, 12, "2026-03-31", "s", "b")])
    ev = contacts(spark, [(1, 1, "2026-03-05 10:00", "call", "RPC", None, None)] * 2
                  + [(2, 1, "2026-03-04 10:00", "sms", "RPC", None, None), (3, 2, "2026-03-05 10:00", "sms", "RPC", None, None),
                     (4, 3, "2026-03-05 10:00", "call", "RPC", None, None), (5, 4, "2026-04-07 23:00", None, None, None, None)])
    pay = payments(spark, [(1, 10, "2026-03-05 00:00", 5), (2, 10, "2026-03-09 23:00", 7), (3, 10, "2026-03-10 00:00", 9),
                           (4, None, "2026-03-05 11:00", 3), (5, 11, "2026-03-06 11:00", 0), (6, 10, "2026-03-04 23:00", 2)])
    rows = lc.payments_after_last_contact_rows(cs, ev, pay, "2026-03-01", "2026-03-31")
    assert rows.columns == ["account_id", "case_id", "strategy_name", "last_contact_dttm", "last_channel", "last_contact_result",
                            "payment_id", "payment_dttm", "payment_amount"]
    got = sorted((r.case_id, r.account_id or 0, r.payment_id or 0) for r in rows.collect())
    assert got == [(1, 10, 1), (1, 10, 1), (1, 10, 2), (1, 10, 2), (1, 11, 0), (1, 11, 0), (2, 0, 0), (4, 12, 0)]
    c2 = lc.last_contact_payments(cs, ev, pay, "2026-03-01", "2026-03-31").collect()
    assert sorted((r.case_id, r.account_id or 0, r.payment_amount_5d or 0) for r in c2) == [
        (1, 10, 24.0), (1, 11, 0), (2, 0, 0), (4, 12, 0)]
    times = lc.last_contact_time(cs, ev, "2026-03-01", "2026-03-31").collect()
    assert sorted((r.case_id, r.last_contact_dttm.day) for r in times) == [(1, 5), (2, 5), (4, 7)]
