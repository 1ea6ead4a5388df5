"""Day-binned interval joins equal the naive range join (T1) and never pair outside the window."""

import random


from arrears.plans import strategy as st
from tests.helpers import accounts, cases, contacts, payments


def _naive_contacted(cs, ev, days):
    out = {}
    for c, a, s, strat, b in cs:
        for e, cid, t, *_ in ev:
            if cid == c and s <= t[:10] <= _plus(s, days - 1):
                out.setdefault(strat, set()).add(c)
    return {k: len(v) for k, v in out.items()}


def _plus(date_str, n):
    import datetime as dt

    return (dt.date.fromisoformat(date_str) + dt.timedelta(days=n)).isoformat()


def test_date_window_counts_day_six_fully(spark):
    # SQL rule: the whole of day +6 counts (trap T1)
    cs = [(1, 10, "2026-02-01", "mixed", "1-30")]
    ev = [(1, 1, "2026-02-07 23:59:00", "call", "RPC", None, None)]
    got = st.contacted_by_strategy(cases(spark, cs), contacts(spark, ev), "2026-02-01", "2026-02-28").collect()
    assert [(r.strategy_name, r.contacted_cases_7d) for r in got] == [("mixed", 1)]
    ev2 = [(1, 1, "2026-02-08 00:00:00", "call", "RPC", None, None)]
    assert st.contacted_by_strategy(cases(spark, cs), contacts(spark, ev2), "2026-02-01", "2026-02-28").count() == 0


def test_random_contacts_match_naive(spark):
    rnd = random.Random(7)
    cs = [(i, i % 5, f"2026-02-{rnd.randint(1, 28):02d}", rnd.choice(["a", "b"]), "1-30") for i in range(60)]
    ev = []
    for e in range(400):
        c = rnd.randrange(70)  # some contacts of unknown cases
        day = rnd.randint(-3, 40)
        t = f"{_plus('2026-01-28', day)} {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00"
        ev.append((e, c, t, "sms", "RPC", None, None))
    got = st.contacted_by_strategy(cases(spark, cs), contacts(spark, ev), "2026-02-01", "2026-02-28").collect()
    assert {r.strategy_name: r.contacted_cases_7d for r in got} == _naive_contacted(cs, ev, 7)


def test_payment_attributed_to_every_case_of_account(spark):
    # payments hang on the account: one payment counts for both cases whose windows cover it
    cs = [(1, 10, "2026-02-01", "mixed", "1-30"), (2, 10, "2026-02-03", "mixed", "1-30")]
    ps = [(1, 10, "2026-02-04 10:00:00", 100.0), (2, 10, "2026-02-04 11:00:00", -5.0), (3, 11, "2026-02-04 10:00:00", 7.0)]
    acc = accounts(spark, [(10, 1000.0, "x", "r")])
    out = st.strategy_effectiveness(cases(spark, cs), acc, contacts(spark, []), payments(spark, ps), "2026-02-01", "2026-02-28")
    r = out.collect()[0]
    assert (r.total_cases, r.paid_cases_7d, r.collected_amount_7d) == (2, 2, 200.0)
    assert r.contacted_cases_7d is None  # no contacts → NULL, not 0 (T19)
    assert r.collection_rate_7d == round(200.0 / 2000.0, 6)


def test_orphan_case_counts_as_paid_but_not_in_total(spark):
    # Cases without an account vanish from total_cases only
    cs = [(1, 10, "2026-02-01", "mixed", "1-30"), (2, 99, "2026-02-01", "mixed", "1-30")]
    ps = [(1, 99, "2026-02-02 10:00:00", 50.0)]
    acc = accounts(spark, [(10, 1000.0, "x", "r")])
    r = st.strategy_effectiveness(cases(spark, cs), acc, contacts(spark, []), payments(spark, ps), "2026-02-01", "2026-02-28").collect()[0]
    assert (r.total_cases, r.paid_cases_7d) == (1, 1)


def test_period_prefilter_keeps_edge_days(spark):
    cs = [(1, 10, "2026-02-28", "mixed", "1-30")]
    ps = [(1, 10, "2026-03-06 23:00:00", 10.0), (2, 10, "2026-03-07 00:00:00", 10.0)]
    hits = st.payments_in_window(cases(spark, cs), payments(spark, ps), "2026-02-01", "2026-02-28")
    assert sorted(r.payment_id for r in hits.collect()) == [1]


def test_window_join_plan_is_equi_join(spark):
    cs = [(1, 10, "2026-02-01", "mixed", "1-30")]
    ps = [(1, 10, "2026-02-02 10:00:00", 10.0)]
    df = st.paid_by_strategy(cases(spark, cs), payments(spark, ps), "2026-02-01", "2026-02-28")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
