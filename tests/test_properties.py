"""Property tests: the day-binned interval join equals the naive range join on random inputs."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from arrears import schemas as S
from arrears.plans import strategy as sm

BASE = dt.date(2026, 2, 1)

case_rows = st.lists(
    st.tuples(st.integers(0, 6), st.integers(0, 3), st.integers(-3, 30), st.sampled_from(["a", "b"])),
    min_size=1, max_size=12,
)
pay_rows = st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 40), st.integers(0, 23), st.integers(-50, 200)), max_size=25)


def _naive(cases, pays, start, end, days):
    out = {}
    for cid, acc, off, strat in cases:
        s = BASE + dt.timedelta(days=off)
        if not (start <= s <= end):
            continue
        for pacc, poff, _h, amt in pays:
            d = BASE + dt.timedelta(days=poff)
            if pacc == acc and amt > 0 and s <= d <= s + dt.timedelta(days=days - 1):
                ids, tot = out.setdefault(strat, (set(), 0))
                ids.add(cid)
                out[strat] = (ids, tot + amt)
    return {k: (len(v[0]), float(v[1])) for k, v in out.items()}


@settings(max_examples=12, deadline=None)
@given(cases=case_rows, pays=pay_rows, days=st.sampled_from([1, 7, 14]))
def test_paid_by_strategy_equals_naive(spark, cases, pays, days):
    cdf = spark.createDataFrame(
        [(cid, acc, acc, BASE + dt.timedelta(days=off), strat, "1-30") for cid, acc, off, strat in cases],
        S.COLLECTION_CASES,
    )
    from decimal import Decimal

    pdf = spark.createDataFrame(
        [(i, acc, dt.datetime.combine(BASE + dt.timedelta(days=off), dt.time(h)), Decimal(amt).quantize(Decimal("0.01")))
         for i, (acc, off, h, amt) in enumerate(pays)],
        S.PAYMENTS,
    )
    start, end = BASE, BASE + dt.timedelta(days=27)
    got = sm.paid_by_strategy(cdf, pdf, start.isoformat(), end.isoformat(), days).collect()
    got = {r.strategy_name: (r[f"paid_cases_{days}d"], float(r[f"collected_amount_{days}d"])) for r in got}
    assert got == _naive(cases, pays, start, end, days)


action_rows = st.lists(
    st.tuples(st.integers(0, 3), st.integers(-40, 12), st.integers(0, 86399),
              st.sampled_from(["call", "sms", "promise", "payment", "other"]), st.integers(0, 500)),
    max_size=40,
)


def _naive_mart(snaps, actions):
    import math

    out = {}
    for cust, snap in snaps:
        past = [a for a in actions if a[0] == cust and a[1] < snap]
        in7 = [a for a in past if a[1] >= snap - dt.timedelta(days=7)]
        in30 = [a for a in past if a[1] >= snap - dt.timedelta(days=30)]
        pays = [a[1] for a in past if a[2] == "payment"]
        days = math.floor((snap - max(pays)).total_seconds() / 86400) if pays else None
        out[(cust, snap)] = (
            sum(a[2] == "call" for a in in7), sum(a[2] == "sms" for a in in7),
            sum(a[2] == "promise" for a in in30),
            round(float(sum(a[3] for a in in30 if a[2] == "promise")), 6),
            round(float(sum(a[3] for a in in30 if a[2] == "payment")), 6), days,
        )
    return out


@settings(max_examples=10, deadline=None)
@given(acts=action_rows)
def test_feature_mart_equals_naive(spark, acts):
    from arrears.plans import feature_mart as fm

    day0 = dt.datetime(2024, 1, 1)
    snaps = [(c, day0 + dt.timedelta(days=k)) for c in range(4) for k in (0, 5, 10)]
    actions = [(c, day0 + dt.timedelta(days=d, seconds=s), t, float(v) if t in ("promise", "payment") else 0.0)
               for c, d, s, t, v in acts]
    sdf = spark.createDataFrame([(c, s, 1, 1.0) for c, s in snaps], S.DAILY_SNAPSHOT)
    adf = spark.createDataFrame(actions, S.ACTIONS_LOG)
    got = {
        (r.customer_id, r.snapshot_date): (r.calls_last_7d, r.sms_last_7d, r.promises_last_30d,
                                           r.promised_amount_last_30d, r.payments_amount_last_30d,
                                           r.days_since_last_payment)
        for r in fm.feature_mart(sdf, adf).collect()
    }
    assert got == _naive_mart(snaps, actions)


c4_cases = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10), st.sampled_from(["1-30", "90+", "odd"])),
                    min_size=1, max_size=8)
c4_contacts = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(-2, 9), st.sampled_from([0, 3600, 86399])),
                       max_size=20)
c4_pays = st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 9), st.sampled_from([0, 60, 43200]), st.integers(-20, 90)),
                   max_size=20)


def _naive_summary(cases, contacts, pays):
    day0 = dt.datetime(2026, 1, 1)
    latest = {}
    for eid, cid, d, s in contacts:  # keep the latest time per event id; ties → larger case id
        t = day0 + dt.timedelta(days=d, seconds=s)
        if eid not in latest or (t, cid) > latest[eid]:
            latest[eid] = (t, cid)
    out = {}
    for bucket in {b for _, _, b in cases}:
        rows = [(i, acc, day0 + dt.timedelta(days=sd)) for i, (acc, sd, b) in enumerate(cases) if b == bucket]
        win = lambda t, s: s <= t <= s + dt.timedelta(days=6)
        contacted = {i for i, _, s in rows for t, cid in latest.values() if cid == i and win(t, s)}
        paid, amount = set(), 0.0
        for i, acc, s in rows:
            for pacc, d, sec, amt in pays:
                t = day0 + dt.timedelta(days=d, seconds=sec)
                if pacc == acc and amt > 0 and win(t, s):
                    paid.add(i)
                    amount += amt
        known = bucket if bucket in ("1-30", "31-60", "61-90", "90+") else None
        avg = round(amount / len(paid), 6) if paid else 0.0
        out[known] = (len(rows), len(contacted), len(paid), amount, avg)
    return out


@settings(max_examples=10, deadline=None)
@given(cases=c4_cases, contacts=c4_contacts, pays=c4_pays)
def test_bucket_summary_equals_naive(spark, cases, contacts, pays):
    from decimal import Decimal

    from arrears.plans import bucket_summary as bs

    day0 = dt.datetime(2026, 1, 1)
    cdf = spark.createDataFrame(
        [(i, acc, acc, day0 + dt.timedelta(days=sd), b, "m", Decimal("1.00")) for i, (acc, sd, b) in enumerate(cases)],
        S.CASES,
    )
    kdf = spark.createDataFrame(
        [(eid, cid, day0 + dt.timedelta(days=d, seconds=s), "call", "RPC") for eid, cid, d, s in contacts], S.CONTACTS
    )
    pdf = spark.createDataFrame(
        [(n, acc, day0 + dt.timedelta(days=d, seconds=sec), Decimal(amt).quantize(Decimal("0.01")))
         for n, (acc, d, sec, amt) in enumerate(pays)],
        S.PAYMENTS,
    )
    got = {
        r.dpd_bucket: (r.total_cases, r.contacted_cases_7d, r.paid_cases_7d, r.collected_amount_7d,
                       r.avg_payment_per_paid_case_7d)
        for r in bs.collection_summary(*bs.preprocess(cdf, kdf, pdf)).collect()
    }
    assert got == _naive_summary(cases, contacts, pays)
