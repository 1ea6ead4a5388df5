"""Inputs are read once: scans of the executed plans (reused exchanges counted once), no checkpoint, no sort aggregate."""

import pytest

from arrears.catalog import QUERIES, load_all
from tests.conftest import SF001
from tests.helpers import operators, scans

load_all()
# contacts and payments are lineitem with orders each; cases are orders
ONE_READ = {"last_contact_time": (1, 2), "last_contact_lookup": (1, 3), "last_contact_payment_5d": (2, 5),
            "promise_funnel": (2, 3), "payments_until_date_left": (2, 3), "first_promise_lookup": (1, 2),
            "rpc_cases_by_week": (1, 2), "dedupe_keep_latest": (1, 1), "collection_summary": (2, 3)}


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("name", sorted(ONE_READ))
def test_events_are_read_once(spark, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = QUERIES[name](spark, SF001)
        found = scans(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # at most: a scan that stands below a reused subquery only is not met on the walk
    most_lineitems, most_orders = ONE_READ[name]
    assert 1 <= found.count("lineitem") <= most_lineitems
    assert found.count("orders") <= most_orders
    used = operators(df)
    assert "SortAggregateExec" not in used and not any("NestedLoop" in x or "Cartesian" in x for x in used)
    assert not any("ExistingRDD" in x or x == "RDDScanExec" for x in used)  # no checkpoint below


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("name", ["payments_after_anchor_left", "last_contact_payment_5d"])
def test_last_contacts_are_ranked_once_and_not_dealt_again(spark, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = QUERIES[name](spark, SF001)
        found = scans(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.count("lineitem") <= 2 and found.count("orders") <= 3
    used = operators(df)
    # ranked where the contacts meet their cases: at most a partial and a final limit, no semi join on the contacts before
    assert used.count("WindowGroupLimitExec") <= 2 and used.count("WindowExec") <= 2


def test_lines_are_narrow_before_they_meet_their_orders(spark):
    from arrears.sources.fixtures import inputs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inp = inputs(spark, SF001)
        for df, most in ((inp.payments.select("account_id", "payment_dttm", "payment_amount"), 3),
                         (inp.contact_events.select("case_id", "event_dttm", "channel"), 3)):
            df.collect()
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            widths = _join_sides(df._jdf.queryExecution().optimizedPlan())
            assert widths and max(widths) <= most, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["last_contact_payment_5d", "payments_after_anchor_left"])
def test_lines_meet_their_orders_as_numbers(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan()
        types = _line_types(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # no names and no intervals: those are made after the join
    assert types and all(t in ("bigint", "int", "tinyint") or t.startswith("decimal") for t in types), types


def test_hours_and_names_made_after_the_join(spark):
    """Negative and NULL keys, unknown flags: times, channels and results as the mapping gives them."""
    import datetime as dt

    from pyspark.sql import functions as F

    from arrears.sources.fixtures import Inputs

    noon = dt.datetime(1997, 3, 5, 12, 30)
    lines = [  # order, part, supplier, line, flag
        (1, 27, 3, 1, "A"), (1, 28, 4, 2, "N"), (1, -15, -26, 3, "R"), (1, None, 5, 4, "A"), (1, 29, None, 5, None),
        (1, 30, 6, 6, "X"), (None, 27, 3, 7, "A"),
    ]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string")
    lineitem = lineitem.select("*", F.lit(2.0).alias("l_quantity"), F.lit(10.25).alias("l_extendedprice"), F.lit("F").alias("l_linestatus"))
    orders = spark.createDataFrame([(1, 9, noon)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    inp = Inputs(spark, "unused", {"lineitem": lineitem, "orders": orders})

    def at(days, hours):
        return noon + dt.timedelta(days=days, hours=hours)

    contacts = {r.event_id - 8: (r.event_dttm, r.channel, r.contact_result) for r in inp.contact_events.collect()}
    assert contacts == {
        1: (at(11, 10), "call", "Wrong number"), 2: (at(-2, 6), "sms", "RPC"), 3: (at(-3, -11), "email", None),
        4: (None, "call", None), 5: (None, None, "Promise"), 6: (at(0, 0), None, "No answer"),
    }
    payments = {r.payment_id - 8: r.payment_dttm for r in inp.payments.collect()}
    assert payments == {1: at(3, 16), 2: at(4, 22), 3: at(-1, 0), 4: None, 5: None, 6: at(6, 12)}


@pytest.mark.parametrize("name", ["promise_funnel", "payments_until_date_left", "kept_promise_by_week"])
def test_payments_of_other_accounts_are_left_out_before_they_are_added_up(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan()
    semi = [n for n in _nodes(plan) if n.getClass().getSimpleName() == "Join" and n.joinType().toString() == "LeftSemi"]
    assert semi and not any(x.getClass().getSimpleName() == "Aggregate" for n in semi for x in _nodes(n.left()))


def _nodes(plan):
    return [plan] + [n for i in range(plan.children().size()) for n in _nodes(plan.children().apply(i))]


def _join_sides(plan):
    """Numbers of columns that the inputs of the plan's joins have."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [b.output().size() for b in below] if plan.getClass().getSimpleName() == "Join" else []
    return own + [n for b in below for n in _join_sides(b)]


def _line_types(plan):
    """Types of the columns in which lineitem's side enters a join with orders."""
    found = []
    for n in _nodes(plan):
        if n.getClass().getSimpleName() == "Join":
            out = n.left().output()
            columns = [out.apply(i) for i in range(out.size())]
            if "l_orderkey" in [c.name() for c in columns]:
                found += [c.dataType().catalogString() for c in columns]
    return found
