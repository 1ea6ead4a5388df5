"""Point-in-time history, its leak check, wide categories, and lost catalog modules."""

import datetime as dt
import random

import pytest

from arrears.plans import feature_mart as fm
from arrears.sources.fixtures import inputs
from tests.conftest import SF001
from tests.helpers import operators

DAY = dt.datetime(2026, 2, 10)
SNAPS = "customer_id long, snapshot_date timestamp_ntz"
ACTIONS = "customer_id long, action_dttm timestamp_ntz, action_type string, action_amount double"


def test_history_has_no_cut(spark):
    snaps = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(days=1)), (2, DAY)], SNAPS)
    acts = spark.createDataFrame(
        [(1, DAY - dt.timedelta(days=900), "payment", 5.0), (1, DAY - dt.timedelta(seconds=1), "call", None),
         (1, DAY, "sms", None), (1, DAY + dt.timedelta(hours=3), "promise", 7.0), (3, DAY, "call", None)], ACTIONS)
    got = {(r.customer_id, r.snapshot_date): r for r in fm.history_before_snapshot(snaps, acts).collect()}
    first, second, none = got[(1, DAY)], got[(1, DAY + dt.timedelta(days=1))], got[(2, DAY)]
    assert (first.actions_before, first.payment_amount_before, first.last_action_dttm) == (2, 5.0, DAY - dt.timedelta(seconds=1))
    assert (second.actions_before, second.promise_amount_before, second.sms_count_before) == (4, 7.0, 1)
    assert none.actions_before == 0 and none.last_action_dttm is None


def test_leak_check_can_fail(spark):
    rows = [(1, DAY, DAY), (2, DAY, DAY - dt.timedelta(seconds=1)), (3, DAY, None)]
    df = spark.createDataFrame(rows, "customer_id long, snapshot_date timestamp_ntz, last_action_dttm timestamp_ntz")
    assert fm.leak_violations(df).first().violations == 1


def test_lost_catalog_module_is_an_error(monkeypatch):
    from arrears import catalog

    monkeypatch.setattr(catalog, "_MODULES", (*catalog._MODULES, "no_such_module"))
    with pytest.raises(ModuleNotFoundError):
        catalog.load_all()


def test_a_feature_with_a_hundred_categories(spark):
    from pyspark.sql import functions as F

    from arrears.plans import payment_model as pm
    from arrears.sources.fixtures import inputs
    from tests.conftest import SF001

    train = inputs(spark, SF001).train.withColumn("region", F.concat(F.lit("r"), (F.col("row_id") % 100).cast("string")))
    tr, va = pm.time_split(train, ("1997-01-01", "1997-09-30"), ("1997-10-01", "1997-12-31"))
    model, best = pm.boosted_trees(tr, va, max_iter=2)
    assert best >= 1 and pm.positive_probability(model, pm.fill_categories(va)).count() == va.count()


def test_lookback_rows_by_block_without_a_broadcast_of_the_snapshots(spark):
    # days on both sides of a block's edge, before 1970 too; repeated rows, null keys and times
    rnd = random.Random(5)
    day0 = dt.datetime(1969, 11, 20)
    snaps = [(c, day0 + dt.timedelta(days=d), d, 1.0) for c in (1, 2, 2, None) for d in range(0, 95, 3)]
    snaps += [(1, None, 7, 1.0), snaps[0]]
    acts = [(rnd.choice([1, 2, 3, None]), day0 + dt.timedelta(seconds=rnd.randrange(-40, 100) * 86400 + rnd.choice([0, 1, 86399])),
             rnd.choice(["call", "sms", None]), 1.0) for _ in range(400)] + [(1, None, "call", 1.0)]
    s = spark.createDataFrame(snaps, "customer_id long, snapshot_date timestamp_ntz, dpd long, outstanding_amount double")
    a = spark.createDataFrame(acts, "customer_id long, action_dttm timestamp_ntz, action_type string, action_amount double")
    for days in (1, 7, 30):
        out = fm.actions_lookback(s, a, days)
        got = sorted(map(str, (tuple(r) for r in out.collect())))
        want = [(*x, *y[1:]) for x in snaps for y in acts if None not in (x[0], x[1], y[1]) and x[0] == y[0]
                and x[1] - dt.timedelta(days=days) <= y[1] < x[1]]
        assert want and got == sorted(map(str, want))
    out = fm.actions_lookback(inputs(spark, SF001).daily_snapshot, inputs(spark, SF001).actions_log, 30)
    out.collect()
    assert not any("Broadcast" in x for x in operators(out))
