"""CSV round trips (S1, S2), views (S7), column helpers."""

import tempfile

import pytest

from arrears import schemas as S
from arrears.operators.profile import split_by_dtype
from arrears.sources import files
from arrears.sources.fixtures import inputs
from tests.conftest import SF001


def test_typed_csv_round_trip(spark):
    inp = inputs(spark, SF001)
    for name in ("accounts", "collection_cases", "contact_events", "payments"):
        df = getattr(inp, name)
        path = tempfile.mkdtemp(prefix=f"rt-{name}-")
        files.write_csv(df, path)
        back = files.scan_typed_csv(spark, path, name)
        assert back.schema == S.BY_NAME[name]
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_typed_csv_fails_fast_on_bad_value(spark):
    path = tempfile.mkdtemp(prefix="bad-")
    with open(f"{path}/p.csv", "w") as fh:
        fh.write("payment_id,account_id,payment_dttm,payment_amount\n1,2,not-a-time,3.00\n")
    with pytest.raises(Exception):
        files.scan_typed_csv(spark, path, "payments").collect()


def test_inferred_csv_types_dates_and_nan(spark):
    path = tempfile.mkdtemp(prefix="inf-")
    with open(f"{path}/a.csv", "w") as fh:
        fh.write("customer_id,action_dttm,action_type,action_amount\n")
        fh.write("1,2024-01-02 10:00:00,call,0\n2,2024-01-03,payment,NaN\n")
    df = files.scan_inferred_csv(spark, path, ["action_dttm"])
    assert dict(df.dtypes)["action_dttm"] == "timestamp_ntz"
    rows = df.orderBy("customer_id").collect()
    assert rows[1].action_amount is None and str(rows[1].action_dttm) == "2024-01-03 00:00:00"


def test_publish_view_and_dtype_split(spark):
    inp = inputs(spark, SF001)
    files.publish_view(inp.collection_cases, "collection_cases_v")
    assert spark.sql("select count(*) c from collection_cases_v").collect()[0].c == inp.collection_cases.count()
    num, cat = split_by_dtype(inp.train.drop("row_id", "snapshot_date"))  # P9 drop, P10 split
    assert cat == ["dpd_bucket", "region", "product_type"]
    assert "income" in num and "target_paid_30d" in num


def test_unparsable_datetime_raises(spark):
    # like pd.to_datetime, a value that is not a datetime is an error (ANSI mode), not NULL
    path = tempfile.mkdtemp(prefix="badts-")
    with open(f"{path}/a.csv", "w") as fh:
        fh.write("customer_id,action_dttm\n1,yesterday\n")
    with pytest.raises(Exception):
        files.scan_inferred_csv(spark, path, ["action_dttm"]).collect()


def test_user_path_from_csv_files(spark):
    # the README example: typed CSVs in, marts out — equal to the same marts on the in-memory inputs
    from arrears.plans import bucket_summary as bs
    from arrears.plans import strategy as sm

    inp = inputs(spark, SF001)
    root = tempfile.mkdtemp(prefix="user-csv-")
    loaded = {}
    for name in ("accounts", "collection_cases", "contact_events", "payments", "cases", "contacts"):
        files.write_csv(getattr(inp, name), f"{root}/{name}")
        loaded[name] = files.scan_typed_csv(spark, f"{root}/{name}", name)
    args = ("1997-02-01", "1997-02-28")
    c1 = sm.strategy_effectiveness(loaded["collection_cases"], loaded["accounts"], loaded["contact_events"], loaded["payments"], *args)
    want = sm.strategy_effectiveness(inp.collection_cases, inp.accounts, inp.contact_events, inp.payments, *args)
    assert sorted(map(tuple, c1.collect())) == sorted(map(tuple, want.collect()))
    c4 = bs.build_collection_summary(loaded["cases"], loaded["contacts"], loaded["payments"])
    want4 = bs.build_collection_summary(inp.cases, inp.contacts, inp.payments)
    assert c4.collect() == want4.collect()
