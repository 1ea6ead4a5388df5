"""Date helpers."""

import datetime as dt

from pyspark.sql import functions as F

from arrears.functions import date_of, days_ago, floor_days_between, plus_days, shift_days, week_start


def test_date_helpers(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2026, 3, 1, 23, 30), dt.date(2026, 2, 27))], "ts timestamp_ntz, d date"
    )
    r = df.select(
        date_of("ts").alias("d1"),
        plus_days("d", 6).alias("d2"),
        shift_days("ts", 6).alias("t2"),
        days_ago("ts", 30).alias("t3"),
        week_start("d").alias("w"),
        week_start(F.col("ts")).alias("w2"),
    ).collect()[0]
    assert r.d1 == dt.date(2026, 3, 1)
    assert r.d2 == dt.date(2026, 3, 5)  # across the end of February
    assert r.t2 == dt.datetime(2026, 3, 7, 23, 30)
    assert r.t3 == dt.datetime(2026, 1, 30, 23, 30)
    assert r.w == dt.date(2026, 2, 23) and r.w2 == dt.date(2026, 2, 23)


def test_floor_days_like_pandas(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 8, 1, 0)), (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 10))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r.d for r in df.select(floor_days_between("a", "b").alias("d")).collect()] == [1, 0]
