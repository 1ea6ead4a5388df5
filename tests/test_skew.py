"""Skew: one account holds a third of all cases and payments (derived from the sf0.01 tables).

The day-binned interval join must stay exact and must not route the hot account to one task: its
shuffle key is (account, day), so the hot account spreads over its days, while a join on the
account alone would put at least a third of the rows into one partition.
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from arrears.oracle_fixtures import with_inputs
from arrears.operators.intervals import DAY, explode_days
from arrears.plans import strategy as st
from arrears.sources.fixtures import DRIVER_TABLES, inputs

SF = "/root/testdata/sf0.01"
HOT = 0
START, END = "1995-01-01", "2001-12-31"  # the whole history: every case is an anchor


def _skewed(inp):
    hot = lambda key, acc: F.when(F.col(key) % 3 == 0, F.lit(HOT)).otherwise(F.col(acc))
    cases = inp.collection_cases.withColumn("account_id", hot("case_id", "account_id"))
    pays = inp.payments.withColumn("account_id", hot("payment_id", "account_id"))
    return cases, pays


@pytest.fixture(scope="module")
def skewed(spark):
    return _skewed(inputs(spark, SF))


def test_skewed_paid_metrics_match_sql(spark, skewed):
    cases, pays = skewed
    got = {
        r.strategy_name: (r.paid_cases_7d, float(r.collected_amount_7d))
        for r in st.paid_by_strategy(cases, pays, START, END).collect()
    }
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = with_inputs(
        ["collection_cases", "payments"],
        """SELECT c.strategy_name, count(DISTINCT c.case_id) AS n, CAST(sum(p.payment_amount) AS DOUBLE) AS amt
           FROM sc c JOIN sp p ON p.account_id = c.account_id AND p.payment_amount > 0
            AND CAST(p.payment_dttm AS DATE) BETWEEN c.start_date AND c.start_date + 6
           GROUP BY 1""",
        """sc AS (SELECT * REPLACE (CASE WHEN case_id % 3 = 0 THEN 0 ELSE account_id END AS account_id)
                  FROM collection_cases),
           sp AS (SELECT * REPLACE (CASE WHEN payment_id % 3 = 0 THEN 0 ELSE account_id END AS account_id)
                  FROM payments)""",
    )
    want = {s: (n, a) for s, n, a in con.sql(sql).fetchall()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6


def _max_partition_share(df, keys, n=8):
    parts = df.repartition(n, *[F.col(k) for k in keys]).groupBy(F.spark_partition_id().alias("p")).count()
    counts = [r["count"] for r in parts.collect()]
    return max(counts) / sum(counts)


def test_hot_account_is_spread_over_days(spark, skewed):
    cases, _ = skewed
    share_hot = cases.where(F.col("account_id") == HOT).count() / cases.count()
    assert share_hot > 0.3
    exploded = explode_days(cases.select("case_id", "account_id", "start_date"), "start_date", 0, 6)
    by_account = _max_partition_share(exploded, ["account_id"])
    by_account_day = _max_partition_share(exploded, ["account_id", DAY])
    assert by_account >= share_hot  # a key-only shuffle puts the whole hot account in one task
    assert by_account_day < 0.2  # the (account, day) shuffle used by the window join does not


def test_hot_customer_feature_mart_matches_sql_and_stays_per_day(spark):
    # a third of all actions moved onto customer 0: the mart stays exact, and the window group of
    # the hot customer holds one row per active day, not one per action
    from arrears.catalog.feature_mart import _CTES
    from arrears.plans import feature_mart as fm

    inp = inputs(spark, SF)
    acts = inp.actions_log.withColumn(
        "customer_id",
        F.when(F.abs(F.hash("action_dttm")) % 3 == 0, F.lit(HOT)).otherwise(F.col("customer_id")),
    )
    got = fm.feature_mart(inp.daily_snapshot, acts).where(F.col("customer_id") == HOT).collect()
    hot_actions = acts.where(F.col("customer_id") == HOT).count()
    hot_days = fm.daily_actions(acts).where(F.col("customer_id") == HOT).count()
    assert hot_actions > acts.count() / 4 and hot_days <= 31
    # oracle on the same skewed actions, computed by DuckDB from the same rows
    pdf = acts.toPandas()
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.register("skewed_actions", pdf)
    sql = with_inputs(["daily_snapshot"], "SELECT * FROM mart WHERE customer_id = 0",
                      _CTES.replace("JOIN actions_log a", "JOIN skewed_actions a"))
    rel = con.sql(sql)
    want = sorted(rel.fetchall(), key=lambda r: r[1])
    got_rows = sorted((tuple(r) for r in got), key=lambda r: r[1])
    assert [r[:4] for r in got_rows] == [r[:4] for r in want]
    assert [tuple(r[4:9]) for r in got_rows] == [tuple(r[4:9]) for r in want]
    assert [r[9] for r in got_rows] == [r[9] for r in want]


def test_hot_account_kept_promises_match_sql(spark, skewed):
    # C3's "kept" sums all payments of the account up to the promise date: with a third of cases and
    # payments on one account the as-of window holds that account's days, not its payments
    from arrears.catalog.promise_funnel import C3_END, C3_START, _CTES
    from arrears.plans import promise_funnel as pf
    from arrears.plans.last_contact import positive_payment_days

    cases, pays = skewed
    inp = inputs(spark, SF)
    got = {(str(r.week_start), r.strategy_name): r.kept_promise_cases
           for r in pf.kept_promises(cases, inp.contact_events, pays, C3_START, C3_END).collect()}
    hot_payments = pays.where((F.col("account_id") == HOT) & (F.col("payment_amount") > 0)).count()
    hot_days = positive_payment_days(pays).where(F.col("account_id") == HOT).count()
    assert hot_payments > hot_days  # the window rows of the hot account are its days
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    skew_ctes = (
        "scc AS (SELECT * REPLACE (CASE WHEN case_id % 3 = 0 THEN 0 ELSE account_id END AS account_id) "
        "FROM collection_cases), "
        "spp AS (SELECT * REPLACE (CASE WHEN payment_id % 3 = 0 THEN 0 ELSE account_id END AS account_id) "
        "FROM payments), "
    )
    body = _CTES.replace("FROM collection_cases WHERE start_date", "FROM scc WHERE start_date").replace(
        "LEFT JOIN payments p", "LEFT JOIN spp p"
    ).replace("JOIN payments p", "JOIN spp p")
    sql = with_inputs(["collection_cases", "contact_events", "payments"], "SELECT * FROM kept", skew_ctes + body)
    want = {(str(w), s): n for w, s, n in con.sql(sql).fetchall()}
    assert len(want) > 10 and got == want


def test_hot_case_bucket_summary_matches_sql(spark):
    # a third of all contacts moved onto one case: de-duplication and the per-(case, day) flags
    # reduce it before any join; the summary still equals the SQL result on the same data
    from arrears.catalog.bucket_summary import _CTES
    from arrears.plans import bucket_summary as bs

    inp = inputs(spark, SF)
    hot_case = 1
    contacts = inp.contacts.withColumn(
        "case_id", F.when(F.col("event_id") % 3 == 0, F.lit(hot_case)).otherwise(F.col("case_id"))
    )
    got = {r.dpd_bucket: tuple(r) for r in bs.collection_summary(*bs.preprocess(inp.cases, contacts, inp.payments)).collect()}
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    skew = ("hc AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE case_id END AS case_id) "
            "FROM contacts), ")
    body = _CTES.replace("FROM contacts) WHERE rn = 1", "FROM hc) WHERE rn = 1")
    sql = with_inputs(
        ["cases", "contacts", "payments"],
        """SELECT t.dpd_bucket, t.total_cases, coalesce(k.n, 0), coalesce(p.n, 0),
                  coalesce(CAST(p.amount AS DOUBLE), 0.0),
                  coalesce(round(CAST(p.amount AS DOUBLE) / nullif(CAST(p.n AS DOUBLE), 0), 6), 0.0)
           FROM (SELECT dpd_bucket, count(DISTINCT case_id) AS total_cases FROM cases GROUP BY 1) t
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS n FROM c_win GROUP BY 1) k USING (dpd_bucket)
           LEFT JOIN (SELECT dpd_bucket, count(DISTINCT case_id) AS n, sum(payment_amount) AS amount
                      FROM p_win GROUP BY 1) p USING (dpd_bucket)""",
        skew + body,
    )
    want = {r[0]: tuple(r) for r in con.sql(sql).fetchall()}
    assert len(want) == 4 and got == want


def test_hot_account_last_contact_payments_match_sql(spark, skewed):
    # C2 on the hot account: the 5-day payment windows join on (account, day), so the account's
    # last contacts spread over their days; the result equals SQL on the same data
    from arrears.catalog.last_contact import C2_END, C2_START, _CTES
    from arrears.plans import last_contact as lc

    cases, pays = skewed
    inp = inputs(spark, SF)
    got = sorted(tuple(r) for r in lc.last_contact_payments(cases, inp.contact_events, pays, C2_START, C2_END).collect())
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    skew = (
        "scc AS (SELECT * REPLACE (CASE WHEN case_id % 3 = 0 THEN 0 ELSE account_id END AS account_id) "
        "FROM collection_cases), "
        "spp AS (SELECT * REPLACE (CASE WHEN payment_id % 3 = 0 THEN 0 ELSE account_id END AS account_id) "
        "FROM payments), "
    )
    body = _CTES.replace("SELECT * FROM collection_cases WHERE", "SELECT * FROM scc WHERE").replace(
        "JOIN collection_cases c ON", "JOIN scc c ON"
    )
    sql = with_inputs(
        ["collection_cases", "contact_events", "payments"],
        """SELECT d.case_id, d.account_id, d.strategy_name, d.last_contact_dttm, d.last_channel,
                  d.last_contact_result,
                  CASE WHEN count(p.payment_id) > 0 THEN 1 ELSE 0 END AS payment_in_5d_flag,
                  CAST(sum(p.payment_amount) AS DOUBLE) AS payment_amount_5d
           FROM detail d LEFT JOIN spp p
             ON p.account_id = d.account_id AND p.payment_amount > 0
            AND CAST(p.payment_dttm AS DATE) BETWEEN CAST(d.last_contact_dttm AS DATE)
                                                AND CAST(d.last_contact_dttm AS DATE) + 4
           GROUP BY ALL""",
        skew + body,
    )
    want = sorted(tuple(r) for r in con.sql(sql).fetchall())
    assert len(want) > 100 and [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == [r[6] for r in want]
    assert all((a is None and b is None) or abs(a - b) < 1e-6 for a, b in zip([r[7] for r in got], [r[7] for r in want]))


def _hot_contacts(inp, table="contacts"):
    """A third of all contacts on case 1."""
    return getattr(inp, table).withColumn(
        "case_id", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("case_id")))


_HOT_CASE = "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE case_id END AS case_id) FROM {}"


def _duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_hot_case_window_rows_match_sql_and_are_dealt_by_day(spark):
    # P7 / J5 / U1 on the hot case, with a few contacts and cases without an id (they match each other, T2)
    from arrears.catalog.bucket_summary import _CTES
    from arrears.plans import bucket_summary as bs

    inp = inputs(spark, SF)
    no_id = lambda df, key: df.withColumn("case_id", F.when(F.col(key) % 997 != 5, F.col("case_id")))
    contacts, cases = no_id(_hot_contacts(inp), "event_id"), no_id(inp.cases, "customer_id")
    cases, contacts, _ = bs.preprocess(cases, contacts, inp.payments)
    got = sorted(map(str, (tuple(r) for r in bs.contacts_in_window(cases, contacts).collect())))
    pairs = {tuple(r) for r in bs.contacted_pairs(cases, contacts).collect()}
    skew = ("hc AS (SELECT * REPLACE (CASE WHEN event_id % 997 <> 5 THEN case_id END AS case_id) FROM ("
            + _HOT_CASE.format("contacts") + ")), nc AS (SELECT * REPLACE (CASE WHEN customer_id % 997 <> 5 "
            "THEN case_id END AS case_id) FROM cases), ")
    body = skew + _CTES.replace("FROM contacts) WHERE rn = 1", "FROM hc) WHERE rn = 1").replace("JOIN cases c", "JOIN nc c")
    rows = """SELECT e.event_id, e.case_id, e.event_dttm, e.channel, e.contact_result, c.start_date, c.dpd_bucket
              FROM dedup e JOIN nc c ON e.case_id IS NOT DISTINCT FROM c.case_id
              WHERE e.event_dttm >= c.start_date AND e.event_dttm <= c.start_date + INTERVAL 6 DAY"""
    con = _duck()
    want = sorted(map(str, con.sql(with_inputs(["cases", "contacts", "payments"], rows, body)).fetchall()))
    assert len(want) > 10_000 and any(", None, datetime" in r for r in want) and got == want
    distinct = con.sql(with_inputs(["cases", "contacts", "payments"], "SELECT DISTINCT dpd_bucket, case_id FROM c_win", body))
    assert pairs == set(distinct.fetchall())
    # the largest of 8 shuffle partitions of the contacts under the join's key, against the median one
    sizes = sorted(r["count"] for r in contacts.repartition(8, "case_id", F.to_date("event_dttm"))
                   .groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 2 * (sizes[3] + sizes[4]) / 2


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_hot_case_last_contact_matches_sql(spark, broadcast):
    # The hot case is reduced to its latest rows in each task, whichever join the planner takes
    from arrears.catalog.last_contact import C2_END, C2_START, _CTES
    from arrears.plans import last_contact as lc

    inp = inputs(spark, SF)
    cases = inp.collection_cases.withColumn(  # the hot case starts in the period
        "start_date", F.when(F.col("case_id") == 1, F.lit(C2_START).cast("date")).otherwise(F.col("start_date")))
    events = _hot_contacts(inp, "contact_events")
    body = ("hc AS (" + _HOT_CASE.format("contact_events") + "), pc AS (SELECT * REPLACE (CASE WHEN case_id = 1 THEN DATE '"
            + C2_START + "' ELSE start_date END AS start_date) FROM collection_cases), "
            + _CTES.replace("FROM contact_events e", "FROM hc e").replace("JOIN contact_events e", "JOIN hc e")
            .replace("FROM collection_cases", "FROM pc").replace("JOIN collection_cases", "JOIN pc"))
    con = _duck()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for fn, table in ((lc.last_contact_time, "last_time"), (lc.last_contact_details, "detail")):
            got = sorted(map(str, (tuple(r) for r in fn(cases, events, C2_START, C2_END).collect())))
            want = con.sql(with_inputs(["collection_cases", "contact_events"], f"SELECT * FROM {table}", body)).fetchall()
            assert any(r[0] == 1 for r in want) and got == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_case_promise_funnel_matches_sql(spark):
    # C3 with a third of the contacts on one case of the period
    from arrears.catalog import ORACLES
    from arrears.catalog.promise_funnel import C3_END, C3_START
    from arrears.plans import promise_funnel as pf

    inp = inputs(spark, SF)
    cases = inp.collection_cases.withColumn(
        "start_date", F.when(F.col("case_id") == 1, F.lit(C3_START).cast("date")).otherwise(F.col("start_date")))
    got = pf.promise_funnel(cases, _hot_contacts(inp, "contact_events"), inp.payments, C3_START, C3_END)
    sql = ORACLES["promise_funnel"].replace(
        "q_cases AS (", "hc AS (" + _HOT_CASE.format("contact_events") + "), pc AS (SELECT * REPLACE (CASE WHEN case_id = 1 "
        f"THEN DATE '{C3_START}' ELSE start_date END AS start_date) FROM collection_cases), q_cases AS (")
    sql = sql.replace("JOIN contact_events e", "JOIN hc e").replace("FROM collection_cases WHERE start_date", "FROM pc WHERE start_date")
    rel = _duck().sql(sql)
    key = lambda r: tuple(map(str, r))
    want = sorted(({tuple(dict(zip(rel.columns, r))[c] for c in got.columns) for r in rel.fetchall()}), key=key)
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(want) > 30 and [r[:6] for r in rows] == [r[:6] for r in want]
    for a, b in zip(rows, want):
        assert all((x is None and y is None) or abs(x - y) < 1e-6 for x, y in zip(a[6:], b[6:]))
