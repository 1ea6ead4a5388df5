"""Point-in-time feature mart over the daily snapshots and the action log."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.plans import feature_mart as fm
from arrears.sources.fixtures import inputs

_IN = ["daily_snapshot", "actions_log"]
_CTES = """
    hist AS (
        SELECT s.customer_id, s.snapshot_date, a.action_dttm, a.action_type, a.action_amount
        FROM daily_snapshot s JOIN actions_log a
          ON a.customer_id = s.customer_id AND a.action_dttm < s.snapshot_date),
    agg AS (
        SELECT customer_id, snapshot_date,
               count(*) FILTER (WHERE action_type = 'call' AND action_dttm >= snapshot_date - INTERVAL 7 DAY) AS c7,
               count(*) FILTER (WHERE action_type = 'sms' AND action_dttm >= snapshot_date - INTERVAL 7 DAY) AS s7,
               count(*) FILTER (WHERE action_type = 'promise' AND action_dttm >= snapshot_date - INTERVAL 30 DAY) AS p30,
               sum(action_amount) FILTER (WHERE action_type = 'promise'
                                          AND action_dttm >= snapshot_date - INTERVAL 30 DAY) AS pa30,
               sum(action_amount) FILTER (WHERE action_type = 'payment'
                                          AND action_dttm >= snapshot_date - INTERVAL 30 DAY) AS pay30,
               max(action_dttm) FILTER (WHERE action_type = 'payment') AS last_pay
        FROM hist GROUP BY 1, 2),
    mart AS (
        SELECT s.customer_id, s.snapshot_date, s.dpd, s.outstanding_amount,
               coalesce(g.c7, 0) AS calls_last_7d, coalesce(g.s7, 0) AS sms_last_7d,
               coalesce(g.p30, 0) AS promises_last_30d,
               round(coalesce(g.pa30, 0.0), 6) AS promised_amount_last_30d,
               round(coalesce(g.pay30, 0.0), 6) AS payments_amount_last_30d,
               CAST(floor(epoch(s.snapshot_date - g.last_pay) / 86400) AS BIGINT) AS days_since_last_payment
        FROM daily_snapshot s LEFT JOIN agg g USING (customer_id, snapshot_date))"""


@query("feature_mart", oracle=with_inputs(_IN, "SELECT * FROM mart", _CTES))
def feature_mart(spark, sf_dir):
    """C6 (W5, W6, P11)."""
    inp = inputs(spark, sf_dir)
    return fm.feature_mart(inp.daily_snapshot, inp.actions_log)


@query(
    "top20_contacted_unpaid",
    oracle=with_inputs(
        _IN,
        """SELECT customer_id, snapshot_date, dpd, outstanding_amount, calls_last_7d, sms_last_7d,
                  contacts_last_7d, payments_amount_last_30d
           FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                                               ORDER BY contacts_last_7d DESC, snapshot_date) AS rn
                 FROM (SELECT *, calls_last_7d + sms_last_7d AS contacts_last_7d FROM mart)
                 WHERE payments_amount_last_30d = 0 AND contacts_last_7d > 0)
           WHERE rn = 1
           ORDER BY contacts_last_7d DESC, customer_id LIMIT 20""",
        _CTES,
    ),
)
def top20_contacted_unpaid(spark, sf_dir):
    """C7 (W4, K3)."""
    inp = inputs(spark, sf_dir)
    return fm.top_contacted_unpaid(fm.feature_mart(inp.daily_snapshot, inp.actions_log))


_HISTORY = """SELECT s.customer_id, s.snapshot_date, count(a.action_dttm) AS actions_before,
       count(*) FILTER (WHERE a.action_type = 'call') AS call_count_before,
       count(*) FILTER (WHERE a.action_type = 'sms') AS sms_count_before,
       count(*) FILTER (WHERE a.action_type = 'promise') AS promise_count_before,
       count(*) FILTER (WHERE a.action_type = 'payment') AS payment_count_before,
       round(coalesce(sum(a.action_amount) FILTER (WHERE a.action_type = 'promise'), 0.0), 4) AS promise_amount_before,
       round(coalesce(sum(a.action_amount) FILTER (WHERE a.action_type = 'payment'), 0.0), 4) AS payment_amount_before,
       max(a.action_dttm) AS last_action_dttm
FROM daily_snapshot s LEFT JOIN actions_log a ON a.customer_id = s.customer_id AND a.action_dttm < s.snapshot_date
GROUP BY s.customer_id, s.snapshot_date"""


@query("point_in_time_join", oracle=with_inputs(_IN, _HISTORY))
def point_in_time_join(spark, sf_dir):
    """Every snapshot with its customer's whole history before it."""
    inp = inputs(spark, sf_dir)
    out = fm.history_before_snapshot(inp.daily_snapshot, inp.actions_log)
    return out.withColumns({c: F.round(c, 4) for c in ("promise_amount_before", "payment_amount_before")})


@query(
    "actions_lookback_30d",
    oracle=with_inputs(
        _IN,
        """SELECT s.*, a.action_dttm, a.action_type, a.action_amount
           FROM daily_snapshot s JOIN actions_log a
             ON a.customer_id = s.customer_id AND a.action_dttm < s.snapshot_date
            AND a.action_dttm >= s.snapshot_date - INTERVAL 30 DAY""",
    ),
)
def actions_lookback_30d(spark, sf_dir):
    """The actions of the 30 days strictly before each snapshot, row by row (a look-back)."""
    inp = inputs(spark, sf_dir)
    return fm.actions_lookback(inp.daily_snapshot, inp.actions_log, days=30)


@query(
    "strictly_before",
    oracle=with_inputs(
        _IN,
        """SELECT count(*) FILTER (WHERE last >= snapshot_date) AS violations FROM (
               SELECT s.snapshot_date, max(a.action_dttm) AS last
               FROM daily_snapshot s JOIN actions_log a
                 ON a.customer_id = s.customer_id AND date_diff('day', a.action_dttm, s.snapshot_date) >= 1
               GROUP BY s.customer_id, s.snapshot_date)""",
    ),
)
def strictly_before(spark, sf_dir):
    """Leak check on the point-in-time history (must be 0)."""
    inp = inputs(spark, sf_dir)
    return fm.leak_violations(fm.history_before_snapshot(inp.daily_snapshot, inp.actions_log))


@query(
    "rolling_counts_before",
    oracle=with_inputs(
        _IN,
        "SELECT customer_id, snapshot_date, calls_last_7d, sms_last_7d, promises_last_30d, "
        "promised_amount_last_30d, payments_amount_last_30d FROM mart",
        _CTES,
    ),
)
def rolling_counts_before(spark, sf_dir):
    """Counts and sums over the 7 / 30 days strictly before each snapshot."""
    inp = inputs(spark, sf_dir)
    return fm.feature_mart(inp.daily_snapshot, inp.actions_log).select(
        "customer_id", "snapshot_date", "calls_last_7d", "sms_last_7d", "promises_last_30d",
        "promised_amount_last_30d", "payments_amount_last_30d",
    )


@query(
    "days_since_last_event",
    oracle=with_inputs(_IN, "SELECT customer_id, snapshot_date, days_since_last_payment FROM mart", _CTES),
)
def days_since_last_event(spark, sf_dir):
    """Whole days since the last payment before the snapshot (NULL if none)."""
    inp = inputs(spark, sf_dir)
    return fm.feature_mart(inp.daily_snapshot, inp.actions_log).select(
        "customer_id", "snapshot_date", "days_since_last_payment"
    )


@query(
    "best_row_per_customer",
    oracle=with_inputs(
        _IN,
        """SELECT customer_id, snapshot_date, contacts_last_7d FROM (
               SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY contacts_last_7d DESC, snapshot_date) AS rn
               FROM (SELECT *, calls_last_7d + sms_last_7d AS contacts_last_7d FROM mart)
               WHERE payments_amount_last_30d = 0 AND contacts_last_7d > 0) WHERE rn = 1""",
        _CTES,
    ),
)
def best_row_per_customer(spark, sf_dir):
    """Per customer the qualifying snapshot with the most contacts (earliest on ties)."""
    from pyspark.sql import functions as F

    from arrears.operators.anchors import first_row_per_key

    inp = inputs(spark, sf_dir)
    m = fm.feature_mart(inp.daily_snapshot, inp.actions_log).withColumn(
        "contacts_last_7d", F.col("calls_last_7d") + F.col("sms_last_7d")
    )
    base = m.where((F.col("payments_amount_last_30d") == 0) & (F.col("contacts_last_7d") > 0))
    best = first_row_per_key(base, "customer_id", [("contacts_last_7d", "desc"), ("snapshot_date", "asc")])
    return best.select("customer_id", "snapshot_date", "contacts_last_7d")
