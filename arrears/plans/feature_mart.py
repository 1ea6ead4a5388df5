"""Leak-free point-in-time features per daily snapshot.

For each ``(customer_id, snapshot_date)`` only actions strictly before the snapshot count:
calls / SMS of the last 7 days, promises (count and amount) and payment amount of the last 30
days, and whole days since the last payment (floored, T8; NULL without a payment).

Plan: actions are reduced to one row per customer and day (partial aggregation), unioned with the
snapshots, and every feature is a *range* window over the day number within the customer
(``RANGE BETWEEN n PRECEDING AND 1 PRECEDING``). A window group is one customer's calendar —
bounded by the number of days, not by the number of actions — and no snapshot × history pairs are
ever formed. Exact because snapshots are at midnight: ``ts >= snapshot - n days`` and
``ts < snapshot`` select exactly the days ``snapshot-n .. snapshot-1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrears.functions import floor_days_between
from arrears.operators.anchors import first_row_per_key

FEATURES = [
    "calls_last_7d",
    "sms_last_7d",
    "promises_last_30d",
    "promised_amount_last_30d",
    "payments_amount_last_30d",
    "days_since_last_payment",
]


# The action types of the log.
ACTION_TYPES = ("call", "sms", "promise", "payment")


def _day_number(c) -> F.Column:
    return F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01")))


def daily_actions(actions: DataFrame) -> DataFrame:
    """Per ``(customer_id, day)``: counts per type, promised and paid amounts, last payment time."""
    t = F.col("action_type")
    return actions.groupBy("customer_id", _day_number("action_dttm").alias("_dn")).agg(
        F.count_if(t == "call").alias("_calls"),
        F.count_if(t == "sms").alias("_sms"),
        F.count_if(t == "promise").alias("_promises"),
        F.sum(F.when(t == "promise", F.col("action_amount"))).alias("_promised"),
        F.sum(F.when(t == "payment", F.col("action_amount"))).alias("_paid"),
        F.max(F.when(t == "payment", F.col("action_dttm"))).alias("_last_payment"),
    )


def feature_mart(snapshot: DataFrame, actions: DataFrame, validate: bool = False) -> DataFrame:
    """C6. With ``validate`` the snapshot key ``(customer_id, snapshot_date)`` is checked to be
    unique first (trap T22; one ``limit(1)`` job over the duplicate keys)."""
    if validate:
        dup = snapshot.groupBy("customer_id", "snapshot_date").count().where(F.col("count") > 1)
        if not dup.isEmpty():
            raise ValueError("daily_snapshot has repeated (customer_id, snapshot_date) keys")
    # only actions before the last snapshot day can count, and only payments (days since the last
    # one) need history older than 30 days before the first snapshot
    span = snapshot.agg(F.struct(
        F.min(_day_number("snapshot_date")).alias("lo"), F.max(_day_number("snapshot_date")).alias("hi")
    )).scalar()
    dn = _day_number("action_dttm")
    relevant = actions.where((dn < span["hi"]) & ((F.col("action_type") == "payment") | (dn >= span["lo"] - 30)))
    daily = daily_actions(relevant).withColumn("_is_snap", F.lit(False))
    snaps = snapshot.select("*", _day_number("snapshot_date").alias("_dn"), F.lit(True).alias("_is_snap"))
    both = snaps.unionByName(daily, allowMissingColumns=True)
    base = Window.partitionBy("customer_id").orderBy("_dn")
    w7 = base.rangeBetween(-7, -1)
    w30 = base.rangeBetween(-30, -1)
    w_all = base.rangeBetween(Window.unboundedPreceding, -1)
    feats = both.select(
        "*",
        F.sum("_calls").over(w7).alias("_c7"),
        F.sum("_sms").over(w7).alias("_s7"),
        F.sum("_promises").over(w30).alias("_p30"),
        F.sum("_promised").over(w30).alias("_pa30"),
        F.sum("_paid").over(w30).alias("_pay30"),
        F.max("_last_payment").over(w_all).alias("_lp"),
    ).where(F.col("_is_snap"))
    return feats.select(
        *snapshot.columns,
        F.coalesce(F.col("_c7"), F.lit(0)).cast("bigint").alias("calls_last_7d"),
        F.coalesce(F.col("_s7"), F.lit(0)).cast("bigint").alias("sms_last_7d"),
        F.coalesce(F.col("_p30"), F.lit(0)).cast("bigint").alias("promises_last_30d"),
        F.round(F.coalesce(F.col("_pa30"), F.lit(0.0)), 6).alias("promised_amount_last_30d"),
        F.round(F.coalesce(F.col("_pay30"), F.lit(0.0)), 6).alias("payments_amount_last_30d"),
        floor_days_between("snapshot_date", "_lp").alias("days_since_last_payment"),
    )


def history_before_snapshot(snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """For each snapshot, all its customer's actions strictly before it, however old: counts
    and amounts by type, and the last action's time.

    Actions are first added up per customer and day; running totals over the days then give every
    snapshot its whole history in one sort, without a row per (snapshot, action) pair."""
    t, amount = F.col("action_type"), F.col("action_amount")
    daily = actions.groupBy("customer_id", _day_number("action_dttm").alias("_dn")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(t == k).alias(f"_n_{k}") for k in ACTION_TYPES],
        *[F.sum(F.when(t == k, amount)).alias(f"_s_{k}") for k in ("promise", "payment")],
        F.max("action_dttm").alias("_last"),
    ).withColumn("_is_snap", F.lit(False))
    snaps = snapshot.select("customer_id", "snapshot_date", _day_number("snapshot_date").alias("_dn"), F.lit(True).alias("_is_snap"))
    before = Window.partitionBy("customer_id").orderBy("_dn").rangeBetween(Window.unboundedPreceding, -1)
    totals = snaps.unionByName(daily, allowMissingColumns=True).select(
        "customer_id", "snapshot_date", "_is_snap",
        F.sum("_n").over(before).alias("actions_before"),
        *[F.sum(f"_n_{k}").over(before).alias(f"{k}_count_before") for k in ACTION_TYPES],
        *[F.sum(f"_s_{k}").over(before).alias(f"{k}_amount_before") for k in ("promise", "payment")],
        F.max("_last").over(before).alias("last_action_dttm"),
    ).where("_is_snap")
    counts = ["actions_before", *[f"{k}_count_before" for k in ACTION_TYPES]]
    amounts = ["promise_amount_before", "payment_amount_before"]
    return totals.select(
        "customer_id", "snapshot_date", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in amounts], "last_action_dttm",
    )


def actions_lookback(snapshot: DataFrame, actions: DataFrame, days: int) -> DataFrame:
    """Row level: snapshot × its customer's actions of the ``days`` days strictly before the
    snapshot. An equi-join on (customer, block of ``days`` days) with the day as a residual: a look-back
    touches at most two blocks, so no snapshot is ever paired with a customer's whole history.

    The planner takes the snapshots for as small as the table they are made from and would
    broadcast them, so the sort-merge join is asked for."""
    a = actions.select("customer_id", "action_dttm", "action_type", "action_amount").withColumn(
        "_dn", _day_number("action_dttm")
    ).withColumn("_block", F.floor(F.col("_dn") / days))
    day = _day_number("snapshot_date")
    first, last = F.floor((day - days) / days), F.floor((day - 1) / days)
    ex = snapshot.withColumn("_snap_dn", day).withColumn("_block", F.explode(F.sequence(first, last)))
    near = (F.col("_dn") >= F.col("_snap_dn") - days) & (F.col("_dn") < F.col("_snap_dn"))
    return (
        ex.hint("merge").join(a, ["customer_id", "_block"])
        .where(near & (F.col("action_dttm") < F.col("snapshot_date")))
        .drop("_block", "_dn", "_snap_dn")
    )


def leak_violations(history: DataFrame) -> DataFrame:
    """P8 check on :func:`history_before_snapshot`: snapshots whose last counted action is not
    strictly before them (must be 0). The history is cut by day, the check compares times."""
    return history.agg(F.count_if(F.col("last_action_dttm") >= F.col("snapshot_date")).alias("violations"))


def top_contacted_unpaid(mart: DataFrame, n: int = 20) -> DataFrame:
    """Customers with contacts in the last 7 days and no payment in the last 30 — each
    customer's snapshot with the most contacts (earliest on ties), the ``n`` most contacted
    (ties by customer_id)."""
    m = mart.withColumn("contacts_last_7d", F.col("calls_last_7d") + F.col("sms_last_7d"))
    base = m.where((F.col("payments_amount_last_30d") == 0) & (F.col("contacts_last_7d") > 0))
    best = first_row_per_key(base, "customer_id", [("contacts_last_7d", "desc"), ("snapshot_date", "asc")])
    return best.select(
        "customer_id", "snapshot_date", "dpd", "outstanding_amount", "calls_last_7d", "sms_last_7d",
        "contacts_last_7d", "payments_amount_last_30d",
    ).orderBy(F.col("contacts_last_7d").desc(), F.col("customer_id").asc()).limit(n)
