"""Weekly promise funnel per strategy (C3) and its parts.

Literal semantics of the reference query (traps T4, T5, T19, T23):

* a promise event is ``promised_amount > 0 OR promise_to_pay_date IS NOT NULL``;
* the first promise is joined back on ``(case_id, time)`` *without* the promise predicate, so other
  events at that instant add rows;
* "kept" compares the promised amount with all positive payments of the account from the beginning
  of time up to the promise date; NULL date or amount → not kept;
* the rates divide per (week, strategy) and may exceed 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrears.functions import ratio, week_start
from arrears.operators.anchors import of_keys
from arrears.operators.intervals import DAY, daily_totals, day_bounds, join_on, window_join
from arrears.plans.last_contact import positive_payment_days
from arrears.plans.strategy import cases_in_period

KEYS = ["week_start", "strategy_name"]
CASE = ["case_id", "account_id", "strategy_name", "start_date", "week_start"]


def is_promise(promised_amount: str = "promised_amount", promise_date: str = "promise_to_pay_date") -> Column:
    """P5."""
    return (F.col(promised_amount) > 0) | F.col(promise_date).isNotNull()


def is_rpc() -> Column:
    """P6."""
    return F.col("contact_result") == "RPC"


def cases_with_week(cases: DataFrame, start: str, end: str) -> DataFrame:
    """Period cases with ``week_start`` (Monday, DATE)."""
    return cases_in_period(cases, start, end).select(
        "case_id", "account_id", "strategy_name", "start_date", week_start("start_date").alias("week_start")
    )


def period_cases(cases: DataFrame, start: str, end: str) -> DataFrame:
    """The distinct cases of the period with the number of rows each has (``copies``).

    Grouping by every column keeps all of them alive in each use, so the uses share one exchange and
    the case table is read once.
    """
    return cases_with_week(cases, start, end).groupBy(*CASE).agg(F.count(F.lit(1)).alias("copies"))


def contact_rows(contacts: DataFrame, start: str, end: str, last: int) -> DataFrame:
    """Contacts that some case of the period can reach, dealt by (case, time).

    Dealt like this a hot case is spread over its times, the daily flags reduce it in each task, and the
    join back on (case, time) needs no further exchange. Every use reads all five columns, so the uses share this
    exchange and the contacts are read once.
    """
    # what joins on the case or the day infer is asked for here already, so that it changes no use
    dated = F.col("case_id").isNotNull() & F.to_date("event_dttm").isNotNull()
    reach = contacts.where(dated & day_bounds("event_dttm", start, end, 0, last))
    return reach.select(
        "case_id", "event_dttm", F.coalesce(is_rpc(), F.lit(False)).alias("rpc"), "promise_to_pay_date", "promised_amount"
    ).repartition("case_id", "event_dttm")


def contact_flags_daily(rows: DataFrame) -> DataFrame:
    """Per ``(case_id, day, rpc)`` of :func:`contact_rows`: the earliest promise time."""
    return daily_totals(
        rows, ["case_id", "rpc"], "event_dttm", [F.min(F.when(is_promise(), F.col("event_dttm"))).alias("promise_dttm")]
    )


def case_states(bc: DataFrame, rows: DataFrame, days: int = 7) -> DataFrame:
    """Each period case with ``has_rpc`` and its earliest promise time (NULL without one) in
    ``[start_date, start_date + days-1]``.

    Cases meet the daily flags on ``case_id`` with the day range as a residual: a case has at
    most two rows per calendar day there, so nothing is exploded and no pairs arise.
    """
    daily = contact_flags_daily(rows).withColumnRenamed("case_id", "_case")
    offset = F.date_diff(F.col(DAY), F.col("start_date"))
    hits = bc.join(daily, (F.col("case_id") == F.col("_case")) & offset.between(0, days - 1), "left")
    return hits.groupBy(*CASE, "copies").agg(
        F.coalesce(F.max("rpc"), F.lit(False)).alias("has_rpc"), F.min("promise_dttm").alias("first_promise_dttm")
    )


def cases_by_week_strategy(cases: DataFrame, start: str, end: str) -> DataFrame:
    """A2."""
    return cases_with_week(cases, start, end).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total_cases"))


def _counts(states: DataFrame, days: int) -> DataFrame:
    per_case = states.groupBy(*KEYS, "case_id").agg(
        F.max("has_rpc").alias("has_rpc"), F.max(F.col("first_promise_dttm").isNotNull()).alias("has_promise")
    )
    # a (week, strategy) without any such case has no row in the reference's per-metric tables,
    # so after its LEFT JOIN the count is NULL rather than 0
    return per_case.groupBy(*KEYS).agg(
        F.nullif(F.count_if("has_rpc"), F.lit(0)).alias(f"rpc_cases_{days}d"),
        F.nullif(F.count_if("has_promise"), F.lit(0)).alias(f"promise_cases_{days}d"),
    )


def funnel_counts(cases: DataFrame, contacts: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """A10 + A11 in one pass: distinct RPC cases and distinct promise cases per (week, strategy)."""
    rows = contact_rows(contacts, start, end, days - 1)
    return _counts(case_states(period_cases(cases, start, end), rows, days), days)


def first_promise_time(cases: DataFrame, contacts: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Earliest promise time per case inside its window."""
    states = case_states(period_cases(cases, start, end), contact_rows(contacts, start, end, days - 1), days)
    first = states.groupBy("case_id").agg(F.min("first_promise_dttm").alias("first_promise_dttm"))
    return first.where(F.col("first_promise_dttm").isNotNull())


def _first_promise_groups(states: DataFrame, rows: DataFrame) -> DataFrame:
    """First-promise rows of the cases, equal ones folded with their number (``rows``).

    The first promise is one of the case id, whatever rows the id has; it is joined back to every
    contact of the case at that instant (T4).
    """
    of_id = Window.partitionBy("case_id")  # a case id's own rows in the case table
    fp = states.drop("has_rpc").withColumn("first_promise_dttm", F.min("first_promise_dttm").over(of_id)).where(
        F.col("first_promise_dttm").isNotNull()
    )
    at_first = rows.withColumnsRenamed({"case_id": "_case", "event_dttm": "_at"})
    found = fp.join(at_first, F.col("case_id").eqNullSafe(F.col("_case")) & (F.col("first_promise_dttm") == F.col("_at")))
    groups = found.groupBy(*CASE, "copies", "first_promise_dttm", "rpc", "promise_to_pay_date", "promised_amount")
    return groups.agg((F.count(F.lit(1)) * F.col("copies")).alias("rows")).where(F.col("rows") > 0)


def first_promise_details(cases: DataFrame, contacts: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """The first promise joined back to its case and to every event at that instant (T4)."""
    rows = contact_rows(contacts, start, end, days - 1)
    groups = _first_promise_groups(case_states(period_cases(cases, start, end), rows, days), rows)
    return groups.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        "case_id", "account_id", "week_start", "strategy_name", "first_promise_dttm",
        "promise_to_pay_date", "promised_amount",
    )


def _running_payments(payments: DataFrame, accounts: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks(account_id, _d, ...)`` of ``accounts`` with the account's positive payments on days ``<= _d``: amount and number.

    One sorted pass over the days of each account that is asked for. The payments of other accounts are
    left out first; those of the asked ones are reduced to one row per account and day and asks are few
    per day, so a group is bounded by the calendar, not by the number of payments or cases.
    """
    asked = of_keys(payments.where(F.col("account_id").isNotNull()), accounts, "account_id")
    pay = positive_payment_days(asked).select(
        "account_id", F.col(DAY).alias("_d"), F.lit(0).alias("_ask"), "amount", "payments")
    order = Window.partitionBy("account_id").orderBy("_d", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = pay.unionByName(asks.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    return (
        both.withColumn("paid", F.sum("amount").over(order))
        .withColumn("paid_times", F.coalesce(F.sum("payments").over(order), F.lit(0)))
        .where(F.col("_ask") == 1).drop("_ask", "amount", "payments")
    )


def _due(groups: DataFrame) -> DataFrame:
    """First-promise groups with the day ``_due`` up to which payments count (a day before all, if none is set).

    Nothing is filtered out and keys are compared null-safe from here on: a filter that only one use of the
    groups needs would be pushed below the shared exchanges and the inputs read again.
    """
    return groups.withColumn("_due", F.coalesce("promise_to_pay_date", F.lit("0001-01-01").cast("date")))


def _promise_asks(due: DataFrame) -> DataFrame:
    """The distinct (account, day) that first-promise groups ask for."""
    return due.groupBy("account_id", F.col("_due").alias("_d")).agg(F.sum("rows").alias("promise_rows"))


def paid_until_promise(cases: DataFrame, contacts: DataFrame, payments: DataFrame, start: str, end: str, days: int = 7):
    """J7 (as used): per first-promise group, positive payments of the account up to the promise date.

    Rows that are equal in the grouped columns collapse, their payment sums add up (T4)."""
    rows = contact_rows(contacts, start, end, days - 1)
    groups = _first_promise_groups(case_states(period_cases(cases, start, end), rows, days), rows)
    due = _due(groups)
    asks = _promise_asks(due)
    paid = _running_payments(payments, asks, asks).select(F.col("account_id").alias("_account"), "_d", "paid")
    known = due.join(paid, F.col("account_id").eqNullSafe(F.col("_account")) & (F.col("_due") == F.col("_d")), "left")
    return known.groupBy("case_id", "week_start", "strategy_name", "promised_amount", "promise_to_pay_date").agg(
        F.sum(F.col("paid") * F.col("rows")).alias("paid_until_promise_date")
    )


def promise_payment_rows(cases: DataFrame, contacts: DataFrame, payments: DataFrame, start: str, end: str, days: int = 7):
    """J7 (rows): every first-promise row with each positive payment of its account up to the promise
    date, or NULL payment columns when there is none.

    An interval join keyed by month: the distinct (account, promise date) pairs are exploded into
    the months since the first payment, and meet the payments on (account, month) with the day as a residual. So a hot
    account is spread over its months on both sides.
    """
    details = first_promise_details(cases, contacts, start, end, days)
    month = F.trunc(F.col("payment_dttm"), "MM")
    pay = payments.where(F.col("payment_amount") > 0).select(
        "account_id", "payment_id", "payment_dttm", "payment_amount", month.alias("_month"))
    since = payments.where(F.col("payment_amount") > 0).agg(F.min(month)).scalar()
    last = F.trunc(F.col("promise_to_pay_date"), "MM")
    keys = details.select("account_id", "promise_to_pay_date").distinct().where(last >= since)
    months = keys.withColumn("_month", F.explode(F.sequence(since, last, F.expr("INTERVAL 1 MONTH"))))
    matches = months.join(pay, ["account_id", "_month"]).where(
        F.to_date("payment_dttm") <= F.col("promise_to_pay_date")).drop("_month")
    return details.join(matches, ["account_id", "promise_to_pay_date"], "left").select(
        *details.columns, "payment_id", "payment_dttm", "payment_amount")


def kept_promises(cases, contacts, payments, start, end, days: int = 7) -> DataFrame:
    """First promises that were kept, per (week, strategy)."""
    t = paid_until_promise(cases, contacts, payments, start, end, days)
    return (
        t.where(F.col("paid_until_promise_date") >= F.col("promised_amount"))
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("kept_promise_cases"))
    )


def recovery_by_week(cases: DataFrame, payments: DataFrame, start: str, end: str, days: int = 14) -> DataFrame:
    """Positive payments in days ``0 .. days-1`` of each case, summed per (week, strategy)."""
    bc = cases_with_week(cases, start, end)
    daily = daily_totals(
        payments,
        "account_id",
        "payment_dttm",
        [F.sum("payment_amount").alias("amount")],
        where=(F.col("payment_amount") > 0) & day_bounds("payment_dttm", start, end, 0, days - 1),
    )
    hits = window_join(bc, daily, "account_id", "start_date", 0, days - 1)
    return hits.groupBy(*KEYS).agg(F.sum("amount").alias(f"recovery_amount_{days}d"))


def _recovery_asks(bc: DataFrame, days: int) -> DataFrame:
    """What the recovery of ``days`` days asks of the running payments, per (account, day, week, strategy).

    Payments in a case's window are those up to its last day less those before its first: two asks a
    case, with the weight +1 and -1. Cases of an account that start on one day share their asks.
    """
    ends = F.array(F.struct(F.date_sub("start_date", 1).alias("_d"), F.lit(-1).alias("sign")),
                   F.struct(F.date_add("start_date", days - 1).alias("_d"), F.lit(1).alias("sign")))
    each = bc.select("case_id", "account_id", *KEYS, "copies", F.inline(ends))
    return each.groupBy("account_id", "_d", *KEYS).agg(
        F.sum(F.col("sign") * F.col("copies")).alias("weight"),
        F.sum(F.when(F.col("sign") == 1, F.col("copies"))).alias("cases"),
    )


def promise_funnel(cases, contacts, payments, start: str, end: str, days: int = 7, recovery_days: int = 14):
    """Per (week, strategy) — cases, RPC / promise / kept cases, 14-day recovery and the rates.

    Cases, contacts and payments are each read once. The states of the cases (RPC, first promise) come from
    the daily flags; recovery and kept promises both come from one sorted pass over each account's payment days
    (:func:`_running_payments`), in which recovery asks for two days of a case and a promise for its date.
    """
    d, r = f"{days}d", f"{recovery_days}d"
    bc = period_cases(cases, start, end)
    rows = contact_rows(contacts, start, end, days - 1)
    states = case_states(bc, rows, days)
    counts = _counts(states, days)
    due = _due(_first_promise_groups(states, rows))
    accounts = bc.groupBy("account_id").agg(F.sum("copies").alias("rows")).where(F.col("rows") > 0)
    asks = _recovery_asks(bc, recovery_days).unionByName(_promise_asks(due), allowMissingColumns=True)
    answers = _running_payments(payments, accounts, asks)
    # promise rows meet the answers to their own asks; recovery answers pass through
    recovery = F.col("promise_rows").isNull()
    due = due.select(
        F.col("account_id").alias("_account"), "_due", F.lit(False).alias("_recovery"), F.col("week_start").alias("_week"),
        F.col("strategy_name").alias("_strategy"), "case_id", "promised_amount", "promise_to_pay_date", "rows")
    met = answers.join(
        due, F.col("account_id").eqNullSafe(F.col("_account")) & (F.col("_d") == F.col("_due"))
        & (recovery == F.col("_recovery")), "left")
    totals = (
        met.groupBy(
            F.when(recovery, F.col("week_start")).otherwise(F.col("_week")).alias("week_start"),
            F.when(recovery, F.col("strategy_name")).otherwise(F.col("_strategy")).alias("strategy_name"),
            "case_id", "promised_amount", "promise_to_pay_date")
        .agg(F.sum(F.when(recovery, F.col("cases"))).alias("cases"),
             F.sum(F.when(recovery, F.col("weight") * F.coalesce(F.col("paid"), F.lit(0)))).alias("recovered"),
             F.sum(F.when(recovery, F.col("weight") * F.col("paid_times"))).alias("times"),
             F.sum(F.when(~recovery, F.col("paid") * F.col("rows"))).alias("paid_until"))
        .groupBy(*KEYS)
        .agg(F.sum("cases").alias("total_cases"),
             F.count_if(F.col("paid_until") >= F.col("promised_amount")).alias("kept"),
             F.sum("times").alias("times"), F.sum("recovered").alias("recovered"))
    )
    out = join_on(totals, counts, KEYS, "left", null_safe=True)
    # the reference's joins by name leave the metrics of cases without a strategy NULL
    metrics = {f"rpc_cases_{d}": F.col(f"rpc_cases_{d}"), f"promise_cases_{d}": F.col(f"promise_cases_{d}"),
               "kept_promise_cases": F.nullif("kept", F.lit(0)),
               f"recovery_amount_{r}": F.when(F.col("times") > 0, F.col("recovered"))}
    out = out.select(*KEYS, "total_cases", *(F.when(F.col("strategy_name").isNotNull(), value).alias(name)
                                             for name, value in metrics.items()))
    return out.select(
        "week_start",
        "strategy_name",
        F.col("total_cases").cast("bigint").alias("total_cases"),
        F.col(f"rpc_cases_{d}").cast("bigint").alias(f"rpc_cases_{d}"),
        F.col(f"promise_cases_{d}").cast("bigint").alias(f"promise_cases_{d}"),
        F.col("kept_promise_cases").cast("bigint").alias("kept_promise_cases"),
        F.col(f"recovery_amount_{r}").cast("double").alias(f"recovery_amount_{r}"),
        ratio(f"rpc_cases_{d}", "total_cases").alias(f"rpc_rate_{d}"),
        ratio(f"promise_cases_{d}", f"rpc_cases_{d}").alias("promise_rate_from_rpc"),
        ratio("kept_promise_cases", f"promise_cases_{d}").alias("kept_promise_rate"),
    )
