import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from arrears import schemas as S


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def frame(spark, schema: T.StructType, rows):
    return spark.createDataFrame(rows, schema)


def cases(spark, rows):
    """rows: (case_id, account_id, start_date, strategy, bucket)"""
    return frame(spark, S.COLLECTION_CASES, [(c, a, a, d(s), st, b) for c, a, s, st, b in rows])


def contacts(spark, rows):
    """rows: (event_id, case_id, event_dttm, channel, result, promise_date, promised_amount)"""
    return frame(
        spark,
        S.CONTACT_EVENTS,
        [(e, c, ts(t), ch, r, d(pd) if pd else None, money(pa)) for e, c, t, ch, r, pd, pa in rows],
    )


def payments(spark, rows):
    """rows: (payment_id, account_id, payment_dttm, amount)"""
    return frame(spark, S.PAYMENTS, [(p, a, ts(t), money(x)) for p, a, t, x in rows])


def accounts(spark, rows):
    return frame(spark, S.ACCOUNTS, [(a, money(p), pt, r) for a, p, pt, r in rows])


def scans(df):
    """Tables that the executed (final adaptive) plan of ``df`` scans, reused exchanges counted once."""
    df.collect()
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind in ("ReusedExchangeExec", "ReusedSubqueryExec"):
            return None
        if kind == "FileSourceScanExec":
            path = plan.relation().location().rootPaths().head().toString()
            found.append(path.rsplit("/", 1)[-1].split(".")[0])
        for below in (plan.children(), plan.subqueries()):
            for i in range(below.size()):
                walk(below.apply(i))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(found)


def operators(df):
    """Class names of the executed plan's operators (call after an action)."""
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        found.append(kind)
        for below in (plan.children(), plan.subqueries()):
            for i in range(below.size()):
                walk(below.apply(i))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return found
