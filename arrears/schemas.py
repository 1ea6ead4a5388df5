"""Declared schemas of the inputs the marts consume (all fields nullable, like the source DDL)."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(10, 2)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


ACCOUNTS = _schema(
    ("account_id", LongType()),
    ("principal_amount", MONEY),
    ("product_type", StringType()),
    ("region", StringType()),
)

COLLECTION_CASES = _schema(
    ("case_id", LongType()),
    ("account_id", LongType()),
    ("customer_id", LongType()),
    ("start_date", DateType()),
    ("strategy_name", StringType()),
    ("dpd_bucket", StringType()),
)

CONTACT_EVENTS = _schema(
    ("event_id", LongType()),
    ("case_id", LongType()),
    ("event_dttm", TimestampNTZType()),
    ("channel", StringType()),
    ("contact_result", StringType()),
    ("promise_to_pay_date", DateType()),
    ("promised_amount", MONEY),
)

PAYMENTS = _schema(
    ("payment_id", LongType()),
    ("account_id", LongType()),
    ("payment_dttm", TimestampNTZType()),
    ("payment_amount", MONEY),
)

# pandas-side inputs (start_date is a midnight timestamp there)
CASES = _schema(
    ("case_id", LongType()),
    ("account_id", LongType()),
    ("customer_id", LongType()),
    ("start_date", TimestampNTZType()),
    ("dpd_bucket", StringType()),
    ("strategy_name", StringType()),
    ("principal_amount", MONEY),
)

CONTACTS = _schema(
    ("event_id", LongType()),
    ("case_id", LongType()),
    ("event_dttm", TimestampNTZType()),
    ("channel", StringType()),
    ("contact_result", StringType()),
)

SMS_AB_TEST = _schema(
    ("customer_id", LongType()),
    ("group_name", StringType()),
    ("segment", StringType()),
    ("delivered_flg", IntegerType()),
    ("paid_7d_flg", IntegerType()),
    ("paid_amount_7d", DoubleType()),
)

ACTIONS_LOG = _schema(
    ("customer_id", LongType()),
    ("action_dttm", TimestampNTZType()),
    ("action_type", StringType()),
    ("action_amount", DoubleType()),
)

DAILY_SNAPSHOT = _schema(
    ("customer_id", LongType()),
    ("snapshot_date", TimestampNTZType()),
    ("dpd", LongType()),
    ("outstanding_amount", DoubleType()),
)

TRAIN = _schema(
    ("customer_id", LongType()),
    ("snapshot_date", TimestampNTZType()),
    ("dpd_bucket", StringType()),
    ("outstanding_amount", DoubleType()),
    ("income", DoubleType()),
    ("region", StringType()),
    ("product_type", StringType()),
    ("contacts_last_7d", LongType()),
    ("rpc_last_30d", LongType()),
    ("promises_last_30d", LongType()),
    ("payments_amount_last_30d", DoubleType()),
    ("target_paid_30d", IntegerType()),
)

TRAIN_SCORES = _schema(
    ("customer_id", LongType()),
    ("snapshot_date", TimestampNTZType()),
    ("score", DoubleType()),
)

SCORING_RESULTS = _schema(
    ("customer_id", LongType()),
    ("snapshot_date", TimestampNTZType()),
    ("score", DoubleType()),
    ("target_paid_30d", IntegerType()),
    ("recovered_amount_30d", DoubleType()),
    ("dpd_bucket", StringType()),
    ("region", StringType()),
    ("current_contact_flg", IntegerType()),
)

BY_NAME = {
    "accounts": ACCOUNTS,
    "collection_cases": COLLECTION_CASES,
    "contact_events": CONTACT_EVENTS,
    "payments": PAYMENTS,
    "cases": CASES,
    "contacts": CONTACTS,
    "sms_ab_test": SMS_AB_TEST,
    "actions_log": ACTIONS_LOG,
    "daily_snapshot": DAILY_SNAPSHOT,
    "train": TRAIN,
    "train_scores": TRAIN_SCORES,
    "scoring_results": SCORING_RESULTS,
}
