"""Column-level helpers built only from ``pyspark.sql.functions`` (they stay inside codegen)."""

from arrears.functions.dates import date_of, days_ago, floor_days_between, plus_days, shift_days, week_start
from arrears.functions.numeric import (
    BUCKET_ORDER,
    bucket_rank,
    erfc,
    ratio,
    ratio_or_zero,
    round6,
    two_sided_normal_p,
)

__all__ = [
    "BUCKET_ORDER",
    "bucket_rank",
    "date_of",
    "days_ago",
    "erfc",
    "floor_days_between",
    "plus_days",
    "ratio",
    "ratio_or_zero",
    "round6",
    "shift_days",
    "two_sided_normal_p",
    "week_start",
]
