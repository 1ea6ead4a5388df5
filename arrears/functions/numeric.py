"""Numeric helpers: safe ratios, bucket order and the normal-tail function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered overdue buckets of the domain.
BUCKET_ORDER = ["1-30", "31-60", "61-90", "90+"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c: Column | str) -> Column:
    return F.round(_c(c).cast("double"), 6)


def ratio(num: Column | str, den: Column | str, scale: int | None = 6) -> Column:
    """``num / NULLIF(den, 0)`` in double precision (P12, trap T9); NULL when either side is NULL."""
    q = _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))
    return F.round(q, scale) if scale is not None else q


def ratio_or_zero(num: Column | str, den: Column | str, scale: int | None = 6) -> Column:
    """pandas variant of :func:`ratio`: ±inf and NaN (and NULL) become 0."""
    return F.coalesce(ratio(num, den, scale), F.lit(0.0))


def bucket_rank(bucket: Column | str) -> Column:
    """Position of a dpd bucket in :data:`BUCKET_ORDER` (1-based); unknown → NULL."""
    pos = F.array_position(F.array(*[F.lit(b) for b in BUCKET_ORDER]), _c(bucket))
    return F.when(pos > 0, pos.cast("int"))


# erfc has no built-in in Spark. Two exact-in-double evaluations, both as array folds so they run
# inside the JVM: the Maclaurin series of erf for x <= SERIES_LIMIT and the Laplace continued
# fraction of erfc above it (evaluated from its tail).
SERIES_TERMS = 120
FRACTION_TERMS = 80
SERIES_LIMIT = 3.0


def erfc(x: Column | str) -> Column:
    """Complementary error function of a non-negative double column."""
    x = _c(x).cast("double")
    x2 = x * x
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum t_n,  t_0 = x,  t_n = t_{n-1} * 2x^2 / (2n + 1)
    acc0 = F.struct(x.alias("t"), x.alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        acc0,
        lambda acc, n: F.struct(
            (acc["t"] * F.lit(2.0) * x2 / (n * 2 + 1)).alias("t"),
            (acc["s"] + acc["t"] * F.lit(2.0) * x2 / (n * 2 + 1)).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    erf_small = F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x2) * series
    # erfc(x) = exp(-x^2)/sqrt(pi) / K,  K = x + (1/2)/(x + 1/(x + (3/2)/(x + ...)))
    tail = F.aggregate(
        F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1)),
        x,
        lambda k, n: x + (n.cast("double") / 2) / k,
    )
    erfc_large = F.exp(-x2) / F.lit(math.sqrt(math.pi)) / tail
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= SERIES_LIMIT, F.lit(1.0) - erf_small).otherwise(
        erfc_large
    )


def two_sided_normal_p(z: Column | str) -> Column:
    """``2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2)`` (E5)."""
    return erfc(F.abs(_c(z)) / F.lit(math.sqrt(2.0)))
