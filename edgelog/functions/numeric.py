"""Time windows, buckets, ratios and exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def in_window(observed: Column, as_of, seconds: int) -> Column:
    """Inclusive lower bound and no upper bound: rows after ``as_of`` count too."""
    return observed >= as_column(as_of) - F.lit(seconds)


def bucket(observed: Column, seconds: int) -> Column:
    """Start of the bucket that holds an epoch second; independent of any time zone."""
    return observed - F.pmod(observed, F.lit(seconds))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        F.try_divide(numerator.cast("double"), denominator.cast("double"))
    )


def nearest_rank(total: Column, fraction: float) -> Column:
    """1-based rank of the percentile among ``total`` sorted values, without interpolation."""
    rank = F.ceil(total.cast("double") * F.lit(fraction))
    return F.greatest(rank, F.lit(1)).cast("bigint")
