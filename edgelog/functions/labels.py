"""Texts a dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_source(error_code: Column, stale: Column, source: Column) -> Column:
    """Errors win over stale answers, those over the plain source; ``idle`` if there is none."""
    return (
        F.when(error_code.isNotNull(), F.lit("error"))
        .when(stale, F.lit("stale"))
        .otherwise(F.coalesce(source, F.lit("idle")))
    )


def percent_label(share: Column) -> Column:
    """Whole percent, halves rounded up; ``0%`` for null and non-finite values."""
    # IEEE comparison: NaN sorts above every number in Spark, so test the magnitude.
    finite = F.abs(share) < F.lit(float("inf"))
    rounded = F.floor(share * 100 + 0.5).cast("bigint").cast("string")
    return F.when(finite, F.concat(rounded, F.lit("%"))).otherwise(F.lit("0%"))


def number_label(value: Column) -> Column:
    """Digits grouped by thousands; 0 for null."""
    return F.format_number(F.coalesce(value, F.lit(0)), 0)


def bucket_label(observed: Column, zone: str = "UTC") -> Column:
    """HH:mm of an epoch second in the given zone, whatever the session's zone is."""
    # Shift the instant to a zone-less wall clock, so that the session zone plays no part.
    shift = F.convert_timezone(
        F.lit("UTC"),
        F.lit(zone),
        F.timestamp_add("SECOND", observed, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
    )
    return F.date_format(shift, "HH:mm")


def payload_bytes(payload: Column) -> Column:
    return F.octet_length(payload).cast("bigint")
