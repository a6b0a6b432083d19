"""Breaker transitions on a stream of call outcomes, in whatever order they arrive.

Calls are kept by day. Of each endpoint's hour the state holds its totals, which join with those of other
hours to what any hour starts from. A micro-batch makes the totals of the hours anew that its calls belong to, sees which other
hours now start from something else, and folds the calls of these hours alone again, spread over all tasks however uneven
the endpoints are. Its transitions replace those that earlier batches found in the same hours, so that a late call
corrects what was said before: ``read_transitions`` is always what ``operators.health`` gives for all calls so far.

A repeated batch starts from the same state and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgelog.operators.health import (
    COOLDOWN,
    DEFAULT_ENDPOINT,
    THRESHOLD,
    carried_over,
    era_of,
    hour_totals,
    rejected_calls,
    runs_from,
    scan_slices,
    slice_totals,
    transitions_of,
)
from edgelog.session import written
from edgelog.sources.state import SNAPSHOT_EVERY, commit_state, last_batch, read_state
from edgelog.streaming.logs import start_batches

CALLS = "endpoint string, ts long, seq long, ok boolean"
HOURS = "endpoint string, era long, fails long, resets long, last_ts long, last_seq long, last_success long, batch long"
FOLDED = "endpoint string, era long, batch long"
TRANSITIONS = "endpoint string, seq long, era long, at_unix_secs long, from_state string, to_state string, batch long"
HOUR = ["endpoint", "era"]
ERAS_A_DAY = 24


def latest_hours(rows: DataFrame) -> DataFrame:
    """Of each endpoint's hour the row of the last batch."""
    others = [c for c in rows.columns if c not in HOUR]
    last = rows.groupBy(*HOUR).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*HOUR, "_last.*")


def read_transitions(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """Transitions of all calls up to and with ``batch`` (the last one)."""
    batch = last_batch(spark, f"{root}/folded") if batch is None else batch
    rows = spark.read.schema(TRANSITIONS).parquet(f"{root}/transitions").where(F.col("batch") <= batch)
    folded = read_state(spark, f"{root}/folded", FOLDED, latest_hours, batch)
    return rows.join(folded, [*HOUR, "batch"], "left_semi").drop("era", "batch")


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    """Calls without a time, a number or an outcome."""
    return spark.read.schema(CALLS).parquet(f"{root}/rejected/batch=*")


def read_hours(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Totals of each endpoint's hours after ``batch``; none for -1."""
    return read_state(spark, f"{root}/hours", HOURS, latest_hours, batch)


def read_endpoints(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """How the calls of each endpoint end: failures in a row, last call, last success."""
    every = F.sum("fails").over(Window.partitionBy("endpoint").orderBy("era"))
    hours = read_hours(spark, root, batch).withColumn("upto", every)
    ends = hours.groupBy("endpoint").agg(
        F.sum("fails").alias("fails"),
        F.max(F.col("upto") - F.col("fails") + F.col("resets")).alias("reset"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("last_seq", "era").alias("last_seq"),
        F.max("last_success").alias("last_success_unix_secs"),
    )
    left = F.col("fails") - F.coalesce("reset", F.lit(0))
    return ends.select("endpoint", left.alias("failure_count"), "last_ts", "last_seq", "last_success_unix_secs")


def _calls_of(spark: SparkSession, root: str, hours: DataFrame, batch: int) -> DataFrame:
    """The calls of some hours; only the days of these are read (a list of days, as long as the calendar)."""
    days = [r[0] for r in hours.select(F.expr(f"era div {ERAS_A_DAY}")).distinct().collect()]
    calls = spark.read.schema(f"{CALLS}, batch long, day long").parquet(f"{root}/calls")
    calls = calls.where((F.col("batch") <= batch) & F.col("day").isin(days)).withColumn("era", era_of())
    return calls.join(hours.select(*HOUR), HOUR, "left_semi").select("endpoint", "ts", "seq", "ok")


def _starts(hours: DataFrame, suffix: str) -> DataFrame:
    """What the breaker knows when an hour starts: failures in a row, and when the last call was."""
    return carried_over(hours).select(
        *HOUR,
        (F.col("era_fails") - F.coalesce("era_reset", F.lit(0))).alias(f"failures{suffix}"),
        F.col("era_ts").alias(f"ts{suffix}"),
    )


def fold_batch(
    calls: DataFrame,
    batch_id: int,
    root: str,
    threshold: int = THRESHOLD,
    cooldown: int = COOLDOWN,
    every: int = SNAPSHOT_EVERY,
) -> None:
    """Take in one micro-batch: keep its calls, totals of its hours, and transitions of the hours that it changes."""
    spark = calls.sparkSession
    calls = calls.select(F.coalesce("endpoint", F.lit(DEFAULT_ENDPOINT)).alias("endpoint"), "ts", "seq", "ok")
    calls = written(calls, "calls")
    rejected_calls(calls).write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
    usable = calls.where("ts IS NOT NULL AND seq IS NOT NULL AND ok IS NOT NULL")
    by_day = usable.withColumn("day", F.expr(f"ts div {ERAS_A_DAY * 3_600}")).hint("rebalance", "day")
    by_day = by_day.sortWithinPartitions("day", "endpoint", "ts")
    by_day.write.mode("overwrite").partitionBy("day").parquet(f"{root}/calls/batch={batch_id}")

    touched = written(usable.select("endpoint", era_of().alias("era")).distinct(), "touched_hours")
    totals = hour_totals(slice_totals(scan_slices(_calls_of(spark, root, touched, batch_id))))
    new = written(totals.withColumn("batch", F.lit(batch_id).cast("long")), "hour_totals")
    old = read_hours(spark, root, batch_id - 1)
    commit_state(new, f"{root}/hours", HOURS, latest_hours, batch_id, every)

    hours = latest_hours(old.unionByName(new))
    both = _starts(hours, "_now").join(_starts(old, "_then"), HOUR)
    moved = both.where("NOT (failures_now <=> failures_then AND ts_now <=> ts_then)").select(*HOUR)
    again = written(touched.unionByName(moved).distinct(), "folded_hours")
    scanned = scan_slices(_calls_of(spark, root, again, batch_id))
    runs = runs_from(scanned, slice_totals(scanned), carried_over(hours))
    found = transitions_of(runs, threshold, cooldown, (era_of().alias("era"),))
    found.write.mode("overwrite").parquet(f"{root}/transitions/batch={batch_id}")
    folded = again.withColumn("batch", F.lit(batch_id).cast("long"))
    commit_state(folded, f"{root}/folded", FOLDED, latest_hours, batch_id, every)


def breaker_stream(
    calls: DataFrame,
    root: str,
    checkpoint: str,
    interval: str | None = None,
    threshold: int = THRESHOLD,
    cooldown: int = COOLDOWN,
) -> StreamingQuery:
    """Fold ``calls(endpoint, ts, seq, ok)`` batch by batch below ``root`` (one root per checkpoint)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, batch_id, root, threshold, cooldown)

    return start_batches(calls, write, checkpoint, interval)
