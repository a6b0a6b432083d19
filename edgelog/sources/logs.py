"""The request log: parquet by date, a relational copy, appends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.functions.metadata import typed
from edgelog.functions.numeric import as_column
from edgelog.schemas import METRIC_COLUMNS, REQUEST_LOGS

INT_MAX = 2**31 - 1
SMALLINT_MAX = 2**15 - 1
DAY = 86_400


def observed_date(observed: Column) -> Column:
    """UTC date of an epoch second, whatever the session's zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(observed / DAY).cast("int"))


def metric_rows(logs: DataFrame, since=None) -> DataFrame:
    """The five columns metrics need, from ``since`` (epoch seconds, inclusive) on."""
    if since is not None:
        logs = logs.where(F.col("observed_at_unix_secs") >= as_column(since))
        if "observed_date" in logs.columns:
            # Catalyst does not derive the partition predicate from the one on seconds.
            first = observed_date(as_column(since).cast("bigint"))
            logs = logs.where(F.col("observed_date") >= first)
    return logs.select(*METRIC_COLUMNS)


def with_typed_metadata(logs: DataFrame) -> DataFrame:
    """Log rows whose ``metadata`` is a VARIANT; a log has either these rows or such with JSON text."""
    return logs.withColumn("metadata", typed(F.col("metadata")))


def open_logs(spark: SparkSession, path: str, typed_metadata: bool = False) -> DataFrame:
    """All columns of a log written by ``append_request_logs`` and ``ingest_stream``."""
    schema = REQUEST_LOGS.simpleString()[len("struct<") : -1].replace(":", " ")
    if typed_metadata:
        schema = schema.replace("metadata string", "metadata variant")
    return spark.read.schema(schema + ", observed_date date, batch string").parquet(path).drop("batch")


def read_request_logs(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Time-bounded scan of the metric columns; prunes partitions, columns and row groups."""
    return metric_rows(open_logs(spark, path), since)


def read_request_logs_jdbc(
    spark: SparkSession,
    url: str,
    bounds: tuple[int, int],
    table: str = "request_logs",
    properties: dict | None = None,
    partitions: int = 8,
    since=None,
) -> DataFrame:
    """The metric columns of the log in a relational store, from ``since`` on, read in parallel over ranges of ``id``.

    ``bounds`` only say how ids are cut into ranges; rows beyond them are read as well. Columns and the
    time bound are pushed down to the store.
    """
    lower, upper = bounds
    rows = spark.read.jdbc(
        url,
        table,
        column="id",
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
    return metric_rows(rows, since)


def narrow_logs(logs: DataFrame) -> DataFrame:
    """Clamp latency and status to the widths of the log's columns."""
    latency = F.least(F.col("latency_ms"), F.lit(INT_MAX)).cast("int")
    status = F.least(F.col("status_code"), F.lit(SMALLINT_MAX)).cast("smallint")
    return logs.withColumns({"latency_ms": latency, "status_code": status})


def log_rows(logs: DataFrame) -> DataFrame:
    """Rows as they are stored, with the date they are partitioned by."""
    return narrow_logs(logs).select(
        *REQUEST_LOGS.fieldNames(),
        observed_date(F.col("observed_at_unix_secs")).alias("observed_date"),
    )


def write_log_batch(logs: DataFrame, path: str, batch: str) -> None:
    """Write rows into the log under a batch name of their own; doing it again replaces them.

    The layout is ``observed_date=../batch=..``: dates are pruned, and batches of any writer lie side by side.
    The rebalance brings a date's rows together, splits dates that are too large for one task and
    joins small ones, so that neither one huge task nor many small files result. Rows are sorted by time
    inside each file so that row groups can be skipped.
    """
    rows = log_rows(logs).withColumn("batch", F.lit(batch)).hint("rebalance", "observed_date")
    rows = rows.sortWithinPartitions("observed_date", "observed_at_unix_secs")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("observed_date", "batch").parquet(path)


def append_request_logs(logs: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to the log; with a ``batch`` name a repetition replaces what it wrote before."""
    write_log_batch(logs, path, batch or f"append-{uuid.uuid4().hex}")
