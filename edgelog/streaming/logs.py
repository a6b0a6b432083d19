"""Continuous ingest, hourly and rolling series, and residency on a stream of log rows.

Nothing here waits for a watermark, so no row is ever too late and no open hour is held back. Each micro-batch is
reduced alone to rows that add up (latency histograms, stretches of accesses) and written as one delta;
readers add the deltas up. A repeated micro-batch replaces its own delta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from edgelog.operators.cache import TTL, access_stretches, lifetimes
from edgelog.operators.metrics import COUNTS, DAY, HOUR, bucket_histogram, merge_histograms, summarize_histogram
from edgelog.schemas import REQUEST_LOGS
from edgelog.sources.logs import write_log_batch

HISTOGRAM = "observed_at_unix_secs long, latency_ms int, " + ", ".join(f"{c} long" for c in COUNTS)
STRETCHES = "cache_key string, stretch long, first long, last long, n long"


def read_log_stream(
    spark: SparkSession,
    path: str,
    schema: StructType = REQUEST_LOGS,
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files as they arrive in a directory; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start_batches(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Give each micro-batch to ``write``. Without an interval what is there is processed, then it ends."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return rows.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def ingest_stream(
    logs: DataFrame, dst: str, checkpoint: str, interval: str | None = None, name: str = "stream"
) -> StreamingQuery:
    """Append log rows by date, every row once. ``name`` tells streams into one log apart.

    A micro-batch has folders of its own below its dates, which a repetition replaces, so streams and
    ``append_request_logs`` write into the same log.
    """
    return start_batches(
        logs, lambda batch, batch_id: write_log_batch(batch, dst, f"{name}-{batch_id}"), checkpoint, interval
    )


# --- deltas --------------------------------------------------------------------------------------


def delta_stream(
    rows: DataFrame,
    reduce: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Write ``reduce`` of each micro-batch as a delta below ``root`` (one root per checkpoint)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")

    return start_batches(rows, write, checkpoint, interval)


def read_deltas(spark: SparkSession, root: str, schema: str, compacted: int | None = None) -> DataFrame:
    """All deltas; those up to ``compacted`` from what ``compact_deltas`` made of them."""
    deltas = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/deltas")
    if compacted is None:
        return deltas.drop("batch")
    base = spark.read.schema(schema).parquet(f"{root}/compacted/upto={compacted}")
    return base.unionByName(deltas.where(F.col("batch") > compacted).drop("batch"))


def compact_deltas(
    spark: SparkSession,
    root: str,
    schema: str,
    merge: Callable[[DataFrame], DataFrame],
    upto: int,
    compacted: int | None = None,
) -> None:
    """Merge the deltas up to batch ``upto`` (and an earlier compaction) into one table.

    What it replaces stays for readers that have begun; remove it once no reader names it.
    """
    deltas = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/deltas").where(F.col("batch") <= upto)
    if compacted is not None:
        deltas = deltas.where(F.col("batch") > compacted)
    rows = deltas.drop("batch")
    if compacted is not None:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{root}/compacted/upto={compacted}"))
    merge(rows).write.mode("overwrite").parquet(f"{root}/compacted/upto={upto}")


def merge_hours(deltas: DataFrame) -> DataFrame:
    return merge_histograms(deltas, "observed_at_unix_secs")


def merge_stretches(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("cache_key", "stretch").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )


def hourly_histogram_stream(logs: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the latency histogram of each hour up to date; read it with ``read_hourly_histogram``."""
    return delta_stream(logs, lambda batch: bucket_histogram(batch, HOUR), root, checkpoint, interval)


def read_hourly_histogram(spark: SparkSession, root: str, compacted: int | None = None) -> DataFrame:
    """One row per hour and distinct latency, of all rows that have arrived, ready for ``hourly_points``."""
    return merge_hours(read_deltas(spark, root, HISTOGRAM, compacted))


def rolling_histogram(hours: DataFrame, window: int = DAY) -> DataFrame:
    """Histogram of the ``window`` that ends at each full hour, from the histogram of the hours.

    An hour's counts come into the running histogram when the hour ends and leave it a window later, so at most three rows
    are shuffled for each row of an hour: window ends are divided into parts of a window's length, of which an hour
    reaches two, and into the second it is carried over. Everything else happens inside a part (column ``part``).
    """
    length = max(window, DAY)
    begins = F.col("observed_at_unix_secs") + HOUR
    leaves = begins + window
    first, last = F.floor(begins / length), F.floor((leaves - HOUR) / length)

    def change(part, at, sign: int):
        return F.struct(part.alias("part"), at.cast("long").alias("at"), F.lit(sign).alias("sign"))

    changes = F.array(
        change(first, begins, 1),
        F.when(last > first, change(last, last * length, 1)),
        F.when(F.floor(leaves / length) == last, change(last, leaves, -1)),
    )
    placed = hours.select("latency_ms", *COUNTS, F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c"))
    placed = placed.select("c.part", "c.at", "latency_ms", *[(F.col(c) * F.col("c.sign")).alias(c) for c in COUNTS])
    summed = placed.repartition("part").groupBy("part", "latency_ms", "at").agg(*[F.sum(c).alias(c) for c in COUNTS])
    order = Window.partitionBy("part", "latency_ms").orderBy("at")
    running = summed.select(
        "part",
        "latency_ms",
        "at",
        F.lead("at").over(order).alias("next"),
        *[F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in COUNTS],
    )
    until = F.coalesce("next", (F.col("part") + 1) * length) - HOUR
    ends = F.sequence(F.col("at"), until.cast("long"), F.lit(HOUR).cast("long"))
    return running.where("total_requests > 0").select(
        "part", F.explode(ends).alias("window_end_unix_secs"), "latency_ms", *COUNTS
    )


def rolling_points(hours: DataFrame, window: int = DAY) -> DataFrame:
    """Counts, rates and percentiles of the ``window`` that ends at each full hour; no further shuffle."""
    return summarize_histogram(rolling_histogram(hours, window), "part", "window_end_unix_secs").drop("part")


def residency_stream(
    accesses: DataFrame, root: str, checkpoint: str, ttl: int = TTL, interval: str | None = None
) -> StreamingQuery:
    """Keep stretches of ``accesses(cache_key, observed_at_unix_secs)``; a key has one row per stretch and batch."""
    return delta_stream(accesses, lambda batch: access_stretches(batch, ttl), root, checkpoint, interval)


def read_residency(spark: SparkSession, root: str, ttl: int = TTL, compacted: int | None = None) -> DataFrame:
    """Lifetimes of all accesses that have arrived, the open ones as they stand; see ``residency``."""
    return lifetimes(merge_stretches(read_deltas(spark, root, STRETCHES, compacted)), ttl)
