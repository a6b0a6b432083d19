"""Rolling summary, time series and what a dashboard derives from them.

Every figure comes from a latency histogram: one row per bucket and distinct latency, with the
counts of the requests that took so long. Building it is a hash aggregation that combines on the
map side, so a bucket that holds most requests is reduced before the shuffle, and only the
histogram (at most one row per distinct millisecond value) is ordered to find a percentile.
Histograms of disjoint data add up, which percentiles do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelog.functions.numeric import bucket as bucket_of
from edgelog.functions.numeric import in_window, nearest_rank, ratio

COUNTS = ("total_requests", "cache_hits", "stale_responses", "origin_errors")
P95 = {"p95_latency_ms": 0.95}
DAY = 86_400
HOUR = 3_600


def latency_histogram(logs: DataFrame, *by: str) -> DataFrame:
    """Request counts per distinct latency (and per ``by`` columns)."""
    origin_error = (F.col("status_code") >= 500) & ~F.col("stale")
    return logs.groupBy(*by, "latency_ms").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(F.col("stale")).alias("stale_responses"),
        F.count_if(origin_error).alias("origin_errors"),
    )


def merge_histograms(histograms: DataFrame, *by: str) -> DataFrame:
    """Add histograms up, for example hours to a day."""
    return histograms.groupBy(*by, "latency_ms").agg(*[F.sum(c).alias(c) for c in COUNTS])


def summarize_histogram(histogram: DataFrame, *by: str, percentiles=P95) -> DataFrame:
    """Counts, rates and exact nearest-rank percentiles per ``by`` columns.

    Without ``by`` columns there is always one row, of zeros if the histogram is empty.
    """
    ordered = Window.partitionBy(*by).orderBy("latency_ms")
    ranked = histogram.select(
        "*",
        F.sum("total_requests")
        .over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("_upto"),
        F.sum("total_requests")
        .over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_all"),
    )
    reached = {
        name: F.col("_upto") >= nearest_rank(F.col("_all"), fraction)
        for name, fraction in percentiles.items()
    }
    zero = F.lit(0).cast("bigint")
    sums = ranked.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in COUNTS],
        *[
            F.coalesce(F.min(F.when(hit, F.col("latency_ms"))).cast("bigint"), zero).alias(name)
            for name, hit in reached.items()
        ],
    )
    total = F.col("total_requests")
    return sums.select(
        *by,
        *COUNTS,
        ratio(F.col("cache_hits"), total).alias("cache_hit_rate"),
        ratio(F.col("stale_responses"), total).alias("stale_response_rate"),
        ratio(F.col("origin_errors"), total).alias("origin_error_rate"),
        *percentiles,
    )


def summarize(logs: DataFrame, as_of, window: int = DAY, percentiles=P95) -> DataFrame:
    """One row over the rolling window that ends at ``as_of`` (epoch seconds, or a column)."""
    rows = logs.where(in_window(F.col("observed_at_unix_secs"), as_of, window))
    summary = summarize_histogram(latency_histogram(rows), percentiles=percentiles)
    return summary.select(F.lit(window).cast("bigint").alias("rolling_window_seconds"), "*")


def hourly_points(histogram: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Points of a series from a histogram kept per ``observed_at_unix_secs`` bucket."""
    return summarize_histogram(histogram, "observed_at_unix_secs").select(
        F.lit(bucket).cast("bigint").alias("bucket_seconds"),
        "observed_at_unix_secs",
        "total_requests",
        "cache_hit_rate",
        "stale_response_rate",
        "p95_latency_ms",
    )


def bucket_histogram(logs: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Latency histogram per time bucket; the roll-up to keep for long ranges."""
    start = bucket_of(F.col("observed_at_unix_secs"), bucket)
    return latency_histogram(
        logs.withColumn("observed_at_unix_secs", start), "observed_at_unix_secs"
    )


def timeseries(logs: DataFrame, as_of, window: int = DAY, bucket: int = HOUR) -> DataFrame:
    """One point per non-empty bucket of the rolling window, in ascending order."""
    rows = logs.where(in_window(F.col("observed_at_unix_secs"), as_of, window))
    points = hourly_points(bucket_histogram(rows, bucket), bucket)
    return points.select(
        F.lit(window).cast("bigint").alias("rolling_window_seconds"), "*"
    ).orderBy("observed_at_unix_secs")


#: Rows that a step of ``fill_gaps`` makes of one.
FAN = 256


def fill_gaps(points: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Add zero points for the empty buckets between the first and the last point.

    Buckets are counted from the first point and made in three steps, of which each divides a stretch: no row
    ever holds more than ``FAN`` of them (or one for each ``FAN * FAN`` buckets), and long stretches are dealt over tasks.
    """
    last_bucket = F.expr(f"CAST((max(observed_at_unix_secs) - min(observed_at_unix_secs)) div {bucket} AS bigint)")
    span = points.agg(F.min("observed_at_unix_secs").alias("first"), last_bucket.alias("n"))
    step = F.lit(FAN * FAN).cast("bigint")
    wide = span.select("first", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), "n", step)).alias("k"))
    wide = wide.repartition("k")
    for size, into in ((FAN * FAN, FAN), (FAN, 1)):
        until = F.least(F.col("n"), F.col("k") + size - 1)
        wide = wide.select("first", "n", F.explode(F.sequence(F.col("k"), until, F.lit(into).cast("bigint"))).alias("k"))
    every = wide.select((F.col("first") + F.col("k") * bucket).alias("observed_at_unix_secs"))
    measures = ["total_requests", "cache_hit_rate", "stale_response_rate", "p95_latency_ms"]
    known = points.select("observed_at_unix_secs", *measures)
    return every.join(known, "observed_at_unix_secs", "left").na.fill(0, measures)


def busiest_hour(points: DataFrame) -> DataFrame:
    """The bucket with most requests, the earliest of equals; no row if there are no points."""
    start, total = F.col("observed_at_unix_secs"), F.col("total_requests")
    best = points.agg(F.max_by(F.struct(start, total), F.struct(total, -start)).alias("best"))
    return best.where(F.col("best").isNotNull()).select("best.*")


def latest_hour(points: DataFrame) -> DataFrame:
    """Requests of the last bucket; no row if there are no points."""
    start, total = F.col("observed_at_unix_secs"), F.col("total_requests")
    last = points.agg(F.max_by(F.struct(start, total), start).alias("last"))
    return last.where(F.col("last").isNotNull()).select("last.*")
