"""JSON output that keeps null members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.operators.metrics import DAY, HOUR


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def series_document(points: DataFrame, window: int = DAY, bucket: int = HOUR) -> DataFrame:
    """A time series as one JSON text, also without points; it has at most one point per bucket of the window."""
    point = F.struct(
        "observed_at_unix_secs", "total_requests", "cache_hit_rate", "stale_response_rate", "p95_latency_ms"
    )
    gathered = points.agg(F.array_sort(F.collect_list(point)).alias("points"))
    document = F.struct(
        F.lit(window).alias("rolling_window_seconds"), F.lit(bucket).alias("bucket_seconds"), "points"
    )
    return gathered.select(F.to_json(document).alias("json"))


def error_bodies(answers: DataFrame) -> DataFrame:
    """request_id and the JSON body of each answer or rejection with an error; null for the others."""
    body = F.struct(F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")).alias("error"))
    return answers.select("request_id", F.when(F.col("error_code").isNotNull(), F.to_json(body)).alias("body"))
