"""State that micro-batches keep: deltas, and snapshots that a manifest names.

Below its root, ``deltas/batch=B`` is what batch B adds, ``snapshots/batch=B`` is the merged state after B, and
``manifest/batch=B`` says in one row from which snapshot on the deltas up to B have to be read. A batch commits all three itself,
the manifest last, so a repeated batch replaces what it wrote, and readers of an earlier batch see what they saw. Paths are
read by their names; nothing lists the folders of all batches, and at most ``every`` deltas are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A snapshot is made after so many batches.
SNAPSHOT_EVERY = 8

Merge = Callable[[DataFrame], DataFrame]


def _snapshot(spark: SparkSession, root: str, batch: int) -> int:
    """The snapshot that the state after ``batch`` starts from; -1 is the empty one before the first batch."""
    if batch < 0:
        return -1
    return spark.read.schema("snapshot long").parquet(f"{root}/manifest/batch={batch}").first()[0]


def last_batch(spark: SparkSession, root: str) -> int:
    """The last batch that was committed."""
    manifests = spark.read.schema("snapshot long, batch long").parquet(f"{root}/manifest")
    return manifests.agg(F.max("batch")).first()[0]


def state_paths(spark: SparkSession, root: str, batch: int, snapshot: int | None = None) -> list[str]:
    """The folders that hold the state after ``batch``."""
    first = _snapshot(spark, root, batch) if snapshot is None else snapshot
    base = [f"{root}/snapshots/batch={first}"] if first >= 0 else []
    return base + [f"{root}/deltas/batch={b}" for b in range(first + 1, batch + 1)]


def read_state(
    spark: SparkSession, root: str, schema: str, merge: Merge, batch: int, snapshot: int | None = None
) -> DataFrame:
    """The merged state after ``batch``; empty for -1."""
    paths = state_paths(spark, root, batch, snapshot)
    if not paths:
        return spark.createDataFrame([], schema)
    return merge(spark.read.schema(schema).parquet(*paths))


def commit_state(
    rows: DataFrame, root: str, schema: str, merge: Merge, batch: int, every: int = SNAPSHOT_EVERY
) -> None:
    """Add ``rows`` as the delta of ``batch``, the one after the last that was committed (or that one again)."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/deltas/batch={batch}")
    first = _snapshot(spark, root, batch - 1)
    if batch - first >= every:
        whole = read_state(spark, root, schema, merge, batch, first)
        whole.write.mode("overwrite").parquet(f"{root}/snapshots/batch={batch}")
        first = batch
    manifest = spark.range(1).select(F.lit(first).cast("long").alias("snapshot")).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest/batch={batch}")
