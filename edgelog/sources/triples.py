"""Triples on disk, partitioned by predicate so that lookups read only what they name.

As a table they are also in buckets of their subjects, in order: entity lookups then bring the requests to the triples,
which are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgelog.schemas import TRIPLES


def write_triples(triples: DataFrame, path: str) -> None:
    """Large predicates are divided, small ones kept in one file each; subjects are sorted, so row groups can be skipped."""
    rows = triples.hint("rebalance", "predicate").sortWithinPartitions("predicate", "subject")
    rows.write.partitionBy("predicate").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Filters on ``predicate`` become partition filters."""
    return spark.read.schema(TRIPLES).parquet(path).select(*TRIPLES.fieldNames())


def write_triple_table(triples: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> None:
    """A table of the session's catalog, by predicate and in ``buckets`` of subjects; each task writes one bucket.

    There are as many buckets as a shuffle has partitions unless told otherwise: of fewer ones Spark would rather shuffle the
    triples than use so few tasks. A bucket is read by one task, so this is for subjects of many sizes but none that has most triples; ``write_triples``
    divides such ones.
    """
    buckets = buckets or int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = triples.select(*TRIPLES.fieldNames()).repartition(buckets, "subject")
    rows = rows.sortWithinPartitions("predicate", "subject")
    writer = rows.write.mode("overwrite").partitionBy("predicate").bucketBy(buckets, "subject").sortBy("subject")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_triple_table(spark: SparkSession, name: str, subjects: DataFrame | None = None) -> DataFrame:
    """The triples, or those of ``subjects(subject)``: these are brought to the buckets, before anything is put in order."""
    rows = spark.table(name).select(*TRIPLES.fieldNames())
    return rows if subjects is None else rows.join(subjects.select("subject").distinct(), "subject", "left_semi")
