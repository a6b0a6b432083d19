"""A stored gram index over labels, for searches that read only what their queries need.

Below its root:

- ``postings/part=P/delta=D``: lists of subjects by gram, as ``operators.triples.label_postings`` makes them of slices of labels;
- ``lengths/part=P/delta=D``: lang and lists (gram, n), how many subjects the lists of a slice have;
- ``texts/bucket=B/delta=D``: labels and abstracts by a hash of their subject.

A search reads the lengths in the parts of its queries' grams, then the postings in the parts of each query's rarest grams,
then the texts in the buckets of the subjects found there. New triples are added as deltas, which a
repetition replaces; lists of several deltas are put together, and a length that counts a subject twice only makes a
gram look less rare. Labels that are removed need the index to be built again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.operators.triples import (
    ABSTRACT,
    LABEL,
    POSTINGS,
    SEARCH_ROWS,
    first_abstracts,
    gram_lists,
    label_postings,
    rarest_grams,
    search_candidates,
    search_needles,
    search_rows,
    searched,
    wanted_grams,
)
from edgelog.session import written

#: Parts of the grams and buckets of the texts, of which a search names those that it reads.
PARTS, BUCKETS = 256, 256

_POSTINGS = POSTINGS.replace(" part int,", "")
_LENGTHS = "lang string, lists array<struct<gram: bigint, n: int>>"
_TEXTS = "subject string, lang string, abstract boolean, text string"


def _part() -> Column:
    """As ``label_postings`` deals grams, which are numbers without a sign there."""
    return F.pmod("gram", F.lit(PARTS)).cast("int")


def _bucket() -> Column:
    return F.pmod("key", F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, key: str, order: list[str], delta: int) -> None:
    """Large parts are divided over tasks, small ones are one file each; rows are in order inside a file."""
    rows = rows.withColumn("delta", F.lit(delta)).hint("rebalance", key).sortWithinPartitions(key, *order)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key, "delta").parquet(path)


def add_to_label_index(triples: DataFrame, root: str, delta: int) -> None:
    """Add the labels and abstracts of new triples; doing it again with the same number replaces them."""
    spark, text = triples.sparkSession, F.col("object")
    texts = triples.where(F.col("predicate").isin(LABEL, ABSTRACT) & (F.col("object_kind") == "literal")).select(
        "subject", "lang", (F.col("predicate") == ABSTRACT).alias("abstract"), text.alias("text"), F.hash("subject").alias("key")
    )
    _write(texts.withColumn("bucket", _bucket()).drop("key"), f"{root}/texts", "bucket", ["subject", "lang"], delta)
    own = spark.read.schema(f"{_TEXTS}, bucket int, delta int").parquet(f"{root}/texts")
    labels = own.where((F.col("delta") == delta) & ~F.col("abstract")).select("subject", "lang", *searched(F.col("text")))
    _write(label_postings(labels, PARTS), f"{root}/postings", "part", ["lang"], delta)
    postings = spark.read.schema(f"{POSTINGS}, delta int").parquet(f"{root}/postings").where(F.col("delta") == delta)
    lengths = F.transform("lists", lambda x: F.struct(x["gram"].alias("gram"), x["n"].alias("n"))).alias("lists")
    _write(postings.select("part", "lang", lengths), f"{root}/lengths", "part", ["lang"], delta)


def write_label_index(triples: DataFrame, root: str) -> None:
    """Build the index below a new root."""
    add_to_label_index(triples, root, 0)


def _read(spark: SparkSession, root: str, name: str, schema: str, key: str, wanted: DataFrame) -> DataFrame:
    """Only the folders of the parts that occur in ``wanted``: a number of known bound, whatever its rows."""
    parts = [row[0] for row in wanted.distinct().collect()]
    rows = spark.read.schema(f"{schema}, {key} int, delta int").parquet(f"{root}/{name}")
    return rows.where(F.col(key).isin(parts) if parts else F.lit(False)).drop(key, "delta")


def search_label_index(spark: SparkSession, root: str, queries: DataFrame, limit: int = SEARCH_ROWS) -> DataFrame:
    """``label_search`` of the triples in the index."""
    needles = search_needles(queries, limit)
    wanted = wanted_grams(needles)
    lengths = _read(spark, root, "lengths", _LENGTHS, "part", wanted.select(_part()))
    lengths = lengths.select("lang", F.inline("lists")).join(wanted.select("lang", "gram").distinct(), ["lang", "gram"], "left_semi")
    lengths = lengths.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    chosen = written(rarest_grams(wanted, lengths), "rarest_grams")
    postings = _read(spark, root, "postings", _POSTINGS, "part", chosen.select(_part()))
    candidates = written(search_candidates(needles, chosen, gram_lists(postings)), "search_candidates")
    texts = _read(spark, root, "texts", _TEXTS, "bucket", candidates.select(_bucket()))
    labels = texts.where("NOT abstract").select(
        "subject", "lang", F.col("text").alias("label"), *searched(F.col("text"))
    )
    abstracts = texts.where("abstract").select(
        "subject", F.lit(ABSTRACT).alias("predicate"), F.col("text").alias("object"), F.lit("literal").alias("object_kind"), "lang"
    )
    return search_rows(candidates, labels, first_abstracts(abstracts))
