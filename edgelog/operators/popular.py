"""Most requested entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.functions.metadata import has_key, typed_has_key, typed_meta


HITS = "entity_id string, query_hash string, lang string, endpoint string, hits long"
KEY = ["entity_id", "query_hash", "lang", "endpoint"]


def entity_hits(logs: DataFrame) -> DataFrame:
    """Hits per entity, key, language and endpoint, over the rows that name an entity.

    ``metadata`` is JSON text or a VARIANT, from which the fields are read without parsing.
    """
    if dict(logs.dtypes)["metadata"] == "variant":
        fields = [typed_meta(F.col("metadata"), c).alias(c) for c in ("entity_id", "lang", "endpoint")]
        entities = logs.where((F.col("route") == "entity") & typed_has_key(F.col("metadata"), "entity_id"))
        return _counted(entities.select("query_hash", *fields))
    fields = F.json_tuple("metadata", "entity_id", "lang", "endpoint").alias("entity_id", "lang", "endpoint")
    rows = logs.where(F.col("route") == "entity").select("query_hash", "metadata", fields)
    # A member that is there but null names an entity too; only then the keys are looked at.
    named = rows.where(F.when(F.col("entity_id").isNotNull(), True).otherwise(has_key(F.col("metadata"), "entity_id")))
    return _counted(named)


def _counted(named: DataFrame) -> DataFrame:
    keyed = named.withColumn("lang", F.coalesce("lang", F.lit("en")))
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("hits"))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits of disjoint rows, added up."""
    return hits.groupBy(*KEY).agg(F.sum("hits").alias("hits"))


def most_requested(hits: DataFrame, k: int = 25) -> DataFrame:
    """Top ``k`` by hits; ties by entity, key, language and endpoint."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return hits.orderBy(F.desc("hits"), *[F.asc_nulls_first(c) for c in KEY]).limit(k)


def popular_entities(logs: DataFrame, k: int = 25) -> DataFrame:
    return most_requested(entity_hits(logs), k)
