"""Refreshing the cache for the most requested entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.functions.keys import request_key
from edgelog.functions.numeric import as_column
from edgelog.functions.validate import resource_iri
from edgelog.operators.cache import TTL, upsert_cache
from edgelog.operators.popular import entity_hits, most_requested
from edgelog.operators.triples import ENTITY_ROWS, entity_lookup
from edgelog.session import written


def skip_recent(candidates: DataFrame, cache: DataFrame, min_age: int, as_of) -> DataFrame:
    """Candidates whose entry was not fetched within the last ``min_age`` seconds."""
    recent = cache.where(F.col("last_success_unix_secs") > as_column(as_of) - min_age)
    return candidates.join(
        recent.select(F.col("cache_key").alias("query_hash")), "query_hash", "left_anti"
    )


def fetch_entities(candidates: DataFrame, triples: DataFrame) -> DataFrame:
    """Candidates with the JSON of their facts; a candidate without an entity gets no payload.

    An entity nothing is known about is still an answer, an empty list. Candidates are few (their number is a
    parameter), so they are sent to the triples, which are read but not shuffled for other subjects.
    """
    asked = candidates.withColumn("subject", resource_iri(F.col("entity_id"), F.col("lang")))
    requests = asked.where(F.col("subject").isNotNull()).select("subject", "lang")
    triples = triples.join(F.broadcast(requests.select("subject").distinct()), "subject", "left_semi")
    fact = ["label", "abstract", "property", "value"]
    facts = entity_lookup(triples, requests, ENTITY_ROWS).withColumn(
        "fact", F.when(F.coalesce(*fact).isNotNull(), F.struct(*fact))
    )
    # At most ENTITY_ROWS facts per entity.
    payloads = facts.groupBy("subject", "lang").agg(
        F.to_json(F.array_sort(F.collect_list("fact")), {"ignoreNullFields": "false"}).alias("payload")
    )
    return asked.join(payloads, ["subject", "lang"], "left").drop("subject")


def refreshed_entries(fetched: DataFrame, as_of) -> DataFrame:
    """Cache updates of the candidates that were answered."""
    key = F.coalesce(
        F.nullif(F.col("query_hash"), F.lit("")),
        request_key(F.lit("entity"), F.col("entity_id"), F.col("lang"), F.col("endpoint")),
    )
    return fetched.where(F.col("payload").isNotNull()).select(
        key.alias("cache_key"),
        "payload",
        as_column(as_of).cast("bigint").alias("fetched_at_unix_secs"),
    )


def warm_result(fetched: DataFrame) -> DataFrame:
    """How many candidates were refreshed and how many failed."""
    return fetched.agg(
        F.count_if(F.col("payload").isNotNull()).alias("refreshed"),
        F.count_if(F.col("payload").isNull()).alias("failed"),
    )


def fetched_updates(candidates: DataFrame, triples: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Cache updates of the candidates, and the run's counters. What was fetched is written once: a row per candidate."""
    fetched = written(fetch_entities(candidates, triples), "warm_fetched")
    return refreshed_entries(fetched, as_of), warm_result(fetched)


def warm_updates(
    hits: DataFrame,
    triples: DataFrame,
    cache: DataFrame,
    as_of,
    k: int = 25,
    min_age: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Updates for the ``k`` most requested entities of ``hits``, and the run's counters."""
    candidates = most_requested(hits, k)
    if min_age is not None:
        candidates = skip_recent(candidates, cache, min_age, as_of)
    return fetched_updates(written(candidates, "warm_candidates"), triples, as_of)


def warm_cache(
    logs: DataFrame,
    triples: DataFrame,
    cache: DataFrame,
    as_of,
    k: int = 25,
    ttl: int = TTL,
    min_age: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The cache after refreshing the ``k`` most requested entities, and the run's counters."""
    updates, result = warm_updates(entity_hits(logs), triples, cache, as_of, k, min_age)
    return upsert_cache(cache, updates, ttl), result
