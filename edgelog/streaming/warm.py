"""Periodic warming.

Hits add up, so each tick counts only the log rows that are new and adds them to the hits that earlier ticks have kept: a
snapshot that the ticks themselves renew, and the deltas after it. Of the cache a tick reads and writes the
buckets of its candidates. So what a tick reads follows the new rows and the number of keys, not the number of ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgelog.operators.cache import TTL, fresh_entries
from edgelog.operators.popular import HITS, entity_hits, merge_hits, most_requested
from edgelog.operators.warm import fetched_updates, skip_recent
from edgelog.session import written
from edgelog.sources.cache_store import lookup_cache, update_cache, version_path
from edgelog.sources.state import SNAPSHOT_EVERY, commit_state, last_batch, read_state
from edgelog.streaming.logs import start_batches


def read_hits(spark: SparkSession, cache_root: str, batch: int | None = None) -> DataFrame:
    """Hits of all log rows up to a tick (the last one)."""
    root = f"{cache_root}-hits"
    return read_state(spark, root, HITS, merge_hits, last_batch(spark, root) if batch is None else batch)


def warm_batch(
    logs: DataFrame,
    batch_id: int,
    triples: DataFrame,
    cache_root: str,
    k: int = 25,
    ttl: int = TTL,
    min_age: int | None = None,
    as_of=None,
    every: int = SNAPSHOT_EVERY,
) -> None:
    """Make cache version ``batch_id + 1`` from ``batch_id``; a repeated batch makes it again.

    ``as_of`` is by default the time of the last new log row.
    """
    spark = logs.sparkSession
    commit_state(entity_hits(logs), f"{cache_root}-hits", HITS, merge_hits, batch_id, every)
    if as_of is None:
        as_of = logs.agg(F.max("observed_at_unix_secs")).first()[0]
    candidates = written(most_requested(read_hits(spark, cache_root, batch_id), k), "warm_candidates")
    if min_age is not None:
        keys = candidates.select(F.col("query_hash").alias("cache_key"))
        cache = lookup_cache(spark, cache_root, batch_id, keys)
        candidates = written(skip_recent(candidates, cache, min_age, as_of), "warm_due")
    updates, result = fetched_updates(candidates, triples, as_of)
    # Candidates have different keys or, with equal ones, equal payloads and times.
    update_cache(fresh_entries(updates.dropDuplicates(["cache_key"]), ttl), cache_root, batch_id + 1)
    result.write.mode("overwrite").parquet(version_path(f"{cache_root}-results", batch_id + 1))


def warm_stream(
    logs: DataFrame,
    triples: DataFrame,
    cache_root: str,
    checkpoint: str,
    k: int = 25,
    ttl: int = TTL,
    interval: str | None = "1 hour",
    min_age: int | None = None,
) -> StreamingQuery:
    """Warm at once and then every ``interval`` in which the log stream has new rows.

    Ticks missed while a run is busy are skipped, as triggers are. ``cache_root`` must hold version 0.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        warm_batch(batch, batch_id, triples, cache_root, k, ttl, min_age)

    return start_batches(logs, write, checkpoint, interval)
