"""The cache as a table: views, upserts, hits, resolution of requests, residency.

``cache_entries`` has one row per key. A row whose expiry has not passed is fresh; a row that is
still there is a stale fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelog.functions import validate
from edgelog.functions.metadata import is_json
from edgelog.functions.numeric import as_column

TTL = 604_800


def cache_view(entries: DataFrame, as_of, mode: str = "fresh") -> DataFrame:
    """Entries that can answer a request at ``as_of``, fresh ones or (``stale``) any."""
    if mode == "stale":
        return entries
    if mode != "fresh":
        raise ValueError("mode must be 'fresh' or 'stale'")
    return entries.where(F.col("expires_at_unix_secs") >= as_column(as_of))


def fresh_entries(updates: DataFrame, ttl: int = TTL) -> DataFrame:
    """New entries for ``updates(cache_key, payload, fetched_at_unix_secs)``: no hits yet."""
    at = F.col("fetched_at_unix_secs")
    return updates.select(
        "cache_key",
        "payload",
        at.alias("created_at_unix_secs"),
        at.alias("last_success_unix_secs"),
        F.lit(0).cast("bigint").alias("hit_count"),
        (at + ttl).alias("expires_at_unix_secs"),
    )


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last of the updates of each key; of those fetched in the same second the one with the larger payload text."""
    values = F.struct("fetched_at_unix_secs", "payload")
    return updates.groupBy("cache_key").agg(F.max(values).alias("latest")).select("cache_key", "latest.*")


def upsert_cache(existing: DataFrame, updates: DataFrame, ttl: int = TTL) -> DataFrame:
    """The cache after the updates: the last write of a key wins, and any update beats the entry.

    Of updates of one key fetched in the same second the one with the larger payload text wins. Only
    the updates are aggregated; a few of them are broadcast, and then the cache is not shuffled.
    """
    new = fresh_entries(latest_updates(updates), ttl)
    kept = existing.join(new.select("cache_key"), "cache_key", "left_anti")
    return kept.select(*existing.columns).unionByName(new)


def record_hits(cache: DataFrame, accesses: DataFrame, ttl: int = TTL) -> DataFrame:
    """Count ``accesses(cache_key, accessed_at_unix_secs)`` and slide the expiry of the keys hit."""
    hits = accesses.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("_hits"), F.max("accessed_at_unix_secs").alias("_last")
    )
    return (
        cache.join(hits, "cache_key", "left")
        .withColumns(
            {
                "hit_count": F.col("hit_count") + F.coalesce(F.col("_hits"), F.lit(0)),
                "expires_at_unix_secs": F.greatest("expires_at_unix_secs", F.col("_last") + ttl),
            }
        )
        .select(*cache.columns)
    )


def resolve_requests(
    requests: DataFrame,
    cache: DataFrame,
    origin: DataFrame,
    as_of,
    max_bytes: int = validate.MAX_RESPONSE_BYTES,
) -> DataFrame:
    """Answer keyed requests: fresh entry, else good origin answer, else stale entry, else error.

    An entry whose payload cannot be read counts as missing. A key without an origin response was
    not asked for (its breaker was open). Cache and origin have one row per key each and are put
    together first, so that the requests, whose keys may be very uneven, are joined only once and
    adaptive execution can split a hot key.
    """
    kind = validate.classify_origin(F.col("status"), F.col("body"), max_bytes)
    entries = cache.select(
        "cache_key",
        F.when(is_json(F.col("payload")), F.col("payload")).alias("_payload"),
        F.col("expires_at_unix_secs").alias("_expires"),
    )
    answers = origin.select(
        "cache_key",
        kind.alias("_class"),
        F.when(kind == "ok", F.col("body")).alias("_body"),
        validate.origin_message(kind, F.col("status"), max_bytes).alias("_message"),
    )
    known = entries.join(answers, "cache_key", "full_outer")
    readable = F.col("_payload").isNotNull()
    source = (
        F.when(readable & (F.col("_expires") >= as_column(as_of)), F.lit("cache"))
        .when(F.col("_class") == "ok", F.lit("origin"))
        .when(readable, F.lit("stale_cache"))
    )
    error = F.when(
        F.col("source").isNull(),
        F.when(F.col("_class").isNull(), F.lit("origin_unavailable")).otherwise(
            F.lit("origin_error")
        ),
    )
    resolved = requests.join(known, "cache_key", "left").withColumn("source", source)
    return resolved.withColumn("error_code", error).select(
        *requests.columns,
        F.when(F.col("source") == "origin", F.col("_body"))
        .when(F.col("source").isNotNull(), F.col("_payload"))
        .alias("data"),
        F.col("source").isin("cache", "stale_cache").alias("cached"),
        (F.col("source") == "stale_cache").alias("stale"),
        "source",
        "error_code",
        F.when(F.col("error_code") == "origin_unavailable", F.lit(validate.UNAVAILABLE_MESSAGE))
        .when(F.col("error_code").isNotNull(), F.col("_message"))
        .alias("error_message"),
        validate.outcome_status(F.col("error_code")).alias("status_code"),
    )


def envelope(resolved: DataFrame) -> DataFrame:
    """The answer of each request as one struct; null for errors."""
    answer = F.struct("data", "cached", "stale", "source")
    return resolved.select(
        "request_id", F.when(F.col("error_code").isNull(), answer).alias("envelope")
    )


def access_stretches(accesses: DataFrame, ttl: int = TTL) -> DataFrame:
    """First, last and number of a key's accesses in each ``ttl``-aligned stretch of time."""
    at = F.col("observed_at_unix_secs")
    return accesses.groupBy("cache_key", F.expr(f"observed_at_unix_secs div {ttl}").alias("stretch")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")
    )


def lifetimes(stretches: DataFrame, ttl: int = TTL) -> DataFrame:
    """Lifetimes from one row per key and stretch."""
    by_time = Window.partitionBy("cache_key").orderBy("stretch")
    gap = F.col("first") - F.lag("last").over(by_time)
    marked = stretches.withColumn("starts", F.coalesce((gap > ttl).cast("int"), F.lit(1)))
    numbered = marked.withColumn(
        "lifetime",
        F.sum("starts").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    return (
        numbered.groupBy("cache_key", "lifetime")
        .agg(
            F.min("first").alias("created_at_unix_secs"),
            F.max("last").alias("last_access_unix_secs"),
            (F.sum("n") - 1).alias("hit_count"),
        )
        .drop("lifetime")
    )


def residency(accesses: DataFrame, ttl: int = TTL) -> DataFrame:
    """Cached lifetimes of each key under a sliding expiry of ``ttl`` seconds.

    Accesses at most ``ttl`` apart belong to one lifetime; the first of them fetches the entry.
    Accesses in the same ``ttl``-aligned stretch of time are never further apart, so they are
    reduced to one row before the shuffle, and a key has at most one row per stretch to order.
    """
    return lifetimes(access_stretches(accesses, ttl), ttl)
