"""The registered queries: each operator over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.functions import keys, labels, metadata, validate
from edgelog.functions.numeric import in_window
from edgelog.functions.text import normalize_ws
from edgelog.operators import cache, health, metrics, popular, requests, triples, warm
from edgelog.schemas import REQUEST_LOGS
from edgelog.session import new_shared_path
from edgelog.sources import cache_store, derived, json_lines, label_index, logs as log_store
from edgelog.sources import triples as triple_store
from edgelog.streaming import health as health_stream
from edgelog.streaming import logs as log_stream
from edgelog.streaming import warm as warm_stream

WEEK = 7 * metrics.DAY
RESIDENCY_TTL = 3_600
ENTITY_KEY = ["entity_id", "query_hash", "lang", "endpoint"]


# --- request log -------------------------------------------------------------------------------


def scan_request_logs(spark: SparkSession, sf: str) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    return log_store.metric_rows(logs, derived.latest(logs) - metrics.DAY)


def log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "request_logs")
    logs = derived.request_logs(spark, sf)
    log_store.append_request_logs(logs, path)
    return log_store.read_request_logs(
        spark, path, derived.latest(log_store.open_logs(spark, path)) - metrics.DAY
    )


def log_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    wide = derived.request_logs(spark, sf).withColumns(
        {
            "latency_ms": F.col("latency_ms").cast("bigint") * 20_000_000,
            "status_code": F.col("status_code").cast("int") * 100,
        }
    )
    return log_store.narrow_logs(wide).select("id", "latency_ms", "status_code")


def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    recent = in_window(F.col("observed_at_unix_secs"), derived.latest(logs), WEEK)
    return logs.where(recent).select("id", "observed_at_unix_secs")


def json_key_exists(spark: SparkSession, sf: str) -> DataFrame:
    column = F.col("metadata")
    return derived.request_logs(spark, sf).select(
        "id",
        metadata.has_key(column, "entity_id").alias("has_entity_id"),
        metadata.has_key(column, "endpoint").alias("has_endpoint"),
        metadata.meta(column, "endpoint").isNotNull().alias("endpoint_is_set"),
    )


def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    column = F.col("metadata")
    return derived.request_logs(spark, sf).select(
        "id",
        metadata.meta(column, "entity_id").alias("entity_id"),
        F.coalesce(metadata.meta(column, "lang"), F.lit("en")).alias("lang"),
        metadata.meta(column, "endpoint").alias("endpoint"),
    )


def _typed_logs(spark: SparkSession, sf: str) -> DataFrame:
    """A stored log whose metadata was parsed when it came in."""
    path = new_shared_path(spark, "typed_logs")
    log_store.append_request_logs(log_store.with_typed_metadata(derived.request_logs(spark, sf)), path)
    return log_store.open_logs(spark, path, typed_metadata=True)


def typed_key_exists(spark: SparkSession, sf: str) -> DataFrame:
    column = F.col("metadata")
    return _typed_logs(spark, sf).select(
        "id",
        metadata.typed_has_key(column, "entity_id").alias("has_entity_id"),
        metadata.typed_has_key(column, "endpoint").alias("has_endpoint"),
        metadata.typed_meta(column, "endpoint").isNotNull().alias("endpoint_is_set"),
    )


def typed_metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    column = F.col("metadata")
    return _typed_logs(spark, sf).select(
        "id",
        metadata.typed_meta(column, "entity_id").alias("entity_id"),
        F.coalesce(metadata.typed_meta(column, "lang"), F.lit("en")).alias("lang"),
        metadata.typed_meta(column, "endpoint").alias("endpoint"),
    )


# --- metrics -----------------------------------------------------------------------------------


def _summary(spark: SparkSession, sf: str, window: int, percentiles=metrics.P95) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    return metrics.summarize(logs, derived.latest(logs), window, percentiles)


def metrics_summary_24h(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, metrics.DAY)


def metrics_summary_7d(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, WEEK)


def metrics_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    fractions = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    return _summary(spark, sf, 365 * metrics.DAY, fractions)


def metrics_summary_empty(spark: SparkSession, sf: str) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    return metrics.summarize(logs, derived.latest(logs) + WEEK, metrics.DAY)


def metrics_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    return metrics.timeseries(logs, derived.latest(logs), metrics.DAY)


def metrics_timeseries_7d(spark: SparkSession, sf: str) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    return metrics.timeseries(logs, derived.latest(logs), WEEK)


def _all_points(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.hourly_points(metrics.bucket_histogram(derived.request_logs(spark, sf)))


def timeseries_filled(spark: SparkSession, sf: str) -> DataFrame:
    unavailable = derived.request_logs(spark, sf).where(F.col("status_code") == 503)
    return metrics.fill_gaps(metrics.hourly_points(metrics.bucket_histogram(unavailable)))


def busiest_hour(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.busiest_hour(_all_points(spark, sf))


def latest_hour(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latest_hour(_all_points(spark, sf))


def summary_json(spark: SparkSession, sf: str) -> DataFrame:
    return json_lines.json_lines(metrics_summary_7d(spark, sf))


def timeseries_json(spark: SparkSession, sf: str) -> DataFrame:
    return json_lines.series_document(metrics_timeseries_7d(spark, sf), WEEK)


def percent_label(spark: SparkSession, sf: str) -> DataFrame:
    points = _all_points(spark, sf)
    return points.select(
        "observed_at_unix_secs",
        labels.percent_label(F.col("cache_hit_rate")).alias("cache_hits"),
        labels.percent_label(F.try_divide(F.lit(1.0), F.lit(0.0))).alias("nothing"),
    )


def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    return derived.request_logs(spark, sf).select(
        "id",
        labels.number_label(F.col("observed_at_unix_secs")).alias("number_label"),
        labels.bucket_label(F.col("observed_at_unix_secs")).alias("bucket_label"),
        labels.payload_bytes(F.col("metadata")).alias("payload_bytes"),
    )


# --- request fields ----------------------------------------------------------------------------


def canonical_params(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.logs(spark, sf)
    pairs = F.array(
        keys.param("lang", F.col("lang")),
        keys.param("k", F.col("k").cast("string")),
        keys.param("k", (F.col("k") * 7 % 100).cast("string")),
        keys.param("endpoint", F.coalesce("endpoint", F.lit(""))),
        keys.param("Route", F.col("route")),
    )
    return rows.select("id", keys.canonical_params(pairs).alias("params"))


def _keyed_requests(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = requests.split_valid(derived.requests(derived.logs(spark, sf)))
    return requests.with_keys(valid)


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed_requests(spark, sf).select("request_id", "cache_key")


def normalize_query_ws(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "documents").select(
        "doc_id", normalize_ws(F.col("text")).alias("text")
    )


def client_identifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.requests(derived.logs(spark, sf))
    return rows.select("request_id", keys.client_identifier(F.col("headers")).alias("client"))


def client_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.requests(derived.logs(spark, sf))
    hashed = keys.hash_client(keys.client_identifier(F.col("headers")))
    return rows.select("request_id", hashed.alias("client_hash"))


def validate_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.requests(derived.logs(spark, sf))
    field = validate.lookup(F.col("route"), validate.TEXT_FIELDS)
    checked = rows.select("request_id", validate.require_text(F.col("resource"), field).alias("c"))
    return checked.select("request_id", "c.value", "c.error")


def validate_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    checked = derived.endpoint_candidates(spark, sf).select(
        "page_id", validate.validate_endpoint(F.col("endpoint")).alias("c")
    )
    return checked.select("page_id", "c.value", "c.error")


def validate_language(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of the requests, and tags made from every document."""
    rows = derived.requests(derived.logs(spark, sf)).select(
        F.col("request_id").alias("id"), F.lit("request").alias("kind"), "lang"
    )
    documents = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit("document").alias("kind"),
        F.concat(F.upper("lang"), F.lit("-"), "source", F.lit("-"), F.col("n_chars")).alias("lang"),
    )
    checked = rows.unionByName(documents).select(
        "id", "kind", validate.validate_language(F.col("lang")).alias("c")
    )
    return checked.select("id", "kind", "c.value", "c.error")


def request_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = requests.split_valid(derived.requests(derived.logs(spark, sf)))
    return rejected.select(
        "request_id", "error_code", "error_message", "status_code", "invalid_hash"
    )


def resource_iri(spark: SparkSession, sf: str) -> DataFrame:
    pages = derived.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("resource"), F.lit("en").alias("lang")
    )
    texts = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("resource"), F.lit("am").alias("lang")
    )
    return pages.unionByName(texts).select(
        "id", "lang", validate.resource_iri(F.col("resource"), F.col("lang")).alias("iri")
    )


def endpoint_for_lang(spark: SparkSession, sf: str) -> DataFrame:
    return derived.logs(spark, sf).select(
        "id", validate.endpoint_for(F.col("lang")).alias("endpoint")
    )


# --- cache -------------------------------------------------------------------------------------


def cache_fresh_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.logs(spark, sf)
    return cache.cache_view(derived.cache_entries(rows), derived.latest(rows))


def _updates(rows: DataFrame) -> DataFrame:
    fetched = derived.good_answers(rows).where(~F.col("cache_hit"))
    return fetched.select(
        F.col("query_hash").alias("cache_key"),
        F.concat(F.lit('{"id":'), F.col("id"), F.lit("}")).alias("payload"),
        F.col("observed_at_unix_secs").alias("fetched_at_unix_secs"),
    )


def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """What every miss fetched is stored over the cache."""
    rows = derived.logs(spark, sf)
    return cache.upsert_cache(derived.cache_entries(rows), _updates(rows))


def stored_cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same on a cache in buckets of its keys, of which the update reads and writes those of its own keys."""
    path = new_shared_path(spark, "cache")
    rows = derived.logs(spark, sf)
    cache_store.write_cache(derived.cache_entries(rows), path)
    keyed = cache.latest_updates(_updates(rows))
    cache_store.update_cache(cache.fresh_entries(keyed), path, 1)
    return cache_store.read_cache(spark, path, 1)


def stored_fresh_view(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh entries, by lookups of all their keys."""
    path = new_shared_path(spark, "cache")
    rows = derived.logs(spark, sf)
    entries = derived.cache_entries(rows)
    cache_store.write_cache(entries, path)
    found = cache_store.lookup_cache(spark, path, 0, entries.select("cache_key"))
    return cache.cache_view(found, derived.latest(rows))


def cache_record_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.logs(spark, sf)
    hits = derived.good_answers(rows).where(F.col("cache_hit"))
    accesses = hits.select(
        F.col("query_hash").alias("cache_key"),
        F.col("observed_at_unix_secs").alias("accessed_at_unix_secs"),
    )
    return cache.record_hits(derived.cache_entries(rows), accesses)


def cache_residency(spark: SparkSession, sf: str) -> DataFrame:
    return cache.residency(_accesses(derived.logs(spark, sf)), RESIDENCY_TTL)


def cache_residency_7d(spark: SparkSession, sf: str) -> DataFrame:
    return cache.residency(_accesses(derived.logs(spark, sf)))


def _accesses(rows: DataFrame) -> DataFrame:
    return derived.good_answers(rows).select(
        F.col("query_hash").alias("cache_key"), "observed_at_unix_secs"
    )


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.logs(spark, sf)
    entries = derived.cache_entries(rows)
    return cache.resolve_requests(
        _keyed_requests(spark, sf), entries, derived.origin_responses(entries), derived.latest(rows)
    )


def resolve_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select(
        "request_id",
        "cache_key",
        "data",
        "cached",
        "stale",
        "source",
        "error_code",
        "error_message",
        "status_code",
    )


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return cache.envelope(_resolved(spark, sf)).select(
        "request_id",
        F.to_json("envelope", {"ignoreNullFields": "false"}).alias("envelope"),
    )


def error_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of failed and rejected requests."""
    rejected = request_quarantine(spark, sf)
    return json_lines.error_bodies(_resolved(spark, sf).unionByName(rejected, allowMissingColumns=True))


def display_source(spark: SparkSession, sf: str) -> DataFrame:
    shown = labels.display_source(F.col("error_code"), F.col("stale"), F.col("source"))
    return _resolved(spark, sf).select("request_id", shown.alias("display_source"))


def origin_classes(spark: SparkSession, sf: str) -> DataFrame:
    responses = derived.origin_responses(derived.cache_entries(derived.logs(spark, sf)))
    kind = validate.classify_origin(F.col("status"), F.col("body"))
    return responses.select("cache_key", kind.alias("origin_class"))


def outcome_status(spark: SparkSession, sf: str) -> DataFrame:
    outcome = (
        F.when(F.col("k") % 6 == 0, "bad_request")
        .when(F.col("k") % 6 == 1, "origin_error")
        .when(F.col("k") % 6 == 2, "origin_unavailable")
        .when(F.col("k") % 6 == 3, "outbound_limiter_closed")
        .when(F.col("k") % 6 == 4, "metrics_unavailable")
    )
    rows = derived.logs(spark, sf)
    return rows.select("id", validate.outcome_status(outcome).alias("status_code"))


def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows of all requests, answered and rejected."""
    valid, rejected = requests.split_valid(derived.requests(derived.logs(spark, sf)))
    rows = derived.logs(spark, sf)
    entries = derived.cache_entries(rows)
    answered = cache.resolve_requests(
        requests.with_keys(valid), entries, derived.origin_responses(entries), derived.latest(rows)
    )
    return requests.to_log_rows(answered.unionByName(rejected, allowMissingColumns=True))


# --- popularity and warming --------------------------------------------------------------------


def popular_entities(spark: SparkSession, sf: str) -> DataFrame:
    return popular.popular_entities(derived.request_logs(spark, sf))


def entity_hits(spark: SparkSession, sf: str) -> DataFrame:
    return popular.entity_hits(derived.request_logs(spark, sf))


def typed_entity_hits(spark: SparkSession, sf: str) -> DataFrame:
    return popular.entity_hits(_typed_logs(spark, sf))


def warm_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.logs(spark, sf)
    return warm.skip_recent(
        popular.entity_hits(rows), derived.cache_entries(rows), 29 * metrics.DAY, derived.latest(rows)
    ).select(*ENTITY_KEY, "hits")


def _warm(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = derived.logs(spark, sf)
    return warm.warm_cache(
        rows, derived.triples(spark, sf), derived.cache_entries(rows), derived.latest(rows)
    )


def warm_cache(spark: SparkSession, sf: str) -> DataFrame:
    return _warm(spark, sf)[0]


def warm_result(spark: SparkSession, sf: str) -> DataFrame:
    return _warm(spark, sf)[1]


# --- triples -----------------------------------------------------------------------------------


def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return triples.entity_lookup(derived.triples(spark, sf), derived.entity_requests(spark, sf))


def entity_lookup_limited(spark: SparkSession, sf: str) -> DataFrame:
    return triples.entity_lookup(
        derived.triples(spark, sf), derived.entity_requests(spark, sf), limit=3
    )


def label_search(spark: SparkSession, sf: str) -> DataFrame:
    queries = derived.search_queries(spark, sf).select("query_id", "text", "lang")
    return triples.label_search(derived.triples(spark, sf), queries)


def label_search_clamped(spark: SparkSession, sf: str) -> DataFrame:
    limits = F.when(F.col("item_id") < 0, F.lit(500)).otherwise(F.lit(0))
    queries = derived.search_queries(spark, sf).select(
        "query_id", "text", "lang", limits.alias("limit")
    )
    return triples.label_search(derived.triples(spark, sf), queries)


def _stored_triples(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "triples")
    triple_store.write_triples(derived.triples(spark, sf), path)
    return triple_store.read_triples(spark, path)


def stored_entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """From a table in buckets of subjects."""
    path = new_shared_path(spark, "triple_table")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    triple_store.write_triple_table(derived.triples(spark, sf), name, path)
    requests = derived.entity_requests(spark, sf)
    return triples.entity_lookup(triple_store.read_triple_table(spark, name, requests), requests)


def stored_label_search(spark: SparkSession, sf: str) -> DataFrame:
    """Over an index that was built from one half of the subjects, to which the other was added."""
    path = new_shared_path(spark, "label_index")
    facts = derived.triples(spark, sf)
    first = F.xxhash64("subject") % 2 == 0
    label_index.write_label_index(facts.where(first), path)
    label_index.add_to_label_index(facts.where(~first), path, 1)
    queries = derived.search_queries(spark, sf).select("query_id", "text", "lang")
    return label_index.search_label_index(spark, path, queries)


def stored_triple_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return triples.match_pattern(
        _stored_triples(spark, sf), predicate=derived.ONTOLOGY + "knownFor", object=derived.RESOURCE + "src1"
    )


def triple_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return triples.match_pattern(derived.triples(spark, sf), limit=5)


def triple_pattern_bound(spark: SparkSession, sf: str) -> DataFrame:
    return triples.match_pattern(
        derived.triples(spark, sf),
        predicate=derived.ONTOLOGY + "knownFor",
        object=derived.RESOURCE + "src1",
    )


# --- health ------------------------------------------------------------------------------------


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return derived.origin_calls(derived.logs(spark, sf))


def origin_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return health.origin_incidents(_calls(spark, sf))


def breaker_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return health.breaker_transitions(_calls(spark, sf))


def breaker_transitions_slow(spark: SparkSession, sf: str) -> DataFrame:
    """A cooldown of an hour, so that some calls find the breaker still open."""
    return health.breaker_transitions(_calls(spark, sf), threshold=2, cooldown=3_600)


def breaker_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.logs(spark, sf)
    return health.breaker_snapshot(derived.origin_calls(rows), derived.latest(rows), threshold=1)


def rate_breaches(spark: SparkSession, sf: str) -> DataFrame:
    logs = derived.request_logs(spark, sf)
    return health.rate_breaches(logs, rate=0, burst=8, window=metrics.DAY)


# --- streams -----------------------------------------------------------------------------------


#: Parts of the events of a stream, each about a micro-batch.
ARRIVALS = 6


def _event_stream(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """Log rows of all events, which arrive in parts and in no order of time.

    Spark decides how many files a part has; a micro-batch takes as many files as a part has on average.
    """
    events = derived.table(spark, sf, "events")
    parts = events.withColumn("arrival", F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS)))
    parts.hint("rebalance", "arrival").write.partitionBy("arrival").parquet(f"{path}/events")
    files = len(spark.read.parquet(f"{path}/events").inputFiles())
    stream = log_stream.read_log_stream(spark, f"{path}/events", parts.schema, max_files=-(-files // ARRIVALS))
    return derived.detailed_logs(stream.drop("arrival"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "stream_ingest")
    logs = _event_stream(spark, sf, path)
    log_stream.ingest_stream(logs, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return log_store.open_logs(spark, f"{path}/out").select(*REQUEST_LOGS.fieldNames())


def log_two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """One log, of which one half is streamed and the other appended before and after."""
    path = new_shared_path(spark, "log_two_writers")
    rows = derived.request_logs(spark, sf)
    log_store.append_request_logs(rows.where("id % 4 = 1"), f"{path}/out")
    stream = _event_stream(spark, sf, path).where("id % 2 = 0")
    log_stream.ingest_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    log_store.append_request_logs(rows.where("id % 4 = 3"), f"{path}/out")
    return log_store.open_logs(spark, f"{path}/out").select(*REQUEST_LOGS.fieldNames())


def _hours(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = new_shared_path(spark, name)
    logs = _event_stream(spark, sf, path)
    log_stream.hourly_histogram_stream(logs, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return log_stream.read_hourly_histogram(spark, f"{path}/out")


def stream_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.hourly_points(_hours(spark, sf, "stream_timeseries"))


def stream_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return log_stream.rolling_points(_hours(spark, sf, "stream_rolling"))


def stream_residency(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "stream_residency")
    accesses = _accesses(_event_stream(spark, sf, path))
    log_stream.residency_stream(accesses, f"{path}/out", f"{path}/checkpoint", RESIDENCY_TTL).awaitTermination()
    return log_stream.read_residency(spark, f"{path}/out", RESIDENCY_TTL)


def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """Calls arrive in no order of time; late ones correct what was found before."""
    path = new_shared_path(spark, "stream_breaker")
    calls = derived.origin_calls(_event_stream(spark, sf, path))
    health_stream.breaker_stream(calls, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return health_stream.read_transitions(spark, f"{path}/out").select(
        "endpoint", "seq", "at_unix_secs", "from_state", "to_state"
    )


def stream_warm(spark: SparkSession, sf: str) -> DataFrame:
    """Two warming ticks, after three quarters of the log's time and after all of it; entries under 10 days old are
    skipped, so the second tick leaves what the first has refreshed. Each tick takes all files that have arrived."""
    path = new_shared_path(spark, "stream_warm")
    rows = derived.logs(spark, sf)
    events = derived.table(spark, sf, "events")
    seconds = F.expr(derived.EPOCH_SECONDS)
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    tick = (first + 3 * last) // 4
    cache_store.write_cache(derived.cache_entries(rows), f"{path}/cache")
    for part in (events.where(seconds <= tick), events.where(seconds > tick)):
        part.write.mode("append").parquet(f"{path}/events")
        warm_stream.warm_stream(
            derived.detailed_logs(log_stream.read_log_stream(spark, f"{path}/events", events.schema)),
            derived.triples(spark, sf),
            f"{path}/cache",
            f"{path}/checkpoint",
            interval=None,
            min_age=10 * metrics.DAY,
        ).awaitTermination()
    return cache_store.read_cache(spark, f"{path}/cache", 2)


QUERIES = {
    query.__name__: query
    for query in (
        scan_request_logs,
        log_roundtrip,
        log_narrowing,
        window_filter,
        json_key_exists,
        typed_key_exists,
        typed_metadata_fields,
        typed_entity_hits,
        metadata_fields,
        metrics_summary_24h,
        metrics_summary_7d,
        metrics_summary_empty,
        metrics_percentiles,
        metrics_timeseries,
        metrics_timeseries_7d,
        timeseries_filled,
        busiest_hour,
        latest_hour,
        summary_json,
        timeseries_json,
        percent_label,
        display_labels,
        canonical_params,
        cache_keys,
        normalize_query_ws,
        client_identifier,
        client_hash,
        validate_text,
        validate_endpoint,
        validate_language,
        request_quarantine,
        resource_iri,
        endpoint_for_lang,
        cache_fresh_view,
        cache_upsert,
        stored_cache_upsert,
        stored_fresh_view,
        cache_record_hits,
        cache_residency,
        cache_residency_7d,
        resolve_requests,
        envelopes,
        error_bodies,
        display_source,
        origin_classes,
        outcome_status,
        log_rows,
        popular_entities,
        entity_hits,
        warm_candidates,
        warm_cache,
        warm_result,
        entity_lookup,
        entity_lookup_limited,
        label_search,
        label_search_clamped,
        stored_entity_lookup,
        stored_label_search,
        stored_triple_pattern,
        triple_pattern,
        triple_pattern_bound,
        origin_incidents,
        breaker_transitions,
        breaker_transitions_slow,
        breaker_snapshot,
        rate_breaches,
        stream_ingest,
        log_two_writers,
        stream_timeseries,
        stream_rolling,
        stream_residency,
        stream_breaker,
        stream_warm,
    )
}
