"""From raw requests to keyed ones, quarantine, and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.functions import keys, validate
from edgelog.functions.text import strip_ws


def check_requests(
    requests: DataFrame, hosts=validate.APPROVED_HOSTS, suffixes=validate.APPROVED_SUFFIXES
) -> DataFrame:
    """Clean field values and, for a rejected request, the message of its first failed check.

    Checks run in the order text, endpoint, language; raw queries have no language to check. Each
    step is a projection of its own whose columns the next one uses several times, so that Catalyst
    keeps them apart and every field is stripped and parsed once.
    """
    route, url = F.col("route"), F.col("_url")
    names = list(validate.url_parts(url))
    parts = {name: F.col(f"_{name}") for name in names}
    is_raw = route == "sparql"
    stripped = requests.withColumns(
        {
            "_text": validate.clean_text(F.col("resource")),
            "_url": strip_ws(F.col("endpoint")),
            "_lang": validate.clean_language(F.col("lang")),
            "_field": validate.lookup(route, validate.TEXT_FIELDS),
        }
    )
    parsed = stripped.withColumns({f"_{n}": c for n, c in validate.url_parts(url).items()})
    judged = parsed.withColumns(
        {
            "_text_error": validate.text_error(F.col("_text"), F.col("_field")),
            "_endpoint_error": validate.endpoint_error(url, parts, hosts, suffixes),
            "_lang_error": F.when(~is_raw, validate.language_error(F.col("_lang"))),
        }
    )
    return judged.withColumns(
        {
            "resource": F.col("_text"),
            "endpoint": validate.clean_endpoint(url, parts),
            "lang": F.when(is_raw, F.lit("raw")).otherwise(F.col("_lang")),
            "error_message": F.coalesce("_text_error", "_endpoint_error", "_lang_error"),
            # Only an empty text is logged, under a fixed hash.
            "invalid_hash": F.when(
                F.col("_text_error").isNotNull(), validate.lookup(route, validate.INVALID_HASHES)
            ),
        }
    ).select(*requests.columns, "error_message", "invalid_hash")


def _keep(rows: DataFrame, condition: Column, columns: list[Column | str]) -> DataFrame:
    """``rows.where(condition).select(*columns)`` that evaluates what the condition uses once.

    A filter would be pushed below the projections that compute it, and compute them again there.
    """
    return rows.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests with clean values, and rejected ones with code, message and status."""
    checked = check_requests(requests)
    valid = _keep(checked, F.col("error_message").isNull(), requests.columns)
    rejected = _keep(
        checked,
        F.col("error_message").isNotNull(),
        [
            *[c for c in requests.columns if c not in ("resource", "lang", "endpoint")],
            F.lit("bad_request").alias("error_code"),
            "error_message",
            validate.outcome_status(F.lit("bad_request")).alias("status_code"),
            "invalid_hash",
        ],
    )
    return valid, rejected


def with_keys(valid: DataFrame, salt: str = keys.DEFAULT_SALT) -> DataFrame:
    """Add ``cache_key`` to validated requests."""
    return valid.withColumn(
        "cache_key",
        keys.request_key(F.col("route"), F.col("resource"), F.col("lang"), F.col("endpoint"), salt),
    )


def to_log_rows(outcomes: DataFrame) -> DataFrame:
    """Log rows of answered and rejected requests.

    ``outcomes`` holds the request columns (``lang`` and ``endpoint`` cleaned), ``cache_key``,
    ``source``, ``error_code``, ``invalid_hash`` and ``latency_ms``. Requests rejected for their
    endpoint or language leave no row. Only a cache hit or a fresh origin answer names its entity;
    a null endpoint keeps its key in the JSON.
    """
    source, failed = F.col("source"), F.col("error_code").isNotNull()
    logged = outcomes.where((F.coalesce(F.col("error_code"), F.lit("")) != "bad_request") | F.col("invalid_hash").isNotNull())
    named = (F.col("route") == "entity") & source.isin("cache", "origin") & ~failed
    entity = F.to_json(
        F.struct(F.col("resource").alias("entity_id"), "lang", "endpoint"),
        {"ignoreNullFields": "false"},
    )
    return logged.select(
        F.col("request_id").alias("id"),
        "observed_at_unix_secs",
        "route",
        F.coalesce("invalid_hash", "cache_key").alias("query_hash"),
        (~failed & source.isin("cache", "stale_cache")).alias("cache_hit"),
        (~failed & (source == "stale_cache")).alias("stale"),
        F.least(F.col("latency_ms").cast("bigint"), F.lit(2**31 - 1)).cast("int").alias("latency_ms"),
        keys.hash_client(keys.client_identifier(F.col("headers"))).alias("client_hash"),
        validate.outcome_status(F.col("error_code")).alias("status_code"),
        F.when(named, entity).otherwise(F.lit("{}")).alias("metadata"),
    )
