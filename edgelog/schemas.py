"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


REQUEST_LOGS = _schema(
    ("id", T.LongType()),
    ("observed_at_unix_secs", T.LongType()),
    ("route", T.StringType()),
    ("query_hash", T.StringType()),
    ("cache_hit", T.BooleanType()),
    ("stale", T.BooleanType()),
    ("latency_ms", T.IntegerType()),
    ("client_hash", T.StringType()),
    ("status_code", T.ShortType()),
    ("metadata", T.StringType()),
)

METRIC_COLUMNS = ("observed_at_unix_secs", "cache_hit", "stale", "latency_ms", "status_code")

CACHE_ENTRIES = _schema(
    ("cache_key", T.StringType()),
    ("payload", T.StringType()),
    ("created_at_unix_secs", T.LongType()),
    ("last_success_unix_secs", T.LongType()),
    ("hit_count", T.LongType()),
    ("expires_at_unix_secs", T.LongType()),
)

REQUESTS = _schema(
    ("request_id", T.LongType()),
    ("route", T.StringType()),
    ("resource", T.StringType()),
    ("lang", T.StringType()),
    ("endpoint", T.StringType()),
    ("headers", T.MapType(T.StringType(), T.StringType())),
    ("observed_at_unix_secs", T.LongType()),
)

ORIGIN_RESPONSES = _schema(
    ("cache_key", T.StringType()),
    ("status", T.IntegerType()),
    ("body", T.StringType()),
)

ORIGIN_CALLS = _schema(
    ("endpoint", T.StringType()),
    ("ts", T.LongType()),
    ("seq", T.LongType()),
    ("ok", T.BooleanType()),
)

TRIPLES = _schema(
    ("subject", T.StringType()),
    ("predicate", T.StringType()),
    ("object", T.StringType()),
    ("object_kind", T.StringType()),
    ("lang", T.StringType()),
    ("datatype", T.StringType()),
)
