from __future__ import annotations

import random

from pyspark.sql import functions as F

from edgelog.operators import cache, warm
from edgelog.operators.triples import ABSTRACT, LABEL
from edgelog.schemas import CACHE_ENTRIES, ORIGIN_RESPONSES, TRIPLES

UPDATES = "cache_key string, payload string, fetched_at_unix_secs long"


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), CACHE_ENTRIES)


def test_fresh_entry_and_hits(spark):
    updates = spark.createDataFrame([("k", "{}", 100)], UPDATES)
    stored = cache.upsert_cache(entries(spark), updates, ttl=10)
    assert tuple(stored.first()) == ("k", "{}", 100, 100, 0, 110)
    accesses = spark.createDataFrame([("k", 104), ("k", 108), ("x", 1)], "cache_key string, accessed_at_unix_secs long")
    assert tuple(cache.record_hits(stored, accesses, ttl=10).first()) == ("k", "{}", 100, 100, 2, 118)


def test_upsert_keeps_others_and_the_last_write_wins(spark):
    old = entries(spark, ("a", "1", 500, 500, 9, 900), ("b", "2", 5, 5, 1, 9))
    updates = spark.createDataFrame([("a", "x", 50), ("a", "y", 60), ("c", "z", 1)], UPDATES)
    rows = {tuple(r) for r in cache.upsert_cache(old, updates, ttl=10).collect()}
    assert rows == {("a", "y", 60, 60, 0, 70), ("b", "2", 5, 5, 1, 9), ("c", "z", 1, 1, 0, 11)}


def test_views(spark):
    rows = entries(spark, ("a", "1", 0, 0, 0, 10), ("b", "2", 0, 0, 0, 9))
    assert [r.cache_key for r in cache.cache_view(rows, 10).collect()] == ["a"]
    assert cache.cache_view(rows, 10, "stale").count() == 2


def test_resolution(spark):
    stored = entries(
        spark,
        ("fresh", '{"v":1}', 0, 0, 0, 100),
        ("old_ok", '{"v":2}', 0, 0, 0, 99),
        ("old_bad", '{"v":3}', 0, 0, 0, 99),
        ("old_open", '{"v":4}', 0, 0, 0, 99),
        ("broken", "{", 0, 0, 0, 500),
    )
    origin = spark.createDataFrame(
        [
            ("fresh", 200, "{}"),
            ("old_ok", 204, "[2]"),
            ("old_bad", 502, "{}"),
            ("broken", 200, "nope"),
            ("new", 200, "[9]"),
            ("large", 200, '"' + "x" * 99 + '"'),
            ("just", 200, '"' + "x" * 98 + '"'),
        ],
        ORIGIN_RESPONSES,
    )
    keys = ["fresh", "old_ok", "old_bad", "old_open", "broken", "new", "large", "just", "none"]
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "request_id long, cache_key string")
    resolved = cache.resolve_requests(asked, stored, origin, 100, max_bytes=100)
    rows = {r.cache_key: r for r in resolved.collect()}
    assert len(rows) == len(keys)
    assert {k: r.source for k, r in rows.items()} == {
        "fresh": "cache", "old_ok": "origin", "old_bad": "stale_cache", "old_open": "stale_cache",
        "broken": None, "new": "origin", "large": None, "just": "origin", "none": None,
    }
    assert (rows["old_bad"].cached, rows["old_bad"].stale, rows["old_bad"].status_code) == (True, True, 200)
    assert (rows["fresh"].cached, rows["fresh"].stale, rows["fresh"].data) == (True, False, '{"v":1}')
    assert (rows["none"].error_code, rows["none"].status_code) == ("origin_unavailable", 503)
    assert (rows["broken"].error_code, rows["broken"].status_code) == ("origin_error", 502)
    assert rows["large"].error_message == "dbpedia response exceeded 100 bytes"
    envelopes = {r.request_id: r.envelope for r in cache.envelope(resolved).collect()}
    assert envelopes[8] is None and envelopes[0].source == "cache"


def lifetimes(times, ttl):
    found, run = [], []
    for t in sorted(times):
        if run and t - run[-1] > ttl:
            found.append(run)
            run = []
        run.append(t)
    return [(r[0], r[-1], len(r) - 1) for r in [*found, run] if r]


def test_residency_against_a_plain_scan(spark):
    rng = random.Random(7)
    accesses = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(20_000)) for _ in range(4000)]
    accesses += [("edge", 0), ("edge", 60), ("edge", 121), ("edge", 181)]
    df = spark.createDataFrame(accesses, "cache_key string, observed_at_unix_secs long")
    for ttl in (1, 7, 60, 600):
        expected = {
            (key, *life)
            for key in {k for k, _ in accesses}
            for life in lifetimes([t for k, t in accesses if k == key], ttl)
        }
        assert {tuple(r) for r in cache.residency(df, ttl).collect()} == expected


LOGS = "route string, query_hash string, metadata string"


def facts(spark):
    return spark.createDataFrame(
        [
            ("http://dbpedia.org/resource/A", LABEL, "a", "literal", "en", None),
            ("http://dbpedia.org/resource/A", ABSTRACT, "b", "literal", "en", None),
        ],
        TRIPLES,
    )


def test_warming(spark):
    logs = spark.createDataFrame(
        [("entity", "ka", '{"entity_id":"A","lang":"en"}')] * 3
        + [("entity", "kb", '{"entity_id":"B","lang":"en"}')] * 2
        + [("entity", "kc", '{"entity_id":null}')],
        LOGS,
    )
    cached, result = warm.warm_cache(logs, facts(spark), entries(spark), as_of=100, k=3, ttl=10)
    rows = {r.cache_key: r for r in cached.collect()}
    assert rows["ka"].payload == '[{"label":"a","abstract":"b","property":null,"value":null}]'
    assert (rows["kb"].payload, rows["kb"].expires_at_unix_secs) == ("[]", 110)
    assert tuple(result.first()) == (2, 1) and len(rows) == 2
    _, one = warm.warm_cache(logs, facts(spark), entries(spark), as_of=100, k=1)
    assert tuple(one.first()) == (1, 0)


def test_recently_refreshed_keys_are_skipped(spark):
    logs = spark.createDataFrame([("entity", k, '{"entity_id":"A"}') for k in ("k1", "k2")], LOGS)
    cached = entries(spark, ("k1", "x", 0, 91, 0, 0), ("k2", "y", 0, 90, 0, 0))
    warmed, result = warm.warm_cache(logs, facts(spark), cached, as_of=100, ttl=10, min_age=10)
    assert tuple(result.first()) == (1, 0)
    assert {r.cache_key for r in warmed.where(F.col("created_at_unix_secs") == 100).collect()} == {"k2"}
