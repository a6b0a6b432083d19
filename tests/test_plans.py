"""Physical plans: what is read, how often it is shuffled, and how a hot key is split."""

from __future__ import annotations

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from edgelog.operators import cache, health, metrics, triples
from edgelog.schemas import CACHE_ENTRIES, ORIGIN_CALLS, ORIGIN_RESPONSES, REQUEST_LOGS, TRIPLES


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.schema(df.schema).parquet(str(path))


def test_a_hot_key_is_split_when_requests_are_resolved(spark, tmp_path):
    asked = spark.range(400_000).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("cache_key"),
        F.sha2((F.col("id") * 7).cast("string"), 512).alias("resource"),
    )
    asked = stored(spark, asked, tmp_path / "asked")
    entries = stored(spark, spark.createDataFrame([("hot", "{}", 0, 0, 0, 9)], CACHE_ENTRIES), tmp_path / "entries")
    origin = spark.createDataFrame([], ORIGIN_RESPONSES)
    with conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="512KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="256KB",
    ):
        resolved = cache.resolve_requests(asked, entries, origin, 5)
        counted = {r.source: r["count"] for r in resolved.groupBy("source").count().collect()}
        assert counted == {"cache": 133_334, None: 266_666}
        assert "skew=true" in final_plan(resolved)


def test_calls_are_scanned_and_shuffled_once(spark, tmp_path):
    rng = random.Random(0)
    rows = [("e", rng.randrange(9_000), i, rng.random() < 0.3) for i in range(500)]
    calls = stored(spark, spark.createDataFrame(rows, ORIGIN_CALLS), tmp_path / "calls")
    for report in (health.origin_incidents(calls), health.breaker_transitions(calls)):
        plan = final_plan(report)
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_series_read_only_what_they_show_and_combine_before_the_shuffle(spark, tmp_path):
    rows = [(i, i, "entity", "h", True, False, i % 7, "c", 200, "{}") for i in range(100)]
    logs = stored(spark, spark.createDataFrame(rows, REQUEST_LOGS), tmp_path / "logs")
    plan = final_plan(metrics.timeseries(logs, 100))
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} == {
        "observed_at_unix_secs", "cache_hit", "stale", "latency_ms"
    }
    assert "partial_count" in plan and "GreaterThanOrEqual(observed_at_unix_secs" in plan


def test_lookup_lists_are_cut_before_the_shuffle(spark, tmp_path):
    rows = [("s", triples.LABEL, str(i), "literal", "en", None) for i in range(200)]
    facts = stored(spark, spark.createDataFrame(rows, TRIPLES), tmp_path / "facts")
    requests = spark.createDataFrame([("s", "en")], "subject string, lang string")
    found = triples.entity_lookup(facts, requests)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 50, Partial") == 3
    assert found.count() == 50


def test_few_updates_leave_a_large_cache_unshuffled(spark, tmp_path):
    entries = spark.range(20_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.lit("{}").alias("payload"),
        *[F.col("id").alias(c) for c in ("created_at_unix_secs", "last_success_unix_secs", "hit_count", "expires_at_unix_secs")],
    )
    entries = stored(spark, entries, tmp_path / "entries")
    key = entries.first().cache_key
    few = spark.sql(f"SELECT * FROM VALUES ('{key}', '[]', 7L) AS t(cache_key, payload, fetched_at_unix_secs)")
    upserted = cache.upsert_cache(entries, few)
    plan = final_plan(upserted)
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
    assert upserted.count() == 20_000


def test_label_search_meets_on_grams_not_on_languages(spark, tmp_path):
    rows = [(f"s{i}", triples.LABEL, f"label {i} x{i % 7}", "literal", "en", None) for i in range(300)]
    facts = stored(spark, spark.createDataFrame(rows, TRIPLES), tmp_path / "facts")
    queries = [("q1", "LABEL 12", "en"), ("q2", "x3", "en"), ("q3", "", "en"), ("q4", "none", "en"), ("q5", "label", "de")]
    found = triples.label_search(facts, spark.createDataFrame(queries, "query_id string, text string, lang string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line.split("[", 1)[1] for line in plan.splitlines() if "Join " in line]
    assert joins and not any(j.startswith("lang#") and j.split("]")[0].count(",") == 0 for j in joins)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    hits = {}
    for r in found.collect():
        hits.setdefault(r.query_id, []).append(r.entity)
    names = sorted(r[0] for r in rows)
    assert set(hits["q1"]) == set([s for s in names if s == "s12" or (s.startswith("s12") and len(s) == 4)][:10])
    assert hits["q2"] == [s for s in names if int(s[1:]) % 7 == 3][:10]
    assert hits["q3"] == names[:10] and set(hits) == {"q1", "q2", "q3"}
