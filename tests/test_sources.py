from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from edgelog import session
from edgelog.operators import metrics
from edgelog.sources import cache_store, json_lines, logs, state, triples
from edgelog.schemas import CACHE_ENTRIES, METRIC_COLUMNS, REQUEST_LOGS, TRIPLES

DAY = 86_400


def log_rows(spark, days=6):
    rows = [
        (i, i * 7_000, "entity", f"h{i % 5}", i % 2 == 0, False, i, "c", 200, "{}")
        for i in range(days * DAY // 7_000)
    ]
    return spark.createDataFrame(rows, REQUEST_LOGS)


def test_appends_and_pruned_scans(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = log_rows(spark)
    logs.append_request_logs(rows, path)
    logs.append_request_logs(rows, path)
    assert logs.open_logs(spark, path).count() == 2 * rows.count()
    recent = logs.read_request_logs(spark, path, 4 * DAY + 10)
    assert recent.count() == 2 * rows.where(F.col("observed_at_unix_secs") >= 4 * DAY + 10).count()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "observed_date" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(observed_at_unix_secs" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "metadata" not in schema and "latency_ms" in schema


def test_narrowing(spark):
    wide = spark.createDataFrame([(2**40, 70_000), (5, 200)], "latency_ms long, status_code int")
    assert {tuple(r) for r in logs.narrow_logs(wide).collect()} == {(2**31 - 1, 32_767), (5, 200)}


def test_jdbc_reads_ranges_of_ids(spark, monkeypatch):
    """Only what is asked of Spark's reader: no database is started for a test."""
    asked = {}

    def jdbc(self, url, table, **options):
        asked.update(options, url=url, table=table)
        return log_rows(spark)

    monkeypatch.setattr(type(spark.read), "jdbc", jdbc)
    found = logs.read_request_logs_jdbc(spark, "jdbc:x", (1, 900), partitions=4, since=DAY)
    assert found.columns == list(METRIC_COLUMNS)
    assert found.agg(F.min("observed_at_unix_secs")).first()[0] >= DAY
    assert (asked["column"], asked["lowerBound"], asked["upperBound"], asked["numPartitions"]) == ("id", 1, 900, 4)
    assert (asked["url"], asked["table"]) == ("jdbc:x", "request_logs")


def test_cache_versions(spark, tmp_path):
    root = str(tmp_path / "cache")
    changes = [[("b", "2", 2, 2, 0, 9)], [("c", "3", 3, 3, 0, 9), ("a", "3", 3, 3, 0, 9)], []]
    first = spark.createDataFrame([("a", "{}", 1, 1, 0, 9), ("b", "{}", 1, 1, 0, 9)], CACHE_ENTRIES)
    cache_store.write_cache(first, root, buckets=5)
    for version, rows in enumerate(changes, 1):
        for _ in range(2):  # a repeated version replaces itself
            cache_store.update_cache(spark.createDataFrame(rows, CACHE_ENTRIES), root, version)
    expected = [{"a": "{}", "b": "{}"}, {"a": "{}", "b": "2"}, {"a": "3", "b": "2", "c": "3"}, {"a": "3", "b": "2", "c": "3"}]
    for version, entries in enumerate(expected):
        assert {r.cache_key: r.payload for r in cache_store.read_cache(spark, root, version).collect()} == entries
    keys = spark.createDataFrame([("a",), ("a",), ("missing",), (None,)], "cache_key string")
    assert [r.payload for r in cache_store.lookup_cache(spark, root, 3, keys).collect()] == ["3"]


def test_empty_cache(spark, tmp_path):
    root = str(tmp_path / "cache")
    cache_store.write_cache(spark.createDataFrame([], CACHE_ENTRIES), root)
    assert cache_store.read_cache(spark, root, 0).collect() == []
    cache_store.update_cache(spark.createDataFrame([("a", "1", 1, 1, 0, 9)], CACHE_ENTRIES), root, 1)
    assert [r.payload for r in cache_store.read_cache(spark, root, 1).collect()] == ["1"]


def test_an_update_reads_and_writes_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "cache")
    cache_store.write_cache(spark.range(4_000).selectExpr(
        "concat('k', id) AS cache_key", "'{}' AS payload", "1L AS created_at_unix_secs", "1L AS last_success_unix_secs",
        "0L AS hit_count", "9L AS expires_at_unix_secs"), root, buckets=200)
    keys = spark.range(25).selectExpr("concat('k', id * 160) AS cache_key")
    looked_up = cache_store.lookup_cache(spark, root, 0, keys)
    folders = {f.rsplit("/", 2)[1] for f in looked_up.inputFiles()}
    assert looked_up.count() == 25 and len(folders) <= 25
    changed = looked_up.withColumn("payload", F.lit("new"))
    cache_store.update_cache(changed, root, 1)
    written = {f.rsplit("/", 2)[1] for f in spark.read.parquet(cache_store.version_path(root, 1)).inputFiles()}
    assert written == folders
    whole = cache_store.read_cache(spark, root, 1)
    assert whole.count() == 4_000 and whole.where("payload = 'new'").count() == 25


def test_state_reads_a_snapshot_and_the_deltas_after_it(spark, tmp_path):
    root, schema = str(tmp_path / "state"), "key string, n long"
    merge = lambda rows: rows.groupBy("key").agg(F.sum("n").alias("n"))
    for batch in range(7):
        rows = spark.createDataFrame([("all", 1), (f"k{batch}", 10)], schema)
        for _ in range(2):  # a repeated batch replaces itself
            state.commit_state(rows, root, schema, merge, batch, every=3)
        assert len(state.state_paths(spark, root, batch)) <= 3
        found = dict(map(tuple, state.read_state(spark, root, schema, merge, batch).collect()))
        assert found == {"all": batch + 1} | {f"k{b}": 10 for b in range(batch + 1)}
    earlier = dict(map(tuple, state.read_state(spark, root, schema, merge, 1).collect()))
    assert earlier == {"all": 2, "k0": 10, "k1": 10} and state.last_batch(spark, root) == 6
    assert state.read_state(spark, root, schema, merge, -1).collect() == []


def test_series_document_and_error_body(spark):
    points = metrics.timeseries(log_rows(spark), 6 * DAY, window=DAY)
    document = json.loads(json_lines.series_document(points).first().json)
    assert (document["rolling_window_seconds"], document["bucket_seconds"]) == (DAY, 3_600)
    assert [p["observed_at_unix_secs"] for p in document["points"]] == [r.observed_at_unix_secs for r in points.collect()]
    assert set(document["points"][0]) == set(points.columns) - {"rolling_window_seconds", "bucket_seconds"}
    empty = json.loads(json_lines.series_document(points.where("false")).first().json)
    assert empty == {"rolling_window_seconds": DAY, "bucket_seconds": 3_600, "points": []}
    answers = spark.createDataFrame([(1, "bad_request", 'say "x"'), (2, None, None)], "request_id int, error_code string, error_message string")
    bodies = {r.request_id: r.body for r in json_lines.error_bodies(answers).collect()}
    assert json.loads(bodies[1]) == {"error": {"code": "bad_request", "message": 'say "x"'}} and bodies[2] is None


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(context, "master", "spark://host:7077")
    monkeypatch.setattr(type(context), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(type(context.getConf()), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError):
        session.shared_dir(spark)


def test_triples_by_predicate(spark, tmp_path):
    path = str(tmp_path / "triples")
    rows = [("s", "http://a/b#p", "o", "uri", None, None), ("s", "q", "o", "literal", "en", None)]
    triples.write_triples(spark.createDataFrame(rows, TRIPLES), path)
    assert {tuple(r) for r in triples.read_triples(spark, path).collect()} == set(rows)


def test_json_keeps_nulls(spark, tmp_path):
    summary = metrics.summarize(log_rows(spark), 5 * DAY).withColumn("endpoint", F.lit(None).cast("string"))
    path = tmp_path / "json"
    json_lines.to_json_lines(summary, str(path))
    (text,) = [line for f in Path(path).glob("part-*") for line in f.read_text().splitlines()]
    assert json.loads(text) == json.loads(json_lines.json_lines(summary).first().json)
    assert json.loads(text)["endpoint"] is None and json.loads(text)["p95_latency_ms"] > 0
