from __future__ import annotations

import random

from pyspark.sql import functions as F

from edgelog.operators import cache, health, metrics
from edgelog.operators.triples import LABEL
from edgelog.schemas import CACHE_ENTRIES, ORIGIN_CALLS, REQUEST_LOGS, TRIPLES
from edgelog.sources.cache_store import read_cache, version_path, write_cache
from edgelog.sources.logs import append_request_logs, open_logs, write_log_batch
from edgelog.streaming import health as health_stream
from edgelog.streaming import logs as log_stream
from edgelog.streaming import warm as warm_stream

HOUR = 3_600


def make_logs(n=900, seed=1):
    rng = random.Random(seed)
    times = sorted(rng.randrange(40 * HOUR) for _ in range(n))
    return [
        (i, t, "entity", f"k{rng.randrange(4)}", rng.random() < 0.5, rng.random() < 0.1, rng.randrange(90), "c",
         rng.choice([200, 200, 502]), '{"entity_id":"A"}')
        for i, t in enumerate(times)
    ]


def write_parts(spark, rows, schema, path, parts):
    """Files that arrive one after the other, as one micro-batch each."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(path)


def test_ingest_is_exactly_once_over_restarts(spark, tmp_path):
    rows, src = make_logs(), str(tmp_path / "src")
    for parts in (rows[:300], rows[300:]):
        write_parts(spark, parts, REQUEST_LOGS, src, 2)
        stream = log_stream.read_log_stream(spark, src, max_files=1)
        log_stream.ingest_stream(stream, str(tmp_path / "dst"), str(tmp_path / "cp")).awaitTermination()
    found = open_logs(spark, str(tmp_path / "dst"))
    assert sorted(r.id for r in found.collect()) == [r[0] for r in rows]


def test_streams_and_appends_share_a_log(spark, tmp_path):
    rows, src, dst = make_logs(), str(tmp_path / "src"), str(tmp_path / "dst")
    append_request_logs(spark.createDataFrame(rows[:200], REQUEST_LOGS), dst)
    write_parts(spark, rows[200:600], REQUEST_LOGS, src, 2)
    stream = log_stream.read_log_stream(spark, src, max_files=1)
    log_stream.ingest_stream(stream, dst, str(tmp_path / "cp")).awaitTermination()
    append_request_logs(spark.createDataFrame(rows[600:], REQUEST_LOGS), dst)
    assert sorted(r.id for r in open_logs(spark, dst).collect()) == [r[0] for r in rows]
    again = spark.createDataFrame(rows[200:400], REQUEST_LOGS)  # a batch that is repeated after a failure
    write_log_batch(again, dst, "stream-0")
    assert sorted(r.id for r in open_logs(spark, dst).collect()) == [r[0] for r in rows]


def test_hourly_and_rolling_series_equal_the_batch(spark, tmp_path):
    rows, src, root = make_logs(), str(tmp_path / "src"), str(tmp_path / "hours")
    random.Random(2).shuffle(rows)  # most rows arrive after later ones
    write_parts(spark, rows, REQUEST_LOGS, src, 3)
    batch = spark.createDataFrame(rows, REQUEST_LOGS)
    stream = log_stream.read_log_stream(spark, src, max_files=1)
    log_stream.hourly_histogram_stream(stream, root, str(tmp_path / "cp")).awaitTermination()
    expected = set(map(tuple, metrics.hourly_points(metrics.bucket_histogram(batch)).collect()))

    log_stream.compact_deltas(spark, root, log_stream.HISTOGRAM, log_stream.merge_hours, 0)
    log_stream.compact_deltas(spark, root, log_stream.HISTOGRAM, log_stream.merge_hours, 1, 0)
    for compacted in (None, 0, 1):
        hours = log_stream.read_hourly_histogram(spark, root, compacted)
        assert set(map(tuple, metrics.hourly_points(hours).collect())) == expected

    days = log_stream.rolling_histogram(log_stream.read_hourly_histogram(spark, root))
    found = metrics.summarize_histogram(days, "window_end_unix_secs").collect()
    assert len(found) > 24
    for row in found:
        end = row.window_end_unix_secs
        inside = batch.where((F.col("observed_at_unix_secs") >= end - 24 * HOUR) & (F.col("observed_at_unix_secs") < end))
        if end % (9 * HOUR) == 0:
            assert tuple(row)[1:] == tuple(metrics.summarize_histogram(metrics.latency_histogram(inside)).first())


def test_rolling_windows_shuffle_three_rows_for_each(spark, tmp_path):
    rng = random.Random(9)
    rows = [(h * HOUR, ms, rng.randrange(1, 5), 1, 0, 1) for h in (*range(60), 100, 101, 300) for ms in rng.sample(range(20), 8)]
    spark.createDataFrame(rows, log_stream.HISTOGRAM).write.parquet(str(tmp_path / "hours"))
    hours = spark.read.schema(log_stream.HISTOGRAM).parquet(str(tmp_path / "hours"))
    for window in (24 * HOUR, 5 * HOUR, 72 * HOUR):
        points = log_stream.rolling_points(hours, window)
        plan = points._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        found = {r.window_end_unix_secs: r for r in points.collect()}
        ends = {h + k for h in {r[0] for r in rows} for k in range(HOUR, window + HOUR, HOUR)}
        assert set(found) == ends
        for end in rng.sample(sorted(ends), 40):
            inside = sorted((r[1], r[2]) for r in rows if end - window <= r[0] < end)
            latencies = [ms for ms, n in inside for _ in range(n)]
            assert found[end].total_requests == len(latencies)
            assert found[end].p95_latency_ms == latencies[-(-len(latencies) * 95 // 100) - 1]


def test_late_rows_and_open_hours_are_counted(spark, tmp_path):
    first = [(1, 100, "entity", "k", True, False, 1, "c", 200, "{}"), (2, 9 * HOUR, "entity", "k", True, False, 1, "c", 200, "{}")]
    late = [(3, 200, "entity", "k", True, False, 1, "c", 200, "{}"), (4, 12 * HOUR, "entity", "k", True, False, 1, "c", 200, "{}")]
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for part in (first, late):  # the second run goes on from the checkpoint of the first
        write_parts(spark, part, REQUEST_LOGS, src, 1)
        stream = log_stream.read_log_stream(spark, src)
        log_stream.hourly_histogram_stream(stream, root, str(tmp_path / "cp")).awaitTermination()
    hours = log_stream.read_hourly_histogram(spark, root).collect()
    assert {(r.observed_at_unix_secs, r.total_requests) for r in hours} == {(0, 2), (9 * HOUR, 1), (12 * HOUR, 1)}


def test_residency_stream_equals_the_batch(spark, tmp_path):
    rows, src, root, ttl = make_logs(), str(tmp_path / "src"), str(tmp_path / "lives"), 900
    random.Random(3).shuffle(rows)
    write_parts(spark, rows, REQUEST_LOGS, src, 3)
    accesses = log_stream.read_log_stream(spark, src, max_files=1).select(
        F.col("query_hash").alias("cache_key"), "observed_at_unix_secs"
    )
    log_stream.residency_stream(accesses, root, str(tmp_path / "cp"), ttl).awaitTermination()
    batch = spark.createDataFrame([(r[3], r[1]) for r in rows], "cache_key string, observed_at_unix_secs long")
    expected = set(map(tuple, cache.residency(batch, ttl).collect()))
    assert set(map(tuple, log_stream.read_residency(spark, root, ttl).collect())) == expected
    assert log_stream.read_deltas(spark, root, log_stream.STRETCHES).count() < len(rows)


COLUMNS = ["endpoint", "seq", "at_unix_secs", "from_state", "to_state"]


def sorted_rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def random_calls(seed, n=600, span=40_000):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.5 else rng.choice(["e1", None]), rng.randrange(span), seq, rng.random() < 0.3)
        for seq in range(n)
    ]


def test_breaker_stream_in_any_order_equals_the_batch(spark, tmp_path):
    calls = random_calls(4)
    random.Random(5).shuffle(calls)
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    write_parts(spark, calls, ORIGIN_CALLS, src, 4)
    stream = log_stream.read_log_stream(spark, src, ORIGIN_CALLS, max_files=1)
    health_stream.breaker_stream(stream, root, str(tmp_path / "cp")).awaitTermination()
    for batch in range(4):  # after every batch the transitions are those of all calls so far
        so_far = spark.createDataFrame(calls[: 150 * (batch + 1)], ORIGIN_CALLS)
        expected = sorted_rows(health.breaker_transitions(so_far))
        assert expected and sorted_rows(health_stream.read_transitions(spark, root, batch)) == expected
    ends = health.ending_state(health.outcome_runs(spark.createDataFrame(calls, ORIGIN_CALLS)))
    names = ends.columns
    found = health_stream.read_endpoints(spark, root, 3).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ends.collect()))


def test_a_late_call_folds_only_the_hours_it_changes(spark, tmp_path):
    root = str(tmp_path / "root")
    # hours 0 to 5: failures, in hour 3 a success after the first failure
    calls = [("e", h * HOUR + 60 * i, 10 * h + i, h == 3 and i == 1) for h in range(6) for i in range(3)]
    health_stream.fold_batch(spark.createDataFrame(calls, ORIGIN_CALLS), 0, root)
    late = [("e", HOUR + 90, 900, True)]  # ends the run in hour 1: what hours 2 and 3 start from changes, not hour 4
    odd = [("e", None, 901, True), ("e", 5, None, True), ("e", 6, 902, None)]
    for _ in range(2):  # a repeated batch replaces what it wrote
        health_stream.fold_batch(spark.createDataFrame(late + odd, ORIGIN_CALLS), 1, root)
    folded = spark.read.parquet(f"{root}/folded/deltas/batch=1")
    assert sorted(r.era for r in folded.collect()) == [1, 2, 3]
    everything = spark.createDataFrame(calls + late, ORIGIN_CALLS)
    assert sorted_rows(health_stream.read_transitions(spark, root)) == sorted_rows(health.breaker_transitions(everything))
    assert sorted(str(r.seq) for r in health_stream.read_rejected(spark, root).collect()) == ["901", "902", "None"]


def warm_facts(spark):
    return spark.createDataFrame([("http://dbpedia.org/resource/A", LABEL, "a", "literal", "en", None)], TRIPLES)


def warm_logs(rows):
    return [(i, t, "entity", key, True, False, 1, "c", 200, '{"entity_id":"A"}') for i, (t, key) in enumerate(rows)]


def test_periodic_warming(spark, tmp_path):
    root, src = str(tmp_path / "cache"), str(tmp_path / "src")
    write_cache(spark.createDataFrame([("k0", "old", 0, 0, 3, 9), ("kx", "old", 0, 0, 3, 9)], CACHE_ENTRIES), root)
    logs = warm_logs([(10, "k0"), (20, "k1"), (30, "k1"), (100, "k2"), (110, "k2"), (120, "k2")])
    write_parts(spark, logs, REQUEST_LOGS, src, 2)
    stream = log_stream.read_log_stream(spark, src, max_files=1)
    warm_stream.warm_stream(
        stream, warm_facts(spark), root, str(tmp_path / "cp"), k=2, interval=None, min_age=95
    ).awaitTermination()
    first = {r.cache_key: r for r in read_cache(spark, root, 1).collect()}
    assert {k: r.created_at_unix_secs for k, r in first.items()} == {"k0": 0, "k1": 30, "kx": 0}  # k0 is too young
    second = {r.cache_key: r for r in read_cache(spark, root, 2).collect()}
    # by all hits k2 and k1 are wanted; k1 was refreshed 90 seconds ago
    assert {k: r.created_at_unix_secs for k, r in second.items()} == {"k0": 0, "k1": 30, "k2": 120, "kx": 0}
    results = [tuple(spark.read.parquet(version_path(f"{root}-results", v)).first()) for v in (1, 2)]
    assert results == [(1, 0), (1, 0)]
    assert {(r.query_hash, r.hits) for r in warm_stream.read_hits(spark, root).collect()} == {("k0", 1), ("k1", 2), ("k2", 3)}


def test_what_a_tick_reads_does_not_grow(spark, tmp_path):
    """Ten ticks: as many files of hits, and of the cache, at the last ones as at the third."""
    root = str(tmp_path / "cache")
    write_cache(spark.createDataFrame([], CACHE_ENTRIES), root, buckets=4)
    files = []
    for tick in range(10):
        logs = spark.createDataFrame(warm_logs([(100 * tick + i, f"k{tick}") for i in range(tick + 1)]), REQUEST_LOGS)
        warm_stream.warm_batch(logs.coalesce(1), tick, warm_facts(spark), root, k=3, every=2)
        hits = len(warm_stream.read_hits(spark, root, tick).inputFiles())
        files.append((hits, len(read_cache(spark, root, tick + 1).inputFiles())))
    assert max(hits for hits, _ in files[3:]) <= max(hits for hits, _ in files[:3]) and max(c for _, c in files) <= 4
    hits = {r.query_hash: r.hits for r in warm_stream.read_hits(spark, root).collect()}
    assert hits == {f"k{t}": t + 1 for t in range(10)}
    assert {r.cache_key for r in read_cache(spark, root, 10).collect()} == {f"k{t}" for t in range(10)}
