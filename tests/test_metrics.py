from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgelog.functions import labels
from edgelog.functions.numeric import ratio
from edgelog.operators import metrics, popular

SCHEMA = (
    "observed_at_unix_secs long, cache_hit boolean, stale boolean, latency_ms int, status_code short"
)
#: Eight requests: five hits (one of them stale with a server error), two origin errors; latencies 3, 6, .. 24.
ROWS = [
    (86_400 * 3 + 11 * i, i in (0, 1, 2, 5, 6), i == 5, 3 * (i + 1), 503 if i in (3, 5, 7) else 200) for i in range(8)
]


def test_summary(spark):
    row = metrics.summarize(spark.createDataFrame(ROWS, SCHEMA), 86_400 * 4).first().asDict()
    assert row == {
        "rolling_window_seconds": 86_400,
        "total_requests": 8,
        "cache_hits": 5,
        "stale_responses": 1,
        "origin_errors": 2,
        "cache_hit_rate": 0.625,
        "stale_response_rate": 0.125,
        "origin_error_rate": 0.25,
        "p95_latency_ms": 24,
    }


def test_empty_summary_is_one_row_of_zeros(spark):
    rows = metrics.summarize(spark.createDataFrame([], SCHEMA), 0).collect()
    assert len(rows) == 1
    assert all(value == 0 for name, value in rows[0].asDict().items() if name != "rolling_window_seconds")


def test_window_has_a_lower_bound_only(spark):
    logs = spark.createDataFrame([(t, False, False, 1, 200) for t in (99, 100, 5_000_000)], SCHEMA)
    assert metrics.summarize(logs, 86_500).first().total_requests == 2


def test_stale_answers_with_a_server_error_status_are_no_origin_errors(spark):
    logs = spark.createDataFrame([(5, True, True, 1, 503), (5, False, False, 1, 503)], SCHEMA)
    assert metrics.summarize(logs, 5).first().origin_errors == 1


def test_timeseries(spark):
    times = [3 * 3600 - 1, 3 * 3600, 3 * 3600 + 5, 4 * 3600 - 1, 9 * 3600]
    logs = spark.createDataFrame([(t, t % 2 == 0, False, t % 7, 200) for t in times], SCHEMA)
    points = metrics.timeseries(logs, 9 * 3600, window=7 * 3600, bucket=3600).collect()
    assert [(p.observed_at_unix_secs // 3600, p.total_requests) for p in points] == [(2, 1), (3, 3), (9, 1)]
    assert points[1].cache_hit_rate == 1 / 3
    assert {(p.bucket_seconds, p.rolling_window_seconds) for p in points} == {(3600, 7 * 3600)}
    assert metrics.timeseries(logs.where("false"), 9 * 3600).collect() == []


def expected_rank(values, fraction):
    ordered = sorted(values)
    return ordered[max(math.ceil(len(ordered) * fraction) - 1, 0)] if ordered else 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.one_of(st.integers(0, 30), st.integers(0, 2**31 - 1))),
        min_size=1,
        max_size=300,
    )
)
def test_percentiles_are_nearest_ranks_in_every_bucket(spark, rows):
    logs = spark.createDataFrame([(b * 3600, False, False, v, 200) for b, v in rows], SCHEMA)
    fractions = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = metrics.summarize_histogram(
        metrics.bucket_histogram(logs), "observed_at_unix_secs", percentiles=fractions
    ).collect()
    for row in found:
        values = [v for b, v in rows if b * 3600 == row.observed_at_unix_secs]
        for name, fraction in fractions.items():
            assert row[name] == expected_rank(values, fraction)


def test_merged_hours_equal_a_day(spark):
    rows = [(i * 97 % 86_400, i % 3 == 0, i % 7 == 0, i * i % 1000, 200 + 301 * (i % 5 == 0)) for i in range(3000)]
    logs = spark.createDataFrame(rows, SCHEMA)
    hours = metrics.bucket_histogram(logs)
    merged = metrics.summarize_histogram(metrics.merge_histograms(hours)).first()
    direct = metrics.summarize_histogram(metrics.latency_histogram(logs)).first()
    assert merged == direct


def test_gaps_are_filled_between_first_and_last_point_only(spark):
    logs = spark.createDataFrame([(t, True, False, 9, 200) for t in (3600, 4000, 14_400)], SCHEMA)
    points = metrics.hourly_points(metrics.bucket_histogram(logs))
    filled = metrics.fill_gaps(points).orderBy("observed_at_unix_secs").collect()
    assert [(p.observed_at_unix_secs, p.total_requests) for p in filled] == [
        (3600, 2), (7200, 0), (10_800, 0), (14_400, 1)
    ]
    assert filled[1].cache_hit_rate == 0.0 and filled[1].p95_latency_ms == 0
    assert metrics.fill_gaps(points.where("false")).count() == 0


def test_busiest_hour_is_the_earliest_of_equals(spark):
    points = spark.createDataFrame(
        [(3600, 2), (7200, 5), (10_800, 5), (14_400, 1)], "observed_at_unix_secs long, total_requests long"
    )
    assert tuple(metrics.busiest_hour(points).first()) == (7200, 5)
    assert tuple(metrics.latest_hour(points).first()) == (14_400, 1)
    assert metrics.busiest_hour(points.where("false")).count() == 0


def test_ratio_and_labels(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("none"),
        *[labels.percent_label(F.lit(x)).alias(f"p{i}") for i, x in enumerate((0.125, 0.005, 1.0, float("nan")))],
        labels.percent_label(F.lit(None).cast("double")).alias("missing"),
        labels.number_label(F.lit(1234567)).alias("n"),
        labels.bucket_label(F.lit(1700000000), "Europe/Berlin").alias("at"),
    ).first()
    assert tuple(row) == (0.0, "13%", "1%", "100%", "0%", "0%", "1,234,567", "23:13")


def test_bucket_label_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert spark.range(1).select(labels.bucket_label(F.lit(1700000000))).first()[0] == "22:13"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


LOG = "route string, query_hash string, metadata string"


def test_popular_entities(spark):
    logs = spark.createDataFrame(
        [("entity", "h1", '{"entity_id":"A","lang":"de","endpoint":null}')] * 3
        + [("entity", "h2", '{"entity_id":"B"}')] * 2
        + [("entity", "h0", '{"entity_id":"C","endpoint":"e"}')] * 2
        + [("entity", "h4", "{}"), ("search", "h5", '{"entity_id":"D"}'), ("entity", "h6", '{"entity_id":null}')],
        LOG,
    )
    rows = [tuple(r) for r in popular.popular_entities(logs, 3).collect()]
    assert rows == [("A", "h1", "de", None, 3), ("B", "h2", "en", None, 2), ("C", "h0", "en", "e", 2)]
    assert popular.entity_hits(logs).count() == 4
    with pytest.raises(ValueError):
        popular.popular_entities(logs, 0)


def test_top_k_is_taken_per_task(spark):
    logs = spark.createDataFrame([("entity", "h", '{"entity_id":"A"}')], LOG)
    plan = popular.popular_entities(logs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_gaps_of_fifty_years_are_filled_in_small_steps(spark):
    """438,000 hours: all of them, each once, and no array in a row of more than a few hundred."""
    first, hours = 7_200, 50 * 365 * 24
    rows = [(first, 5, 0.5, 0.0, 9), (first + 3_600 * hours, 2, 0.0, 1.0, 7), (first + 3_600 * 66_000, 1, 0.0, 0.0, 1)]
    schema = "observed_at_unix_secs long, total_requests long, cache_hit_rate double, stale_response_rate double, p95_latency_ms long"
    filled = metrics.fill_gaps(spark.createDataFrame(rows, schema))
    at = F.col("observed_at_unix_secs")
    assert filled.agg(F.count("*"), F.count_distinct(at), F.min(at), F.max(at), F.sum(at % 3_600)).first() == (
        hours + 1, hours + 1, first, first + 3_600 * hours, 0,
    )
    assert sorted(map(tuple, filled.where("total_requests > 0").collect())) == sorted(rows)
    assert filled.where("total_requests = 0 AND p95_latency_ms = 0 AND cache_hit_rate = 0").count() == hours - 2
    assert metrics.fill_gaps(spark.createDataFrame([], schema)).collect() == []
    one = metrics.fill_gaps(spark.createDataFrame(rows[:1], schema)).collect()
    assert [tuple(r) for r in one] == rows[:1]
    assert max(metrics.FAN, -(-hours // metrics.FAN**2)) <= 256
