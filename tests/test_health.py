from __future__ import annotations

import random
from collections import defaultdict

import pytest

from edgelog.operators import health
from edgelog.schemas import ORIGIN_CALLS


def random_calls(rng, n, span):
    return [
        ("hot" if rng.random() < 0.6 else f"e{rng.randrange(3)}", rng.randrange(span), seq * 7919 % 10_007 * 40,
         rng.random() < 0.35)
        for seq in range(n)
    ]


# Outcomes of one endpoint (time, ok), threshold, cooldown, and the steps (time, from, to), worked out by hand.
HISTORIES = {
    "too few failures": ([(3, False), (4, False), (5, True), (6, False)], 3, 30, []),
    "opens and stays open": ([(3, False), (8, False), (9, False), (20, False)], 2, 30, [(8, "closed", "open")]),
    "a success within the cooldown closes": (
        [(3, False), (8, False), (9, True)], 2, 30, [(8, "closed", "open"), (9, "open", "closed")]
    ),
    "probe after the cooldown succeeds": (
        [(10, False), (11, False), (50, True), (51, False)], 2, 30,
        [(11, "closed", "open"), (41, "open", "half_open"), (50, "half_open", "closed")],
    ),
    "probe fails, and opens anew": (
        [(10, False), (40, False), (69, False), (99, True)], 1, 30,
        [(10, "closed", "open"), (40, "open", "half_open"), (40, "half_open", "open"),
         (99, "open", "half_open"), (99, "half_open", "closed")],
    ),
}


def test_transitions_worked_out_by_hand(spark):
    for name, (outcomes, threshold, cooldown, steps) in HISTORIES.items():
        calls = spark.createDataFrame([("e", ts, i, ok) for i, (ts, ok) in enumerate(outcomes)], ORIGIN_CALLS)
        found = health.breaker_transitions(calls, threshold, cooldown).collect()
        order = {"closed": 0, "open": 1, "half_open": 2}
        found = sorted((r.seq, r.at_unix_secs, (order[r.to_state] - order[r.from_state]) % 3 == 2, r) for r in found)
        assert sorted((r.at_unix_secs, r.from_state, r.to_state) for *_, r in found) == sorted(steps), name


@pytest.mark.parametrize("span", [40, 2_000, 60_000])
@pytest.mark.parametrize("threshold, cooldown", [(1, 5), (3, 30)])
def test_breaker_from_run_lengths_and_gaps(spark, span, threshold, cooldown):
    """What must hold for any history: each step follows from the failure run before it and the time since."""
    calls = random_calls(random.Random(span), 900, span)
    df = spark.createDataFrame(calls, ORIGIN_CALLS)
    found = defaultdict(list)
    for r in health.breaker_transitions(df, threshold, cooldown).collect():
        found[r.endpoint, r.seq].append((r.at_unix_secs, r.from_state, r.to_state))
    by_endpoint = defaultdict(list)
    for endpoint, ts, seq, ok in sorted(calls, key=lambda c: (c[1], c[2])):
        by_endpoint[endpoint].append((ts, seq, ok))
    placed = 0
    for endpoint, own in by_endpoint.items():
        for i, (ts, seq, ok) in enumerate(own):
            run = next((k for k, (_, _, good) in enumerate(reversed(own[:i])) if good), i)  # failures just before
            tripped = run >= threshold
            rested = tripped and ts - own[i - 1][0] >= cooldown
            steps = [(own[i - 1][0] + cooldown, "open", "half_open")] if rested else []
            state = "half_open" if rested else "open" if tripped else "closed"
            after = "closed" if ok else "open" if run + 1 >= threshold else "closed"
            steps += [(ts, state, after)] if state != after else []
            assert sorted(found.get((endpoint, seq), [])) == sorted(steps)
            placed += len(steps)
    assert placed == sum(map(len, found.values()))


def test_snapshots(spark):
    calls = [("never", 5, 1, True), ("open", 5, 2, True), ("open", 90, 3, False), ("rested", 20, 4, False),
             (None, 70, 5, False), ("two", 1, 6, False), ("two", 2, 7, True)]
    rows = health.breaker_snapshot(spark.createDataFrame(calls, ORIGIN_CALLS), 100, 1, 40).collect()
    found = {r.endpoint: (r.state, r.failure_count, r.opened_at_unix_secs, r.last_success_unix_secs) for r in rows}
    assert found == {
        "never": ("closed", 0, None, 5),
        "open": ("open", 1, 90, 5),
        "rested": ("half_open", 1, 20, None),
        health.DEFAULT_ENDPOINT: ("open", 1, 70, None),
        "two": ("closed", 0, None, 2),
    }


def test_calls_without_an_endpoint_are_the_default_ones(spark):
    calls = [(None, t, t, False) for t in range(3)] + [(health.DEFAULT_ENDPOINT, 3, 3, False), ("e", None, 4, False)]
    df = spark.createDataFrame(calls, ORIGIN_CALLS)
    assert [tuple(r) for r in health.origin_incidents(df).collect()] == [(health.DEFAULT_ENDPOINT, 0, 3, 4)]
    assert [r.seq for r in health.rejected_calls(df).collect()] == [4]


def incidents(calls, threshold):
    found, runs = set(), defaultdict(list)

    def close(endpoint):
        run = runs.pop(endpoint, [])
        if len(run) >= threshold:
            found.add((endpoint, run[0], run[-1], len(run)))

    for endpoint, ts, _, ok in sorted(calls, key=lambda c: (c[1], c[2])):
        if ok:
            close(endpoint)
        else:
            runs[endpoint].append(ts)
    for endpoint in list(runs):
        close(endpoint)
    return found


@pytest.mark.parametrize("slice_calls", [3, 65_536])
def test_incidents_cross_slices(spark, monkeypatch, slice_calls):
    monkeypatch.setattr(health, "SLICE_CALLS", slice_calls)
    monkeypatch.setattr(health, "ERA_SECONDS", 50)
    calls = [("hot", i // 40, i, i % 97 == 50) for i in range(2500)] + random_calls(random.Random(1), 600, 400)
    df = spark.createDataFrame(calls, ORIGIN_CALLS)
    assert {tuple(r) for r in health.origin_incidents(df).collect()} == incidents(calls, 3)


@pytest.mark.parametrize("window, rate, burst", [(1, 2, 1), (10, 0.5, 3), (86_400, 0, 30)])
def test_rate_breaches_against_a_plain_count(spark, window, rate, burst):
    rng = random.Random(window)
    rows = [("hot" if rng.random() < 0.5 else f"c{rng.randrange(9)}", rng.randrange(window * 40)) for _ in range(2500)]
    if window == 1:
        rows = [(c, t % 300) for c, t in rows] + [("burst", 17)] * 9
    df = spark.createDataFrame(rows, "client_hash string, observed_at_unix_secs long")
    times = defaultdict(list)
    for client, t in rows:
        times[client].append(t)
    expected = set()
    for client, all_times in times.items():
        for t in set(all_times):
            trailing = sum(t - window < other <= t for other in all_times)
            if trailing > rate * window + burst:
                expected.add((client, t, all_times.count(t), trailing))
    assert {tuple(r) for r in health.rate_breaches(df, rate, burst, window).collect()} == expected
    assert expected
