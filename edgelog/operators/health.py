"""Origin health from call outcomes, and clients above the edge rate.

An endpoint may hold most calls, so no endpoint's calls are put in order in one task. Calls are cut
into slices (one second of an endpoint, at most 65,536 sequence numbers) that are scanned on their
own; slice totals are added up inside an hour, hour totals inside an endpoint, and what lies before
a slice is joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 3
DEFAULT_ENDPOINT = "https://dbpedia.org/sparql"
COOLDOWN = 30
SLICE_CALLS = 65_536
ERA_SECONDS = 3_600

_BEFORE = (Window.unboundedPreceding, -1)


def _totals_before(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """For each part: failures, failures at the last success, and time of the last call before it.

    ``resets`` of a part counts the failures up to its last success from the part's own start; it
    is null if the part has no success. Failure counts never fall, so the latest one is the largest.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_BEFORE)
    zero = F.lit(0).cast("bigint")
    counted = parts.withColumn("fails_before", F.coalesce(F.sum("fails").over(before), zero))
    return counted.withColumn("resets", F.col("fails_before") + F.col("resets")).select(
        "*",
        F.max("resets").over(before).alias("reset_before"),
        F.max("last_ts").over(before).alias("ts_before"),
    )


def rejected_calls(calls: DataFrame) -> DataFrame:
    """Calls without a time, a number or an outcome, which no report can place."""
    return calls.where("ts IS NULL OR seq IS NULL OR ok IS NULL")


SLICE_KEYS = ["endpoint", "era", "ts", "block"]


def era_of(ts: str = "ts") -> Column:
    """The hour that a call belongs to."""
    return F.expr(f"{ts} div {ERA_SECONDS}")


def scan_slices(calls: DataFrame, default_endpoint: str = DEFAULT_ENDPOINT) -> DataFrame:
    """Calls that can be placed, with counts of failures from the start of their slice."""
    sliced = calls.where(F.col("ok").isNotNull()).select(
        F.coalesce("endpoint", F.lit(default_endpoint)).alias("endpoint"),
        era_of().alias("era"),
        "ts",
        F.expr(f"seq div {SLICE_CALLS}").alias("block"),
        "seq",
        "ok",
        (~F.col("ok")).cast("bigint").alias("failed"),
    )
    # The joins below would add these filters to some branches only, and so shuffle the calls thrice.
    for key in SLICE_KEYS:
        sliced = sliced.where(F.col(key).isNotNull())
    in_slice = Window.partitionBy(*SLICE_KEYS).orderBy("seq")
    return sliced.withColumn(
        "fails", F.sum("failed").over(in_slice.rowsBetween(Window.unboundedPreceding, 0))
    ).select(
        "*",
        F.max(F.when(F.col("ok"), F.col("fails"))).over(in_slice.rowsBetween(*_BEFORE)).alias("reset"),
        F.row_number().over(in_slice).alias("place"),
    )


def slice_totals(scanned: DataFrame) -> DataFrame:
    """Totals of each slice, and what lies before it in its hour."""
    slices = scanned.groupBy(*SLICE_KEYS).agg(
        F.sum("failed").alias("fails"),
        F.max(F.when(F.col("ok"), F.col("fails"))).alias("resets"),
        F.max("ts").alias("last_ts"),
        F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success"),
    )
    return _totals_before(slices, ["endpoint", "era"], ["ts", "block"])


def hour_totals(slices: DataFrame) -> DataFrame:
    """Totals of each endpoint's hour. Totals of hours in a row join to totals of all of them (``carried_over``), so they
    can be kept and only those of hours with new calls made anew."""
    return slices.groupBy("endpoint", "era").agg(
        F.sum("fails").alias("fails"),
        F.max("resets").alias("resets"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("last_seq", F.struct("ts", "block")).alias("last_seq"),
        F.max("last_success").alias("last_success"),
    )


def carried_over(hours: DataFrame) -> DataFrame:
    """What each hour starts from: failures before it, those at the last success before it, time of the last call."""
    return _totals_before(hours, ["endpoint"], ["era"]).select(
        "endpoint",
        "era",
        F.col("fails_before").alias("era_fails"),
        F.col("reset_before").alias("era_reset"),
        F.col("ts_before").alias("era_ts"),
    )


def runs_from(scanned: DataFrame, slices: DataFrame, carried: DataFrame) -> DataFrame:
    """``outcome_runs`` of scanned calls, given what their hours start from."""
    carried = slices.join(carried, ["endpoint", "era"]).select(
        *SLICE_KEYS,
        (F.col("era_fails") + F.col("fails_before")).alias("carried_fails"),
        F.coalesce(F.col("era_fails") + F.col("reset_before"), "era_reset").alias("carried_reset"),
        F.coalesce("ts_before", "era_ts").alias("carried_ts"),
    )
    zero = F.lit(0).cast("bigint")
    run = F.coalesce(F.col("carried_fails") + F.col("reset"), "carried_reset", zero)
    return scanned.join(carried, SLICE_KEYS).select(
        "endpoint",
        "ts",
        "seq",
        "ok",
        run.alias("run"),
        (F.col("carried_fails") + F.col("fails") - F.col("failed") - run).alias("failures_before"),
        F.when(F.col("place") > 1, F.col("ts")).otherwise(F.col("carried_ts")).alias("previous_ts"),
    )


def outcome_runs(calls: DataFrame, default_endpoint: str = DEFAULT_ENDPOINT) -> DataFrame:
    """Each call with the consecutive failures before it and the time of the call before it.

    ``calls(endpoint, ts, seq, ok)`` are ordered by ``(ts, seq)`` per endpoint; ``ts`` is in epoch
    seconds. A null endpoint is the default one; see ``rejected_calls`` for rows that cannot be placed. ``run``
    numbers the failure run a failed call belongs to.
    """
    scanned = scan_slices(calls, default_endpoint)
    slices = slice_totals(scanned)
    return runs_from(scanned, slices, carried_over(hour_totals(slices)))


def origin_incidents(calls: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Runs of at least ``threshold`` consecutive failures, with start, end and length."""
    failures = outcome_runs(calls).where(~F.col("ok"))
    return (
        failures.groupBy("endpoint", "run")
        .agg(
            F.min("ts").alias("started_at_unix_secs"),
            F.max("ts").alias("ended_at_unix_secs"),
            F.count(F.lit(1)).alias("failures"),
        )
        .where(F.col("failures") >= threshold)
        .drop("run")
    )


def transitions_of(
    runs: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, keep: tuple[Column, ...] = ()
) -> DataFrame:
    """Breaker transitions seen at each call of ``outcome_runs``, with columns to ``keep`` of the call.

    From ``threshold`` consecutive failures on the breaker is open and every further failure
    restarts the cooldown, so the call before decides alone whether it has become half open. That
    moment is given as the earliest possible one, the end of the cooldown.
    """
    ts, ok = F.col("ts"), F.col("ok")
    tripped = F.col("failures_before") >= threshold
    cooled = tripped & (ts - F.col("previous_ts") >= cooldown)
    state = F.when(cooled, F.lit("half_open")).when(tripped, F.lit("open")).otherwise(F.lit("closed"))

    def step(condition, at, before, after):
        return F.when(
            condition,
            F.struct(
                at.alias("at_unix_secs"),
                F.lit(before).alias("from_state") if isinstance(before, str) else before.alias("from_state"),
                F.lit(after).alias("to_state"),
            ),
        )

    opens = ~ok & (cooled | (~tripped & (F.col("failures_before") + 1 >= threshold)))
    steps = F.array(
        step(cooled, F.col("previous_ts") + cooldown, "open", "half_open"),
        step(opens, ts, state, "open"),
        step(ok & tripped, ts, state, "closed"),
    )
    found = runs.select("endpoint", "seq", *keep, F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("step"))
    return found.select(*found.columns[:-1], "step.*")


def breaker_transitions(
    calls: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN
) -> DataFrame:
    """State changes of a breaker per endpoint; ``seq`` is the call that shows the change."""
    return transitions_of(outcome_runs(calls), threshold, cooldown)


def ending_state(runs: DataFrame) -> DataFrame:
    """How the calls of each endpoint end: failure count, last call, last success."""
    order = F.struct("ts", "seq")
    left = F.when(F.col("ok"), F.lit(0).cast("bigint")).otherwise(F.col("failures_before") + 1)
    return runs.groupBy("endpoint").agg(
        F.max_by(left, order).alias("failure_count"),
        F.max("ts").alias("last_ts"),
        F.max_by("seq", order).alias("last_seq"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_unix_secs"),
    )


def breaker_snapshot(
    calls: DataFrame, as_of, threshold: int = THRESHOLD, cooldown: int = COOLDOWN
) -> DataFrame:
    """State of each endpoint's breaker at ``as_of``, after all given calls."""
    at = as_of if hasattr(as_of, "cast") else F.lit(as_of)
    tripped = F.col("failure_count") >= threshold
    return ending_state(outcome_runs(calls)).select(
        "endpoint",
        F.when(tripped & (at - F.col("last_ts") >= cooldown), F.lit("half_open"))
        .when(tripped, F.lit("open"))
        .otherwise(F.lit("closed"))
        .alias("state"),
        "failure_count",
        F.when(tripped, F.col("last_ts")).alias("opened_at_unix_secs"),
        "last_success_unix_secs",
    )


def rate_breaches(
    logs: DataFrame, rate: float = 5, burst: int = 10, window: int = 1
) -> DataFrame:
    """Seconds in which a client's requests of the trailing window exceed ``rate*window+burst``.

    Requests are first counted per client and second. A client's seconds are then cut into
    stretches of eight windows, each led by the seconds that reach into it, so that a stretch can
    be scanned alone and holds no more rows than nine windows have seconds.
    """
    seconds = logs.groupBy("client_hash", "observed_at_unix_secs").agg(
        F.count(F.lit(1)).alias("requests")
    )
    stretch = 8 * window
    at = F.col("observed_at_unix_secs")
    own = F.expr(f"observed_at_unix_secs div {stretch}")
    reaches_on = F.pmod(at, F.lit(stretch)) >= stretch - window + 1
    pieces = seconds.withColumn("own", own).withColumn(
        "stretch",
        F.explode(F.when(reaches_on, F.array(own, own + 1)).otherwise(F.array(own))),
    )
    trailing = (
        Window.partitionBy("client_hash", "stretch")
        .orderBy("observed_at_unix_secs")
        .rangeBetween(-(window - 1), 0)
    )
    return (
        pieces.withColumn("window_requests", F.sum("requests").over(trailing))
        .where((F.col("stretch") == F.col("own")) & (F.col("window_requests") > rate * window + burst))
        .select("client_hash", "observed_at_unix_secs", "requests", "window_requests")
    )
