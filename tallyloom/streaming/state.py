"""Keyed state machines over logs: token bucket, circuit breaker and the filter of visible text.

Each machine is one step function. The batch twin sorts a log by key and time
within partitions and streams through it, holding one key's state; the
streaming form keeps the same state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[tuple | None, Any], tuple[tuple, Any]]


def bucket_step(capacity: float = 60.0, window: float = 60.0) -> Step:
    """State (tokens, time); input seconds; result: whether a request passes."""
    rate = capacity / window

    def step(state, at):
        tokens, last = state or (capacity, at)
        tokens = min(capacity, tokens + (at - last) * rate)
        ok = tokens >= 1.0
        return (tokens - ok, at), ok

    return step


def breaker_step(failures: int = 5, rest: float = 60.0) -> Step:
    """State (name, failures in a row, opened at); input (seconds, whether the call succeeded); result (admitted, state).

    A call that isn't admitted changes nothing. An open breaker admits after
    `rest` seconds and is half open until a call succeeds or fails.
    """

    def step(state, call):
        at, ok = call
        name, n, opened = state or ("CLOSED", 0, 0.0)
        if name == "OPEN" and at - opened < rest:
            return (name, n, opened), (False, name)
        if name == "OPEN":
            name = "HALF_OPEN"
        if ok:
            new = ("CLOSED", 0, opened)
        elif name == "HALF_OPEN" or n + 1 >= failures:
            new = ("OPEN", n + 1, at)
        else:
            new = (name, n + 1, opened)
        return new, (True, new[0])

    return step


FENCE, CLOSE = "```chart_data", "```"


def visible_step(state: tuple | None, delta: str) -> tuple[tuple, str]:
    """State (inside a chart, held text); input a piece of text; result what may be shown now.

    Text that may be the start of a chart fence is held, so the result of a
    whole stream doesn't depend on where it is cut.
    """
    inside, held = state or (False, "")
    held, out = held + delta, ""
    while True:
        at = held.find(CLOSE if inside else FENCE)
        if at < 0:
            break
        out += "" if inside else held[:at]
        held = held[at + len(CLOSE if inside else FENCE) :]
        inside = not inside
    if inside:
        return (True, held[-2:]), out
    keep = next((n for n in range(min(len(held), len(FENCE) - 1), 0, -1) if held.endswith(FENCE[:n])), 0)
    return (False, held[len(held) - keep :]), out + held[: len(held) - keep]


def visible_text(deltas: list[str]) -> str:
    """What a reader sees of a whole stream; a held rest is shown at its end."""
    state, out = None, []
    for d in deltas:
        state, shown = visible_step(state, d)
        out.append(shown)
    return "".join(out) + (state[1] if state and not state[0] else "")


def replay(log: DataFrame, key: str, order: list[str], make: Callable[[], Step], columns: list[str], result: str, schema: str) -> DataFrame:
    """key, the order columns and the machine's result for each row of a log.

    Rows are sorted within hash partitions of the key and streamed, so memory
    holds one key's state whatever the length of its log.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, at, state = make(), object(), None
        for b in batches:
            got = []
            for k, *xs in zip(b[key], *(b[c] for c in columns)):
                if k != at:
                    at, state = k, None
                state, r = step(state, xs[0] if len(xs) == 1 else tuple(xs))
                got.append(r)
            yield b[[key, *order]].assign(**{result: pd.Series(got, index=b.index, dtype=object)})

    used = list(dict.fromkeys([key, *order, *columns]))
    rows = log.select(*used).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(run, schema)


def rate_limited(log: DataFrame, key: str = "user_id", time: str = "ts", ident: str = "event_id", capacity: float = 60.0, window: float = 60.0) -> DataFrame:
    """key, seconds, ident, allowed: which requests a token bucket per key lets pass."""
    df = log.withColumn("_s", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    kinds = dict(log.dtypes)
    return replay(df, key, ["_s", ident], lambda: bucket_step(capacity, window), ["_s"], "allowed", f"{key} {kinds[key]}, _s double, {ident} {kinds[ident]}, allowed boolean").withColumnRenamed("_s", "seconds")


def breaker_states(log: DataFrame, key: str, time: str, ident: str, ok: str, failures: int = 5, rest: float = 60.0) -> DataFrame:
    """key, seconds, ident, outcome (`admitted:STATE` or `refused:STATE`) of each call."""
    df = log.withColumns({"_s": F.unix_micros(F.col(time).cast("timestamp")) / 1e6, "_ok": F.col(ok).cast("boolean")})
    kinds = dict(log.dtypes)

    def make() -> Step:
        step = breaker_step(failures, rest)

        def named(state, call):
            state, (admitted, name) = step(state, call)
            return state, f"{'admitted' if admitted else 'refused'}:{name}"

        return named

    return replay(df, key, ["_s", ident], make, ["_s", "_ok"], "outcome", f"{key} {kinds[key]}, _s double, {ident} {kinds[ident]}, outcome string").withColumnRenamed("_s", "seconds")


def retried(log: DataFrame, key: list[str], order: str, ok: str, attempts: int = 3, waits: tuple[float, ...] = (2.0, 4.0)) -> DataFrame:
    """key, tried, waited, answered: how a request with retries went, from the log of all its possible attempts.

    A request is tried until it succeeds, at most `attempts` times; after each
    failed attempt but the last it waits. Attempts without an outcome failed.
    Ranks are cut at `attempts`, so long logs of one key cost no memory.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    first = log.select(*key, F.coalesce(F.col(ok).cast("boolean"), F.lit(False)).alias("_ok"), n.alias("_n")).where(F.col("_n") <= attempts)
    g = first.groupBy(*key).agg(F.min(F.when(F.col("_ok"), F.col("_n"))).alias("_hit"), F.max("_n").alias("_all"))
    tried = F.coalesce("_hit", "_all")
    slept = F.aggregate(F.slice(F.array(*[F.lit(float(w)) for w in waits]), F.lit(1), tried - 1), F.lit(0.0), lambda a, x: a + x)
    return g.select(*key, tried.alias("tried"), slept.alias("waited"), F.col("_hit").isNotNull().alias("answered"))


def cache_step(ttl: float = 600.0) -> Step:
    """State (value, time it was fetched); input (seconds, the value now); result the value that is served and whether it was fetched."""

    def step(state, x):
        at, now = x
        if state is None or at - state[1] >= ttl:
            return (now, at), (now, True)
        return state, (state[0], False)

    return step


def cached_reads(log: DataFrame, key: str, time: str, ident: str, value: str, ttl: float = 600.0) -> DataFrame:
    """key, seconds, ident, served (the value and whether it was fetched, as text) of reads through a cache."""
    df = log.withColumns({"_s": F.unix_micros(F.col(time).cast("timestamp")) / 1e6, "_v": F.col(value).cast("string")})
    kinds = dict(log.dtypes)

    def make() -> Step:
        step = cache_step(ttl)

        def named(state, x):
            state, (v, fetched) = step(state, x)
            return state, f"{'fetched' if fetched else 'cached'}:{v}"

        return named

    return replay(df, key, ["_s", ident], make, ["_s", "_v"], "served", f"{key} {kinds[key]}, _s double, {ident} {kinds[ident]}, served string").withColumnRenamed("_s", "seconds")


def machine_stream(log: DataFrame, key: str, time: str, ident: str, inputs: list[str], make: Callable[[], Step], state: str, result: str, kind: str, *, idle: float, late: str = "1 hour") -> DataFrame:
    """The streaming form of `replay`: key, seconds, ident and the machine's result, with one state a key.

    A key's state is dropped once the watermark is `idle` seconds past its
    last row, when it would be that of a new key anyway. Rows of one batch are
    sorted by time; rows later than the watermark are dropped by Spark.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(log.dtypes)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    # a watermark starts at the epoch, and a row of that very instant isn't late
    df = log.withColumns({"at": F.timestamp_micros(micros + 1), "seconds": micros / 1e6}).withWatermark("at", late).select(key, ident, "at", "seconds", *inputs)

    def run(k, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        step, now = make(), held.getOption if held.exists else None
        rows = pd.concat(list(batches)).sort_values(["seconds", ident])
        got = []
        for xs in zip(rows["seconds"], *(rows[c] for c in inputs)):
            now, r = step(now, xs[0] if len(xs) == 1 else xs)
            got.append(r)
        held.update(now)
        held.setTimeoutTimestamp(max(int((rows["seconds"].iloc[-1] + idle) * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], "seconds": rows["seconds"].to_numpy(), ident: rows[ident].to_numpy(), result: got})

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, seconds double, {ident} {kinds[ident]}, {result} {kind}", state, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_stream(log: DataFrame, key: str = "user_id", time: str = "ts", ident: str = "event_id", capacity: float = 60.0, window: float = 60.0, late: str = "1 hour") -> DataFrame:
    """The streaming form of `rate_limited`; a key's state is dropped once its bucket would be full again."""
    return machine_stream(log, key, time, ident, [], lambda: bucket_step(capacity, window), "tokens double, last double", "allowed", "boolean", idle=window, late=late)


def breaker_stream(log: DataFrame, key: str, time: str, ident: str, ok: str, failures: int = 5, rest: float = 60.0, idle: float = 86_400.0, late: str = "1 hour") -> DataFrame:
    """The streaming form of `breaker_states`; a breaker that nothing calls for `idle` seconds is taken for closed."""

    def make() -> Step:
        step = breaker_step(failures, rest)

        def named(state, call):
            state, (admitted, name) = step(state, (call[0], bool(call[1])))
            return state, f"{'admitted' if admitted else 'refused'}:{name}"

        return named

    return machine_stream(log, key, time, ident, [ok], make, "name string, failed int, opened double", "outcome", "string", idle=idle, late=late)


def visible_stream(deltas: DataFrame, key: str, time: str, ident: str, delta: str, idle: float = 3_600.0, late: str = "1 hour") -> DataFrame:
    """The streaming form of the filter of visible text: what each piece of an answer lets through."""
    return machine_stream(deltas, key, time, ident, [delta], lambda: lambda state, x: visible_step(state, x[1]), "inside boolean, held string", "shown", "string", idle=idle, late=late)
