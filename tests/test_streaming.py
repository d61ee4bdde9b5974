"""State machines and windows; batch and stream agree."""

import random

from pyspark.sql import functions as F

from tallyloom.streaming import state, windows


def test_bucket_and_breaker_steps():
    step, s, got = state.bucket_step(2.0, 60.0), None, []
    for at in (0.0, 0.0, 0.0, 30.0, 31.0):
        s, ok = step(s, at)
        got.append(ok)
    assert got == [True, True, False, True, False]
    step, s, got = state.breaker_step(2, 60.0), None, []
    for call in ((0, False), (1, False), (2, True), (61, False), (70, True), (121, True), (122, False)):
        s, r = step(s, call)
        got.append(r)
    assert got == [(True, "CLOSED"), (True, "OPEN"), (False, "OPEN"), (True, "OPEN"), (False, "OPEN"), (True, "CLOSED"), (True, "CLOSED")]


def test_visible_text_does_not_depend_on_the_cuts():
    whole = "Before ```chart_data\n{\"x\": 1}\n``` after ```code``` end"
    rng = random.Random(1)
    for _ in range(50):
        cuts = sorted(rng.sample(range(len(whole)), 6))
        parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
        assert state.visible_text(parts) == state.visible_text(list(whole)) == "Before  after ```code``` end"
    assert state.visible_text(["open ```chart", "_data {"]) == "open " and state.visible_text(["held ``"]) == "held ``" and state.visible_text([]) == ""


def log(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(200), rng.choice([True, False])) for i in range(300)]
    return spark.createDataFrame(rows, "event_id long, user_id long, s long, ok boolean").withColumn("ts", F.timestamp_seconds("s")), rows


def test_replays_match_a_plain_loop(spark):
    df, rows = log(spark)
    for name, got, make, pick in (
        ("allowed", state.rate_limited(df, capacity=5.0), lambda: state.bucket_step(5.0), lambda r: float(r[2])),
        ("outcome", state.breaker_states(df, "user_id", "ts", "event_id", "ok", 2, 20.0), lambda: state.breaker_step(2, 20.0), lambda r: (float(r[2]), r[3])),
    ):
        want, held = {}, {}
        for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            held[r[1]], x = make()(held.get(r[1]), pick(r))
            want[r[0]] = x if name == "allowed" else f"{'admitted' if x[0] else 'refused'}:{x[1]}"
        assert {r.event_id: r[name] for r in got.collect()} == want
    assert state.rate_limited(df.limit(0)).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    df, _ = log(spark)
    src = str(tmp_path / "src")
    df.select("event_id", "user_id", "ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(src)
    q = state.rate_limited_stream(stream, capacity=5.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.allowed) for r in spark.table("limited").collect()} == {(r.event_id, r.allowed) for r in state.rate_limited(df, capacity=5.0).collect()}


def test_windowed_stream_with_watermark(spark, tmp_path):
    df, _ = log(spark)
    src = str(tmp_path / "src")
    ev = df.select("event_id", "ts", F.lit(1.0).alias("value"))
    ev.write.parquet(src)
    stream = windows.with_time(spark.readStream.schema("event_id long, ts timestamp, value double").parquet(src), late="10 minutes")
    q = windows.tumbling(stream, "1 minute").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((str(r.window_start), r.n) for r in rows)
    assert key(spark.table("win").collect()) == key(windows.tumbling(windows.with_time(ev), "1 minute").collect())


def run_stream(spark, tmp_path, rows, schema, make, name):
    src = str(tmp_path / "src")
    rows.coalesce(1).write.parquet(src)
    q = make(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_breaker_stream_agrees_with_batch(spark, tmp_path):
    df, _ = log(spark)
    got = run_stream(spark, tmp_path, df.select("event_id", "user_id", "ts", "ok"), "event_id long, user_id long, ts timestamp, ok boolean", lambda s: state.breaker_stream(s, "user_id", "ts", "event_id", "ok", 2, 20.0), "breakers")
    assert {(r.event_id, r.outcome) for r in got} == {(r.event_id, r.outcome) for r in state.breaker_states(df, "user_id", "ts", "event_id", "ok", 2, 20.0).collect()}


def test_visible_stream(spark, tmp_path):
    parts = ["Up ```chart", "_data\n{1}", "\n``` down", "."]
    df = spark.createDataFrame([(k, 7, k + 1, p) for k, p in enumerate(parts)], "n long, answer long, s long, delta string").withColumn("ts", F.timestamp_seconds("s")).select("n", "answer", "ts", "delta")
    got = run_stream(spark, tmp_path, df, "n long, answer long, ts timestamp, delta string", lambda s: state.visible_stream(s, "answer", "ts", "n", "delta"), "visible")
    assert "".join(r.shown for r in sorted(got, key=lambda r: r.n)) == "Up  down."


def test_state_is_dropped_when_it_says_nothing_any_more(spark, tmp_path):
    """A second file lies far behind the watermark's reach: the first key's state is gone, and its answer the same."""
    src = tmp_path / "src"
    make = lambda rows: spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    make([(1, 1, 100), (2, 1, 101)]).write.mode("append").parquet(str(src))
    for k in range(3):
        make([(10 + k, 2, 100_000 * (k + 1))]).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(src))
        q = state.rate_limited_stream(stream, capacity=1.0, window=60.0, late="10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: False, 10: True, 11: True, 12: True} and (held is None or held <= 1)


def test_streams_joined_in_time(spark, tmp_path):
    make = lambda n, rows: spark.createDataFrame(rows, "user_id long, s long, what string").withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / n))
    make("a", [(1, 100, "x"), (1, 900, "y"), (2, 100, "z")])
    make("b", [(1, 130, "p"), (1, 1_000, "q"), (3, 100, "r")])
    read = lambda n, c: spark.readStream.schema("user_id long, what string, at timestamp").parquet(str(tmp_path / n)).withColumnRenamed("what", c)
    q = windows.joined(read("a", "left_what"), read("b", "right_what"), "user_id", "60 SECONDS").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.user_id, r.left_what, r.right_what) for r in spark.table("pairs").collect()] == [(1, "x", "p")]


def test_retries_and_cache(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, None), ("b", 3, False), ("b", 4, True), ("c", 1, True)], "k string, n int, ok boolean")
    assert {r.k: tuple(r)[1:] for r in state.retried(df, ["k"], "n", "ok").collect()} == {"a": (2, 2.0, True), "b": (3, 6.0, False), "c": (1, 0.0, True)}
    step, s, got = state.cache_step(10.0), None, []
    for x in ((0, "a"), (9, "b"), (10, "c"), (15, "d"), (20, "e")):
        s, r = step(s, x)
        got.append(r)
    assert got == [("a", True), ("a", False), ("c", True), ("c", False), ("e", True)]
