"""Admission against a plain loop, in batch and on a stream."""

import random

from pyspark.sql import functions as F

import gridlore as g

COLUMNS = "call int, session string, t double, follow boolean"


def calls(seed, n=3000):
    """One very busy session, some quiet ones, gaps longer than the window."""
    rnd = random.Random(seed)
    clock = {"hot": 0.0, "b": 0.0, "c": -5000.0}
    rows = []
    for i in range(n):
        s = rnd.choices(["hot", "b", "c"], [8, 1, 1])[0]
        step = {"hot": rnd.choice([0.0, 0.3, 1.0, 5.0]), "b": rnd.choice([1.0, 50.0, 700.0]), "c": rnd.choice([3.0, 590.0, 600.0, 601.0])}[s]
        if rnd.random() < 0.002:
            step += 4000
        clock[s] += step
        rows.append((i, s, round(clock[s], 3), rnd.random() < 0.2))
    return rows


def by_hand(rows, gap, limit, window):
    admitted, out = {}, {}
    for call, s, t, follow in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        times = [x for x in admitted.get(s, []) if t - x < window]
        ok = not (not follow and times and t - times[-1] < gap) and len(times) < limit
        admitted[s] = times + [t] if ok else times
        out[call] = ok
    return out


def test_batch_equals_a_plain_loop(spark):
    rows = calls(3)
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    got = g.session_admission(df, "session", "t", "follow", tie="call").collect()
    assert {r["call"]: r["allowed"] for r in got} == by_hand(rows, 2.0, 20, 600.0)
    small = g.session_admission(df, "session", "t", min_gap_s=1, max_calls=3, window_s=30, tie="call").collect()
    assert {r["call"]: r["allowed"] for r in small} == by_hand([(*r[:3], False) for r in rows], 1.0, 3, 30.0)


def test_usage_equals_a_plain_count(spark):
    rows = calls(4, 800)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["call"]: r["used"] for r in g.window_usage(df, "session", "t").collect()}
    for call, s, t, _ in rows:
        assert got[call] == sum(1 for _, s2, t2, _ in rows if s2 == s and 0 <= t - t2 < 600), call


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = [r for i, r in enumerate(calls(5, 400))]
    distinct = {(s, t): (c, s, t, f) for c, s, t, f in rows}  # no ties
    rows = list(distinct.values())
    df = spark.createDataFrame(rows, COLUMNS)
    source = str(tmp_path / "in")
    cut = sorted(t for _, _, t, _ in rows)[len(rows) // 2]
    df.filter(F.col("t") <= cut).coalesce(1).write.parquet(source)
    df.filter(F.col("t") > cut).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    decided = g.session_admission_stream(stream, "session", "t", "follow")
    query = (
        decided.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["call"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == by_hand(rows, 2.0, 20, 600.0)


def _replay(spark, tmp_path, batches, schema, **how):
    """Each list of rows as one micro-batch of a stream; the decided rows."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            g.session_admission_stream(stream, "session", "t", "follow", **how).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_event_time_equals_batch_whatever_the_arrival(spark, tmp_path):
    rows = calls(7, 500)
    shuffled = random.Random(1).sample(rows, len(rows))
    batches = [shuffled[k::4] for k in range(4)] + [[(-1, "end", 1e7, False)]]
    got = _replay(spark, tmp_path, batches, COLUMNS, late_s=1e6, tie="call")
    assert {r["call"]: r["allowed"] for r in got} == by_hand(rows, 2.0, 20, 600.0)


def test_event_time_decides_as_the_watermark_moves(spark, tmp_path):
    rows = sorted(calls(8, 400), key=lambda r: r[2])
    # neighbours in time change places, never by more than the allowed lateness
    rng, late = random.Random(2), 500.0
    arrived = sorted(rows, key=lambda r: r[2] + rng.random() * late)
    size = len(arrived) // 5 + 1
    batches = [arrived[k:k + size] for k in range(0, len(arrived), size)] + [[(-1, "end", 1e7, False)]]
    got = _replay(spark, tmp_path, batches, COLUMNS, late_s=late, tie="call")
    assert {r["call"]: r["allowed"] for r in got} == by_hand(rows, 2.0, 20, 600.0)


def test_missing_values_come_back_untouched(spark, tmp_path):
    big = 2 ** 60 + 1
    schema = "call long, session string, t double, follow boolean, note long"
    rows = [(1, None, 0.0, None, big), (2, None, 1.0, True, None), (3, "a", 0.0, None, None), (None, "a", 9.0, False, big)]
    for k, how in enumerate(({}, {"late_s": 5.0, "tie": "call"})):
        folder = tmp_path / str(k)
        got = _replay(spark, folder, [rows, [(9, "end", 1e6, None, 0)], [(10, "end", 2e6, None, 0)]], schema, **how)
        assert sorted([(r["call"], r["note"], r["allowed"]) for r in got if r["t"] < 1e6], key=str) == sorted(
            [(1, big, True), (2, None, True), (3, None, True), (None, big, True)], key=str)
