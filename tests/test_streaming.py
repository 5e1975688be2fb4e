"""Streams over files that arrive one after the other."""

import datetime as dt

from pyspark.sql import functions as F

from postfunnel.streaming import ingest, throttle

MINUTE = 60_000_000
START = dt.datetime(2026, 9, 1)


def test_throttle_step():
    step = throttle.step
    assert step(0, 0, 5, True, 10, 2) == ("failed", 1, 5)
    assert step(1, 5, 15, True, 10, 2) == ("failed", 2, 5)  # the window's last moment still counts
    assert step(2, 5, 15, False, 10, 2) == ("throttled", 2, 5)  # not even a success is looked at
    assert step(2, 5, 16, True, 10, 2) == ("failed", 1, 16)  # lapsed: starts again at one
    assert step(2, 5, 16, False, 10, 2) == ("ok", 0, 0)
    assert step(1, 5, 6, False, 10, 2) == ("ok", 0, 0)


def write(spark, path, rows, part):
    frame = spark.createDataFrame(rows, "key string, attempt_no long, ts timestamp, failed boolean")
    frame.coalesce(1).write.mode("append").parquet(f"{path}/part={part}")


def test_throttle_state_lives_across_batches(spark, tmp_path):
    def row(n, minute, failed, key="k"):
        return (key, n, START + dt.timedelta(minutes=minute), failed)

    path = str(tmp_path / "in")
    write(spark, path, [row(2, 1, True), row(1, 0, True), row(9, 0, False, "other")], 1)
    schema = spark.read.parquet(path).schema

    def run():
        attempts = ingest.file_stream(spark, path, schema, 1).withColumn("at", F.unix_micros("ts")).drop("part")
        out = throttle.throttle(attempts.withWatermark("ts", "1 hour"), 15, 3)
        ingest.append_available(out, str(tmp_path / "out"), str(tmp_path / "check"))

    run()
    write(spark, path, [row(3, 2, True), row(4, 14, False), row(5, 16, False), row(6, 17, True)], 2)
    run()
    run()  # nothing new: nothing is counted twice
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("attempt_no").collect()
    assert [(r.attempt_no, r.outcome, r.fails) for r in found] == [
        (1, "failed", 1), (2, "failed", 2), (3, "failed", 3), (4, "throttled", 3), (5, "ok", 0), (6, "failed", 1), (9, "ok", 0)]


def test_repeats_and_counters(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", 1, START, True), ("a", 1, START, True), ("b", 2, START + dt.timedelta(days=1), False)]
    write(spark, path, rows, 1)
    stream = ingest.file_stream(spark, path)
    once = ingest.without_repeats(stream, "attempt_no", "ts", "5 days")
    ingest.append_available(once.drop("part"), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2

    from postfunnel.operators.store import VersionedTable

    table = VersionedTable(spark, str(tmp_path / "counters"), key="stage")

    def count():
        counted = ingest.stage_counters(ingest.file_stream(spark, path), "ts", "key", "5 days")
        return ingest.upsert_available(counted, table, str(tmp_path / "c2"), ingest.replace_counters, "update")

    assert sorted((r.stage, r.n) for r in count().collect()) == [("a", 2), ("b", 1)]
    write(spark, path, [("a", 3, START, True)], 2)
    assert sorted((r.stage, r.n) for r in count().collect()) == [("a", 3), ("b", 1)]


def test_throttle_does_not_depend_on_the_order_of_files(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(f"k{r.randrange(3)}", n, START + dt.timedelta(minutes=r.randrange(60)), r.random() < 0.7) for n in range(60)]
    want, state = [], {}
    for key, n, when, failed in sorted(rows, key=lambda x: (x[2], x[1])):
        at = int((when - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        outcome, *state[key] = throttle.step(*state.get(key, (0, 0)), at, failed, 15 * MINUTE, 3)
        want.append((key, n, outcome, state[key][0]))
    for cut in (1, 5):
        r.shuffle(rows)
        path = str(tmp_path / f"in{cut}")
        for n in range(cut):
            write(spark, path, rows[n::cut], n)
        attempts = ingest.file_stream(spark, path, files_per_batch=1).withColumn("at", F.unix_micros("ts")).drop("part")
        out = throttle.throttle(attempts.withWatermark("ts", "2 hours"), 15, 3)
        ingest.append_available(out, str(tmp_path / f"out{cut}"), str(tmp_path / f"check{cut}"))
        found = throttle.last_told(spark.read.parquet(str(tmp_path / f"out{cut}"))).select("key", "attempt_no", "outcome", "fails")
        assert sorted(map(tuple, found.collect())) == sorted(want)
