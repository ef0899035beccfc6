"""Mapping changes as a stream against the same at once, over restarts; the commit log with writers side by side."""

import os
import random
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pagewright.sources.store import CommitLog, Conflict
from pagewright.streaming.mapping import Book, batched_log, mapping_stream
from pyspark.sql import functions as F

OPS = "book long, seq long, at timestamp, expected long, kind string, chapter long, track long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def changes(n, seed):
    rng, out, number = random.Random(seed), [], {}
    at = 0
    for seq in range(n):
        at += rng.choice([0, 50, 200, 400, 700, 5000])
        book = rng.randrange(3)
        expected = number.get(book, 0) + rng.choice([1, 1, 1, 1, 2])
        number[book] = number.get(book, 0) + 1 if rng.random() < 0.7 else number.get(book, 0)
        out.append((book, seq, START + timedelta(milliseconds=at), expected, rng.choice(["park", "unpark", "reassign", "swap", None]), rng.randrange(5), rng.choice([0, 1, 2, 3, None])))
    return out


def test_batches_end_at_the_first_failure(spark):
    ms = lambda n: START + timedelta(milliseconds=n)
    rows = [(1, 1, ms(0), 1, "park", 0, None), (1, 2, ms(100), 9, "park", 1, None), (1, 3, ms(200), 2, "park", 1, None), (1, 4, ms(800), 2, "park", 2, None), (1, 5, ms(1200), 3, "unpark", 0, 2), (1, 6, ms(1299), 4, "park", 1, None), (1, 7, ms(1300), 5, "x", 1, None), (1, 8, None, 5, "park", 1, None)]
    got = batched_log(spark.createDataFrame(rows, OPS), 4, timedelta(milliseconds=500), timedelta(milliseconds=500)).orderBy("seq").collect()
    assert [(r.seq, r.error) for r in got] == [(1, None), (2, "stale"), (3, "not tried"), (4, None), (5, None), (6, None), (7, "unknown operation")]
    assert len({r.batch for r in got[3:6]}) == 1 and got[6].batch != got[5].batch and got[5].mapping == "0:2,1:,2:,3:3"


def test_book_opens_by_pause_and_by_wait():
    book = Book(2, 500, 800)
    assert [book.apply(at, 0, 0, None, 0, 0)["batch"] for at in (0, 400, 799, 800, 1300, 1800)] == [0, 0, 0, 800, 1300, 1800]


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ops = changes(60, 4)
    times = max(o[2] for o in ops) + timedelta(hours=1)
    shuffled = random.Random(1).sample(ops, len(ops))
    parts = [shuffled[i::4] for i in range(4)] + [[(9, 1000 + i, times + timedelta(hours=i), 1, "park", 0, None)] for i in range(2)]
    source = tmp_path / "in"
    source.mkdir()

    def give(i):
        spark.createDataFrame(parts[i], OPS).coalesce(1).write.parquet(f"file://{tmp_path}/part{i}")
        (name,) = [f for f in os.listdir(tmp_path / f"part{i}") if f.endswith(".parquet")]
        os.rename(tmp_path / f"part{i}" / name, source / f"{i}.parquet")

    def run():
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        answers = mapping_stream(stream, 4, timedelta(milliseconds=500), timedelta(milliseconds=900), late="1 hour")
        query = answers.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(150)
        assert query.exception() is None and not query.isActive

    try:
        give(0), give(1), run()
        for i in range(2, 6):
            give(i)
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("book < 9").collect())
    want = sorted(tuple(r) for r in batched_log(spark.createDataFrame(ops, OPS), 4, timedelta(milliseconds=500), timedelta(milliseconds=900)).collect())
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert len(want) == 60 and sorted(got, key=key) == sorted(want, key=key)
    assert {r[5] for r in want} >= {None, "stale", "not tried"}


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "k string, v int")


def held(df):
    return {r.k: r.v for r in df.collect()}


def test_commits_versions_and_guards(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", "k")
    assert log.version() == 0 and log.read() is None
    assert log.upsert(rows(spark, ("a", 1), ("b", 1))) == 1 and log.upsert(rows(spark, ("b", 2), ("c", 2))) == 2
    assert held(log.read()) == {"a": 1, "b": 2, "c": 2} and held(log.read(1)) == {"a": 1, "b": 1}
    assert log.update(rows(spark, ("a", 3)), read_at=1) == 3  # a is as it was
    with pytest.raises(Conflict, match="b"):
        log.update(rows(spark, ("b", 4)), read_at=1)
    assert log.remove(rows(spark, ("c", 0))) == 4 and held(log.read()) == {"a": 3, "b": 2}
    assert log.upsert(spark.createDataFrame([("d", 5, "new")], "k string, v int, w string")) == 5
    assert log.compact() == 6 and len(log.folders(6)) == 1 and held(log.read()) == {"a": 3, "b": 2, "d": 5} and held(log.read(3)) == {"a": 3, "b": 2, "c": 2}
    assert log.upsert(rows(spark, (None, 1), ("a", 9))) == 7 and held(log.read()) == {"a": 9, "b": 2, "d": 5, None: 1}


def test_a_killed_writer_leaves_the_last_version(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", "k")
    log.upsert(rows(spark, ("a", 1)))
    log._written(rows(spark, ("a", 2)))  # dies before its manifest
    (tmp_path / "log" / "log" / "00000000000000000002.json.half").write_text("{")
    assert log.version() == 1 and held(log.read()) == {"a": 1} and log.upsert(rows(spark, ("a", 3))) == 2


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    path, failed = f"file://{tmp_path}/log", []

    def write(w):
        try:
            for i in range(4):
                CommitLog(spark, path, "k").upsert(rows(spark, (f"{w}-{i}", i), ("shared", w)))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    log = CommitLog(spark, path, "k")
    assert not failed and log.version() == 12 and len(held(log.read())) == 13
    assert [c for c, _ in log.folders(12)] == list(range(1, 13))


def test_guarded_counters_side_by_side(spark, tmp_path):
    """Each adds one to what it has read; refused ones try again."""
    path = f"file://{tmp_path}/log"
    CommitLog(spark, path, "k").upsert(rows(spark, ("n", 0)))

    def add():
        log, left = CommitLog(spark, path, "k"), 3
        while left:
            at = log.version()
            try:
                log.update(log.read(at).withColumn("v", F.col("v") + 1), at)
                left -= 1
            except Conflict:
                pass

    threads = [threading.Thread(target=add) for _ in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert held(CommitLog(spark, path, "k").read()) == {"n": 6}


def test_manifests_by_renaming(spark, tmp_path):
    """The way that other file systems than the local one take."""
    log = CommitLog(spark, f"file://{tmp_path}/log", "k")
    assert log._renamed('{"folders": []}', log._manifest(1)) and not log._renamed("{", log._manifest(1))
    assert log.version() == 1 and log.folders(1) == [] and log.read() is None
    assert sorted(n for n in os.listdir(tmp_path / "log" / "log") if not n.startswith(".")) == ["00000000000000000001.json"]
