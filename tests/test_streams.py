"""Seen keys over restarts and expired state, and the retry queue's timers."""

import time

import pytest
from pyspark.sql import functions as F

from listinglens.streaming import ingest as I
from listinglens.streaming import retry as Y
from listinglens.streaming import seen as W


def drop(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)  # files are read in order of their times


@pytest.mark.parametrize(("within", "bits"), [("1 day", 1 << 12), ("1 millisecond", 1 << 12), ("1 millisecond", 64)])
def test_keys_come_once_over_restarts(spark, tmp_path, within, bits):
    """With a short time the state forgets, so the table has to know; with 64 bits the filter says maybe to all."""
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k string, v int"
    taken = []
    for run in range(3):
        drop(spark, path, [("a", run), ("b", run), (None, run), (f"new{run}", run), (f"new{run}", run)], schema)
        drop(spark, path, [("a", run), (f"late{run}", run)], schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        seen = W.take_unseen(stream, out, "k", checkpoint, within, bits)
        taken = sorted((str(r.k), r.v) for r in seen.rows().collect())
    expected = {("a", 0), ("b", 0), ("None", 0)} | {(f"{n}{i}", i) for n in ("new", "late") for i in range(3)}
    assert taken == sorted(expected)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    seen = W.SeenTable(spark, str(tmp_path / "s"), "k", 1 << 10)
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    two = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    for batch, number in ((one, 0), (two, 1), (two, 1), (one, 2)):
        seen.take(batch, number)
    assert sorted((r.k, r.v) for r in seen.rows().collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_the_filter_never_misses(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    words = W._words(keys, "k", 1 << 14)
    assert W.may_hold(keys, "k", words, 1 << 14).where("not _may").count() == 0
    others = spark.range(1000, 3000).select(F.col("id").cast("string").alias("k"))
    assert W.may_hold(others, "k", words, 1 << 14).where("_may").count() < 100


def test_failed_keys_come_back_after_their_time_and_done_ones_never(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k string, ok boolean, at long"
    batches = [
        [("a", False, 0), ("b", True, 0), ("c", False, 0), ("d", None, 0)],
        [("tick", True, 30)],  # a waits for 60 seconds
        [("tick", True, 100)],
        [("a", False, 110), ("b", False, 110), ("c", True, 120), ("tick", True, 125)],  # b is done already
        [("tick", True, 150)],  # a waits for 120 seconds now
        [("tick", True, 300)],
        [("a", False, 310), ("tick", True, 900)],  # the third failure is the last
    ]
    for rows in batches:
        drop(spark, path, rows, schema)
        stream = I.file_stream(spark, path, spark.createDataFrame([], schema).schema, 1).withColumn("at", F.timestamp_seconds(F.col("at") + 1000))
        I.append_stream(Y.retry_queue(stream, "k", "ok", "at", most=3, wait=60, late="0 seconds", forget=10_000), out, checkpoint)
    told = {}
    for r in spark.read.parquet(out).where("k <> 'tick'").withColumn("m", F.col("_metadata.file_modification_time")).orderBy("m", "attempts").collect():
        told.setdefault(r.k, []).append((r.attempts, r.state))
    assert sorted(told["a"]) == sorted([(1, "waiting"), (1, "retry"), (2, "waiting"), (2, "retry"), (3, "gave_up")])
    assert set(told["b"]) == {(0, "done")}
    assert sorted(told["c"]) == [(1, "done"), (1, "retry"), (1, "waiting")]
    assert sorted(told["d"]) == [(1, "retry"), (1, "waiting")]
