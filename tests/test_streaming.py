"""Late rows, duplicates and state on inline batches."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch
from tessera.streaming import run

SCHEMA = "event_id long, ts timestamp_ntz"


def batches(spark, scratch, parts):
    """A folder with one file per batch, streamed in order of their time."""
    path = scratch.path("in")
    for k, rows in enumerate(parts):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h)) for i, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        run.in_order(scratch, path, k)
    return run.events(spark, path, spark.createDataFrame([], SCHEMA).schema, "1 hour")


def hours(stream, scratch):
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.dayofyear("w.start").alias("d"), F.hour("w.start").alias("h"), "n")
    return sorted(tuple(r) for r in run.finish(counts, scratch).collect())


def test_append_streams_give_the_same_rows_every_time(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, start + dt.timedelta(minutes=7 * k)) for k in range(2000)], SCHEMA).repartition(7)
    found = []
    for _ in range(10):
        scratch = Scratch(spark, "test")
        path = run.in_parts(df, scratch, "event_id", 4)
        found.append(hours(run.events(spark, path, df.schema), scratch))
    last = start + dt.timedelta(minutes=7 * 1999)
    assert sum(n for *_, n in found[0]) == sum(1 for k in range(2000) if (start + dt.timedelta(minutes=7 * k)).replace(minute=0) + dt.timedelta(hours=1) <= last - dt.timedelta(hours=1))
    assert all(f == found[0] for f in found)


def test_files_out_of_order_lose_rows_and_parts_do_not(spark):
    """What the order of files is for: the same files in the wrong order make late rows."""
    scratch = Scratch(spark, "test")
    parts = [[(k, 2 * p) for k in range(5)] for p in range(6)]
    right, wrong = hours(batches(spark, scratch, parts), scratch), hours(batches(spark, scratch, parts[::-1]), Scratch(spark, "test"))
    assert [n for *_, n in right] == [5] * 5
    assert sum(n for *_, n in wrong) < 25


def test_empty_parts(spark):
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([], SCHEMA)
    assert hours(run.events(spark, run.in_parts(df, scratch, "event_id", 4), df.schema), scratch) == []


def test_rows_behind_the_watermark_are_dropped(spark):
    scratch = Scratch(spark, "test")
    # the watermark of 9 h filters from the batch after the one that closes windows by it
    stream = batches(spark, scratch, [[(1, 1)], [(2, 10)], [(7, 10)], [(3, 1), (4, 10)], [(5, 20)], [(6, 21)]])
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.hour("w.start").alias("h"), "n")
    assert sorted(tuple(r) for r in run.finish(counts, scratch).collect()) == [(1, 1), (10, 3)]


def test_duplicates_within_the_watermark(spark):
    scratch = Scratch(spark, "test")
    stream = batches(spark, scratch, [[(1, 1), (1, 1)], [(1, 2), (2, 2)]])
    out = run.finish(stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), scratch)
    assert sorted(r[0] for r in out.collect()) == [1, 2]
