"""Structured Streaming: the events, streamed in order of time in four files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.base import Registry
from tessera.sources.scratch import Scratch
from tessera.sources.tables import table
from tessera.streaming import run, state

registry = Registry()
query = registry.query


def _stream(spark: SparkSession, sf_dir: str, scratch: Scratch, delay: str | None = "1 hour", kinds: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return run.events(spark, run.in_parts(rows.where(kinds), scratch, "event_id", 4), rows.schema, delay)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    counts = _stream(spark, sf_dir, scratch).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run.finish(counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n"), scratch, "complete")


@query("SELECT hour, n FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are written once the watermark has passed their end; the last stay open."""
    scratch = Scratch(spark, "stream")
    counts = _stream(spark, sf_dir, scratch).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run.finish(counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n"), scratch)


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS begin_ts, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    counts = _stream(spark, sf_dir, scratch).groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return run.finish(counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begin_ts"), "n"), scratch)


@query("SELECT event_id, user_id FROM events")
def stream_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice; the second is dropped while the watermark remembers the first."""
    scratch = Scratch(spark, "stream")
    twice = _stream(spark, sf_dir, scratch).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    return run.finish(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), scratch)


@query("""
    SELECT p.event_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 30 MINUTE
    WHERE p.event_type = 'purchase' AND e.event_type = 'error'""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    buys = _stream(spark, sf_dir, scratch, kinds="event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = _stream(spark, sf_dir, scratch, kinds="event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("error_user"), F.col("ts").alias("error_ts"))
    near = (F.col("user_id") == F.col("error_user")) & (F.col("error_ts") >= F.col("ts")) & (F.col("error_ts") <= F.col("ts") + F.expr("interval 30 minutes"))
    return run.finish(buys.join(errors, near).select("event_id", "error_id"), scratch)


@query("SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'signup'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    signups = _stream(spark, sf_dir, scratch, None, "event_type = 'signup'")
    return run.finish(signups.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"), scratch)


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that a Python function keeps for each user; the last of each user's updates."""
    scratch = Scratch(spark, "stream")
    updates = run.finish(state.running_totals(_stream(spark, sf_dir, scratch, None)), scratch, "update")
    last = updates.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each of the few types, into the driver's memory."""
    scratch = Scratch(spark, "stream")
    counts = _stream(spark, sf_dir, scratch, None).groupBy("event_type").agg(F.count("*").alias("n"))
    return run.in_memory(counts, scratch, "tessera_stream_counts")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    t AS (SELECT user_id, k, min(ts) AS begin_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, begin_ts, n FROM t QUALIFY lead(k) OVER (PARTITION BY user_id ORDER BY k) IS NOT NULL OR last_ts + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a stateful processor closes at the next row beyond the gap or when its timer fires."""
    scratch = Scratch(spark, "stream")
    rows = _stream(spark, sf_dir, scratch).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    with state.rocksdb(spark):
        closed = rows.groupBy("user_id").transformWithStateInPandas(state.Sessions(7_200_000_000), "user_id long, begin long, n long", "append", "eventTime")
        done = run.finish(closed, scratch)
    return done.select("user_id", F.timestamp_micros("begin").cast("timestamp_ntz").alias("begin_ts"), "n")
