"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import frames
from tessera.operators.running import rows_within
from tessera.plans.base import Registry, cents
from tessera.sources.tables import table

registry = Registry()
query = registry.query

_RANKS = "OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)"


@query(f"""
    SELECT o_orderkey, CAST(row_number() {_RANKS} AS INTEGER) AS rn, CAST(ntile(7) {_RANKS} AS INTEGER) AS tile, round(percent_rank() {_RANKS}, 9) AS pr, round(cume_dist() {_RANKS}, 9) AS cd,
      CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS dr FROM orders""")
def ranking_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")
    p = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.ntile(7).over(w).alias("tile"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr")
    )


_TIME = "OVER (PARTITION BY user_id ORDER BY ts)"


@query(f"""
    SELECT event_id, lag(event_type) {_TIME} AS before, lead(value, 2, -1.0) {_TIME} AS after2, first_value(event_type) {_TIME} AS first_type,
      nth_value(event_id, 3) {_TIME} AS third, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events""")
def offset_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after2"), F.first("event_type").over(w).alias("first_type"), F.nth_value("event_id", 3).over(w).alias("third"), F.last("event_id").over(whole).alias("last_id")
    )


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    moving = F.sum(F.col("value").cast("decimal(18,6)")).over(w.rowsBetween(-4, 0)).cast("double")
    return table(spark, sf_dir, "events").select("event_id", moving.alias("moving"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events")
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as differences of running counts, so no frame is read for each row."""
    return rows_within(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "interval 1 day", "last_day").select("event_id", "last_day")


@query("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM orders")
def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return frames.over_groups(orders, F.sum("o_orderkey"), ["o_orderstatus"], [F.col("o_orderpriority")], 1, 0, "near").select("o_orderkey", "near")


@query("""
    SELECT c_custkey, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS DOUBLE) AS others,
      CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(12,2))) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP), 0) AS DOUBLE) AS no_group,
      CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(12,2))) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES), 0) AS DOUBLE) AS no_ties FROM customer""")
def frame_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("bal", cents("c_acctbal"))
    near = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(-2, 2)
    by = ["c_nationkey"], [F.col("c_mktsegment")]
    return customers.select(
        "c_custkey", frames.sum_without_current("bal", near).cast("double").alias("others"), frames.sum_without_peers("bal", *by, keep_current=False).cast("double").alias("no_group"), frames.sum_without_peers("bal", *by, keep_current=True).cast("double").alias("no_ties")
    )


@query("SELECT c_custkey, count(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS segments FROM customer")
def distinct_over_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", frames.distinct_count("c_mktsegment", ["c_nationkey"]).cast("long").alias("segments"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return frames.qualify(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), F.row_number().over(w), "_q <= 3")


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def last_ignoring_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(bought, ignorenulls=True).over(w).alias("last_purchase"))


@query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS begin_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours")
    numbered = events.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "k").agg(F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("k")
