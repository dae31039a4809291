"""Running sums over large groups without a task that holds a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column | str, out: str, rows: int) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each, within its group, as ``out``.

    Rows stand in the order of a hash of ``order`` and then of ``order``
    itself: a fixed order that needs no global sort. Each group falls into
    buckets by that hash; sums of buckets give every bucket's base, and a
    window inside the bucket the rest. ``rows`` is the table's row count; there are
    as many buckets as its square root, so neither step sorts more rows.
    Null groups are a group of their own. Nulls of ``value`` count as 0.
    """
    buckets = max(1, math.isqrt(rows))
    value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("long")
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_value", value)
    sums = dealt.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_bucket") == F.col("_b")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return ranked.join(bases, same).withColumn(out, F.col("_base") + F.col("_inside")).select(*df.columns, out)


def rows_above(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the number of rows whose ``column`` is greater, as ``out``; 0 for nulls.

    What a self-join on ``<`` would count, from counts of distinct values: those
    are range-partitioned, each partition's total is summed once, and windows
    stay inside partitions.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    parts = counts.repartitionByRange(F.desc("_v")).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = parts.groupBy("_p").agg(F.sum("_n").alias("_t"))  # a row for each partition
    before = totals.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    ranked = parts.join(before, F.col("_p") == F.col("_q")).select("_v", (F.col("_in") + F.col("_b")).alias("_above"))
    return df.join(ranked, F.col(column) == F.col("_v"), "left").withColumn(out, F.coalesce("_above", F.lit(0)).cast("long")).select(*df.columns, out)


def rows_within(df: DataFrame, group: str, at: str, back: str, out: str) -> DataFrame:
    """``df`` with count(*) OVER (PARTITION BY group ORDER BY at RANGE BETWEEN back PRECEDING AND CURRENT ROW), as ``out``.

    Spark reads a row's whole frame again for each row, in one task a group.
    Here a row comes in at its time and is gone after its time and ``back``, an
    interval literal of days or shorter units: distinct times with both counts
    are range-partitioned, partitions' totals give every time its base, and the
    rest is a running sum. Nulls of ``at`` are peers of each other; null groups
    are a group. A fixed number of partitions is never coalesced, so both reads
    number them alike. The joins are left ones: where ``out`` is not read, Spark
    drops different columns of totals and times, partitions them apart, and an
    inner join would lose rows.
    """
    here, later = F.struct(F.col(at).alias("_at"), F.lit(1).alias("_n"), F.lit(0).alias("_gone")), F.struct((F.col(at) + F.expr(back)).alias("_at"), F.lit(0).alias("_n"), F.lit(1).alias("_gone"))
    marks = df.select(F.col(group).alias("_g"), F.explode(F.array(here, later)).alias("m")).select("_g", "m.*")
    places = marks.groupBy("_g", "_at").agg(F.sum("_n").alias("_n"), F.sum("_gone").alias("_gone"))
    parts = places.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_g", "_at").withColumn("_p", F.spark_partition_id())
    totals = parts.groupBy("_p", "_g").agg(F.sum(F.col("_n") - F.col("_gone")).alias("_t"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_p").alias("_q"), F.col("_g").alias("_h"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p", "_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_in", F.sum(F.col("_n") - F.col("_gone")).over(inside)).join(bases, (F.col("_p") == F.col("_q")) & F.col("_g").eqNullSafe(F.col("_h")), "left")
    counts = placed.where("_n > 0").select("_g", "_at", (F.col("_b") + F.col("_in") + F.col("_gone")).alias("_over"))
    return df.join(counts, F.col(group).eqNullSafe(F.col("_g")) & F.col(at).eqNullSafe(F.col("_at")), "left").withColumn(out, F.col("_over").cast("long")).select(*df.columns, out)


def exact_percentiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """(group, one column for each entry of ``at``): percentiles of ``value``, interpolated between neighbours, without a task that holds a group.

    Counts of distinct values are range-partitioned, partitions' totals give
    every value its place among its group's, and the values at the places asked
    for are picked out by an aggregate. Null values don't count; groups without
    values are missing; null groups are a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    parts = counts.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id())
    totals = parts.groupBy("_p", "_g").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_p").alias("_q"), F.col("_g").alias("_h"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"), F.sum("_t").over(Window.partitionBy("_g")).alias("_all"))
    inside = Window.partitionBy("_p", "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_in", F.sum("_n").over(inside)).join(bases, (F.col("_p") == F.col("_q")) & F.col("_g").eqNullSafe(F.col("_h")))
    end = F.col("_b") + F.col("_in")
    here = lambda place: F.max(F.when((place >= end - F.col("_n")) & (place < end), F.col("_v")))
    wanted = {k: F.lit(p) * (F.col("_all") - 1) for k, p in at.items()}
    picked = placed.groupBy("_g").agg(F.max("_all").alias("_all"), *(here(f(w)).alias(f"{k}_{n}") for k, w in wanted.items() for n, f in (("lo", F.floor), ("hi", F.ceil))))
    between = {k: F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (w - F.floor(w)) for k, w in wanted.items()}
    return picked.select(F.col("_g").alias(group), *(c.alias(k) for k, c in between.items()))
