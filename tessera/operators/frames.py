"""Window features that Spark's SQL lacks, by rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def qualify(df: DataFrame, window_column: Column, condition: Column | str, name: str = "_q") -> DataFrame:
    """Rows where ``condition`` holds on a window expression, called ``name`` inside it; the expression is dropped."""
    return df.withColumn(name, window_column).where(condition).drop(name)


def over_groups(df: DataFrame, aggregate: Column, partition: list[str], order: list[Column], before: int, after: int, out: str) -> DataFrame:
    """``aggregate`` over a GROUPS frame: peers of the ``before`` groups before to the ``after`` groups after.

    The dense rank numbers the groups, and a RANGE frame over it counts them.
    """
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(-before, after)
    return ranked.withColumn(out, aggregate.over(frame)).drop("_group")


def sum_without_current(column: str, frame: WindowSpec) -> Column:
    """A sum over a frame that holds the current row, EXCLUDE CURRENT ROW; null if nothing else is in it."""
    others = F.count(column).over(frame) - F.when(F.col(column).isNull(), 0).otherwise(1)
    return F.when(others > 0, F.sum(column).over(frame) - F.coalesce(F.col(column), F.lit(0)))


def sum_without_peers(column: str, partition: list[str], order: list[Column], keep_current: bool) -> Column:
    """A sum over the whole partition EXCLUDE GROUP, or EXCLUDE TIES if ``keep_current``."""
    whole = F.coalesce(F.sum(column).over(Window.partitionBy(*partition)), F.lit(0))
    peers = F.coalesce(F.sum(column).over(Window.partitionBy(*partition).orderBy(*order).rangeBetween(0, 0)), F.lit(0))
    return whole - peers + (F.coalesce(F.col(column), F.lit(0)) if keep_current else F.lit(0))


def distinct_count(column: str, partition: list[str]) -> Column:
    """count(DISTINCT column) over a whole partition: the highest dense rank, without holding a set."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.asc_nulls_last(column)))
    return F.max(F.when(F.col(column).isNotNull(), rank)).over(Window.partitionBy(*partition))
