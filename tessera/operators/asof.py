"""As-of joins: each left row with the latest right row at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], columns: list[str], tolerance: str | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its time, per ``by``.

    One union and one window: a shuffle on ``by`` and a sort by time instead of
    a join on a range. Of right rows with equal keys and times the one with the
    greatest column values counts. ``tolerance`` is an interval literal such as
    ``INTERVAL 1 HOUR``; older matches are null. Null times and keys on the
    right match nothing; left rows with them stay, without a match.
    """
    found = F.struct(F.col(right_time).alias("t"), *[F.col(c) for c in columns])
    known = right.where(F.col(right_time).isNotNull()).groupBy(*by, right_time).agg(F.max(found).alias("_match"))
    events = left.select(F.struct(*left.columns).alias("_left"), *[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], F.col(left_time).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(known.schema["_match"].dataType).alias("_match"))
    marks = known.select(F.lit(None).cast(events.schema["_left"].dataType).alias("_left"), *[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], F.col(right_time).alias("_at"), F.lit(0).alias("_kind"), "_match")
    order = Window.partitionBy(*[f"_by{k}" for k in range(len(by))]).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = events.unionByName(marks).withColumn("_last", F.last("_match", ignorenulls=True).over(order)).where("_kind = 1")
    usable = F.col("_at").isNotNull()
    for k in range(len(by)):
        usable &= F.col(f"_by{k}").isNotNull()
    if tolerance is not None:
        usable &= F.col("_last.t") >= F.col("_at") - F.expr(tolerance)
    return both.select("_left.*", *[F.when(usable, F.col(f"_last.{c}")).alias(c) for c in columns])
