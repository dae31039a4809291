"""NOT IN with its nulls, as an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, value: Column, members: DataFrame, member: Column) -> DataFrame:
    """Rows of ``df`` where ``value`` NOT IN (``member`` of ``members``) is true.

    Spark's own plan broadcasts every member, repeats included. Here distinct
    members are shuffled and anti-joined; one row tells whether there are any
    and whether one is null. No members keep all rows, nulls too; a null member
    keeps none; else null values go.
    """
    keys = members.select(member.alias("_member")).distinct()
    state = keys.agg(F.count("*").alias("_all"), F.count("_member").alias("_known"))
    marked = df.withColumn("_value", value)
    others = marked.join(keys.where("_member is not null"), F.col("_value") == F.col("_member"), "left_anti")
    return others.crossJoin(F.broadcast(state)).where("_all = 0 or (_all = _known and _value is not null)").select(*df.columns)
