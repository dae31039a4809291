"""Tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.base import Registry
from tessera.sources import formats, series
from tessera.sources.scratch import Scratch
from tessera.sources.tables import table

registry = Registry()
query = registry.query


def _back(spark: SparkSession, df: DataFrame, kind: str, partition_by: list[str] | None = None) -> DataFrame:
    path = Scratch(spark, "formats").path(kind)
    formats.write(df, kind, path, partition_by)
    return formats.read(spark, kind, path, df.schema)


@query("SELECT doc_id, text, lang FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "csv")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, table(spark, sf_dir, "events"), "json")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def orc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, table(spark, sf_dir, "orders"), "orc")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, table(spark, sf_dir, "nation"), "xml")


@query("SELECT n_name AS value FROM nation")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "text")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by priority; the filter reads one folder of the five."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return _back(spark, orders, "parquet", ["o_orderpriority"]).where("o_orderpriority = '1-URGENT'")


@query("SELECT range AS n, range * range AS square FROM range(5, 2000, 3)")
def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(series.Series)
    return spark.read.format("series").options(start=5, end=2000, step=3).load()
