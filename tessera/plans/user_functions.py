"""User-defined functions of every kind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.base import Registry
from tessera.sources.tables import table

registry = Registry()
query = registry.query


@query("SELECT p_partkey, upper(p_brand) || '/' || CAST(p_size AS VARCHAR) AS tag FROM part")
def scalar_python_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.udf(lambda brand, size: None if brand is None or size is None else f"{brand.upper()}/{size}", "string")
    return table(spark, sf_dir, "part").select("p_partkey", tag("p_brand", "p_size").alias("tag"))


@query("SELECT o_orderkey, o_totalprice * 1.25 AS gross FROM orders")
def vectorised_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def gross(net: pd.Series) -> pd.Series:
        return net * 1.25

    return table(spark, sf_dir, "orders").select("o_orderkey", gross("o_totalprice").alias("gross"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("long")
    def n_bytes(text: pa.Array) -> pa.Array:
        return pc.binary_length(text).cast(pa.int64())

    return table(spark, sf_dir, "documents").select("doc_id", n_bytes("text").alias("n_bytes"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    # Python and built-in aggregates don't mix in one call: each has its own, joined by key
    events = table(spark, sf_dir, "events")
    built_in = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return built_in.join(events.groupBy("event_type").agg(F.round(spread("value"), 6).alias("spread")), "event_type")


@query("SELECT n_nationkey, unnest(range(1, n_regionkey + 1)) AS k FROM nation")
def table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="k long")
    class UpTo:
        def eval(self, n: int):
            for k in range(1, n + 1):
                yield (k,)

    spark.udtf.register("tessera_up_to", UpTo)
    table(spark, sf_dir, "nation").createOrReplaceTempView("_udtf_nation")
    return spark.sql("SELECT n_nationkey, k FROM _udtf_nation, LATERAL tessera_up_to(n_regionkey)")


@query("SELECT n_nationkey, n_nationkey * n_nationkey AS square FROM nation")
def arrow_table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over a whole table, whose rows come and go as Arrow batches."""

    @F.arrow_udtf(returnType="n_nationkey int, square int")
    class Squares:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            k = rows.column("n_nationkey")
            yield pa.table({"n_nationkey": k, "square": pc.multiply(k, k)})

    spark.udtf.register("tessera_squares", Squares)
    table(spark, sf_dir, "nation").select("n_nationkey").createOrReplaceTempView("_arrow_udtf_nation")
    return spark.sql("SELECT * FROM tessera_squares(TABLE(_arrow_udtf_nation))")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity > 48")
def partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def doubled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(doubled=f.pop("l_quantity") * 2)

    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.mapInPandas(doubled, "l_orderkey long, l_linenumber int, l_partkey long, doubled double")


@query("SELECT user_id, event_id, value - min(value) OVER (PARTITION BY user_id) AS above FROM events")
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def above_least(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": f["user_id"], "event_id": f["event_id"], "above": f["value"] - f["value"].min()})

    return table(spark, sf_dir, "events").groupBy("user_id").applyInPandas(above_least, "user_id long, event_id long, above double")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [int(a["n"].sum())], "suppliers": [int(b["n"].sum())]})

    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "k int, customers long, suppliers long")
