"""Exact nearest neighbours of a stated set of query vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors

#: Queries broadcast in one pass over the rows.
BLOCK = 1000


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(query_id, match_id, similarity): the k rows of highest cosine for each query, itself left out.

    Queries meet the rows in blocks of a bounded number, one pass for each
    block; the best k are kept in every partition before the shuffle. Ties go
    to the smaller id; null and zero vectors match nothing.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")

    def part(block: int) -> DataFrame:
        own = F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block))
        scored = rows.join(own, F.col(id_col) != F.col("query_id")).select("query_id", F.col(id_col).alias("match_id"), F.round(vectors.cosine(F.col("_q"), F.col(vector_col)), 9).alias("similarity"))
        return scored.where("similarity is not null").withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")

    return reduce(DataFrame.unionByName, map(part, range(blocks)))
