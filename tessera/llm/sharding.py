"""Sharding by vector bin packing: bytes, words and rows are balanced jointly.

Equal texts are a group and stay together unless the group is larger than a
shard. Each group is placed where the dot product with the residual capacity is
highest: first the large ones, on the driver, whose number is bounded; then all
small ones, by executors, in cells that each hold the same part of every
shard's capacity; at last a bounded number of small ones that the driver kept
back, which even out what the cells left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.mixing import word_count
from tessera.llm.names import fresh
from tessera.operators.running import running_sum
from tessera.sources.scratch import Scratch

#: A group above this part of a shard in any dimension is large: at most shards
#: * ALONE * 3 such groups exist.
ALONE = 1024
#: So many small groups, those with the least hashes, are placed last.
LATE = 4096
#: Small groups in a cell, on average.
CELL = 16_384
#: A group above a whole shard is split into pieces of this part of one.
SPLIT = 8
DIMENSIONS = ("bytes", "words", "rows")


def place(share: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each item, largest first, and less of ``left``, which has the residual capacity of each shard.

    Rows of both are bytes, words and rows. Of the shards that an item still
    fits into, it goes where the dot product with the residual capacity is
    highest; if it fits nowhere, where it overruns least. Items of equal size
    are placed in the order given.
    """
    order = np.lexsort((np.arange(len(share)), -share.sum(axis=1), -share.max(axis=1, initial=0)))
    out = np.zeros(len(share), np.int64)
    for k in order:
        own = share[k]
        fits = (left >= own - 1e-12).all(axis=1)
        score = np.where(fits, left @ own, -np.inf) if fits.any() else (left - own).min(axis=1)
        out[k] = at = int(score.argmax())
        left[at] -= own
    return out


def _place_cells(left: np.ndarray, room: list[float]):
    """What places the groups of one cell; it has as much of every shard's capacity as it has of the groups.

    Cells look at the shards in orders of their own: of equal ones they take the
    first, and the same in every cell would fill.
    """

    def step(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["h", "crc"])
        share = cell[list(DIMENSIONS)].to_numpy(np.float64) / room
        order = np.random.default_rng(int(key[0])).permutation(len(left))
        free = np.maximum(left, 0)[order]
        own = free * (share.sum(axis=0) / np.maximum(free.sum(axis=0), 1e-300))
        return cell[["h", "crc", *DIMENSIONS]].assign(shard=order[place(share, own)].astype(np.int32))

    return step


def even(share: np.ndarray, out: np.ndarray, left: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Moves or swaps items between the fullest and the emptiest shard by bytes while that lowers the spread.

    Bytes weigh ten times as much as the other dimensions.
    """
    weight = np.array([10.0, 1.0, 1.0])
    members = [list(np.flatnonzero(out == s)) for s in range(len(left))]
    for _ in range(rounds):
        gain = 0.0
        cost = (weight * left**2).sum(axis=1)
        lo, hi = int(left[:, 0].argmin()), int(left[:, 0].argmax())
        for a, b in ((lo, hi), (int(cost.argmax()), hi), (lo, int(cost.argmax()))):
            if a == b or not members[a]:
                continue
            own, other = np.array(members[a]), np.array([*members[b], -1])
            own = own[:: max(1, len(own) // 256)]
            other = np.append(other[:-1][:: max(1, len(other) // 256)], -1)
            give = share[own][:, None, :] - np.where(other[:, None] < 0, 0, share[other])[None, :, :]
            after = (weight * (left[a] + give) ** 2).sum(axis=2) + (weight * (left[b] - give) ** 2).sum(axis=2)
            i, j = np.unravel_index(int(after.argmin()), after.shape)
            gain = cost[a] + cost[b] - after[i, j]
            if gain > 1e-12:
                break
        if gain <= 1e-12:
            break
        left[a] += give[i, j]
        left[b] -= give[i, j]
        x, y = own[i], other[j]
        out[x] = b
        members[a].remove(x)
        members[b].append(x)
        if y >= 0:
            out[y] = a
            members[b].remove(y)
            members[a].append(y)
    return out


def _halves(items: list) -> tuple[list, list]:
    """Items that come first and those kept back, each in the order of their hash."""
    return sorted(r for r in items if not r["late"]), sorted(r for r in items if r["late"])


def assign_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row: sizes of shards are near equal.

    size is the text's UTF-8 bytes plus 8; slot counts a shard's rows from 0
    without gaps. The law is ``bytes``; grown_shard, which belongs to laws that
    keep places when a shard is added, is null.

    Null texts: no bytes, in one group with empty ones. Null ids and repeated
    rows: rows like any other. Ties: items of equal size in order of their
    hash. Other columns are ignored. Fewer groups than shards: some shards are
    empty. Empty table: no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select(
        "id", (F.octet_length("text") + 8).cast("long").alias("bytes"), word_count(F.col("text")).alias("words"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.xxhash64("text").alias("h")
    )
    meta = scratch.cut(rows, "rows")
    sums = [F.sum(d).alias(d) for d in DIMENSIONS]
    groups = scratch.cut(meta.withColumn("rows", F.lit(1)).groupBy("h", "crc").agg(*sums), "groups")
    total = groups.agg(*sums).first()
    room = [max(1.0, (total[d] or 0) / shards) for d in DIMENSIONS]
    most = F.greatest(*(F.col(d) / r for d, r in zip(DIMENSIONS, room, strict=True)))
    key, large = F.struct("h", "crc"), most > 1 / ALONE
    last = groups.where(~large).select(key.alias("k")).orderBy("k").limit(LATE).agg(F.max("k").alias("k")).first()["k"]
    late = F.lit(False) if last is None else ~large & (key <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["crc"]).alias("crc")))
    pieces = F.when(most > 1, F.ceil(most * SPLIT)).otherwise(1).cast("int")
    alone = groups.where(large | late).select("h", "crc", pieces.alias("pieces"), late.alias("late"))  # shards * ALONE * 3 + LATE rows at most
    item = F.when(F.col("pieces").isNotNull(), F.xxhash64("h", "crc", F.pmod(F.xxhash64("id", F.lit(9)), F.col("pieces"))))
    marked = meta.join(F.broadcast(alone), ["h", "crc"], "left").withColumn("item", item)
    items = marked.where("item is not null").withColumn("rows", F.lit(1)).groupBy("late", "item").agg(*sums)
    first, held = ([r[1:] for r in found] for found in _halves(items.collect()))  # pieces and late groups: bounded too
    share = np.array([r[1:] for r in first + held], np.float64).reshape(-1, 3) / room
    left = np.ones((shards, 3))
    at = place(share[: len(first)], left)
    rest = groups.where(~large & ~late)
    if n := rest.count():
        cells = rest.withColumn("cell", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(-(-n // CELL))))
        small = scratch.cut(cells.groupBy("cell").applyInPandas(_place_cells(left, room), "h long, crc long, bytes long, words long, rows long, shard int"), "small")
        for r in small.groupBy("shard").agg(*sums).collect():
            left[r["shard"]] -= np.array(r[1:], np.float64) / room
    at = even(share, np.concatenate([at, place(share[len(first) :], left)]), left)
    where = spark.createDataFrame([(r[0], int(s)) for r, s in zip(first + held, at, strict=True)], "item long, shard int")
    columns = ["id", "bytes", "crc", "h", "shard"]
    dealt = marked.join(F.broadcast(where), "item").select(columns)
    if n:  # a small group has no more than a part of a shard's rows, so none is hot
        dealt = dealt.unionByName(marked.where("item is null").join(small.select("h", "crc", "shard"), ["h", "crc"]).select(columns))
    slots = running_sum(dealt, ["shard"], ["id", "h", "crc"], F.lit(1), "slot", rows=total["rows"] or 0)
    return slots.select(F.col("id").alias(id_col), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, directory: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of ``df``, with all columns, as one folder of Parquet files per shard.

    Folders are named by a column ``shard``, with underscores behind if ``df``
    has one. Large shards are several files, so no task holds a shard. Null
    ids and texts and repeated rows are rows like any other; rows that share
    id and text are in one folder. An empty table writes no files.
    """
    shard, own, crc, size, c, s = fresh(df.columns, "shard", "own", "crc", "size", "own_crc", "own_size")
    found = assign_shards(df, shards, id_col, text_col).groupBy(F.col(id_col).alias(own), F.col("text_crc32").alias(crc), F.col("size").alias(size)).agg(F.min("shard").alias(shard))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn(c, F.crc32(text.cast("binary"))).withColumn(s, (F.octet_length(text) + 8).cast("long"))
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(c) == F.col(crc)) & (F.col(s) == F.col(size))
    out = keyed.join(found, same).select(*df.columns, shard)
    out.hint("rebalance", shard).write.partitionBy(shard).parquet(directory)
