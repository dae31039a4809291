"""Distributed connected components and blocks of pairs inside groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star operations of Kiveris et al.,
    "Connected Components in MapReduce and Beyond" (2014): each turns every
    node's links towards its smallest neighbour, and the links end as stars in
    a number of rounds that is logarithmic in practice. A node's links are
    never gathered; minima are pre-aggregated before the shuffle, and joins on
    a hot node are split by adaptive execution. No links: no rows.
    """
    now, state = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt, after = _stored(nxt, scratch)
        scratch.free(now)
        now = nxt
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stored(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The links as a table, with their number and a digest."""
    digest = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("a", "b")), "s": F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))}
    out, found = scratch.measured(edges, "edges", **digest)
    return out, (found["n"], found["x"], found["s"])


#: Members of a group compared at once: a block holds two slices of this many at most.
SLICE = 1024


def blocks(members: DataFrame, key: str, size: str, node: str, major: str | None = None, majors: str | None = None) -> DataFrame:
    """Members of each group dealt to blocks (key, i, j) so that pairs meet, without any task holding a group.

    ``size`` is the number of the group's members, without its majors. Members
    fall into ceil(size / SLICE) slices by hash; each slice meets each other
    slice in one block. Members marked by the boolean ``major``, ``majors`` in
    all, have slices of their own, which meet those of the others but not one
    another: where a few members are left beside many that need not be compared,
    nearly every member stands in one block.
    """
    big = F.col(major) if major else F.lit(False)
    n = F.ceil(F.col(size) / SLICE).cast("int")
    m = F.ceil(F.col(majors) / SLICE).cast("int") if majors else F.lit(0)
    hashed = F.xxhash64(node, F.lit(5))
    own = F.when(big, n + F.pmod(hashed, F.greatest(m, F.lit(1)))).otherwise(F.pmod(hashed, F.greatest(n, F.lit(1)))).cast("int")
    reach = F.when(big, n).otherwise(n + m)  # a member meets the other members' slices, and they also those of majors
    return (
        members.withColumn("slice", own)
        .withColumn("_d", F.explode(F.when(reach > 0, F.sequence(F.lit(0), reach - 1))))
        .withColumn("i", F.least("slice", "_d"))
        .withColumn("j", F.greatest("slice", "_d"))
        .drop("_d", size, *[c for c in (major, majors) if c])
    )


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of rows that agree on ``keys``, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.flatnonzero(changes(pa.Table.from_batches([batch]), keys))
        whole = rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        if whole:
            yield pa.Table.from_batches(rest)
            rest = []
        if len(heads) > 1:
            cut = int(heads[-1])
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a run begins."""
    out = np.zeros(table.num_rows, bool)
    if len(out):
        out[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def stretches(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Where each run begins and ends."""
    heads = np.flatnonzero(changes(table, keys)).tolist()
    yield from zip(heads, [*heads[1:], table.num_rows], strict=True)


def pairs(begins: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs, at most about ``limit`` at a time. begins: True where a run begins."""
    n = len(begins)
    heads = np.flatnonzero(begins)
    ends = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))
    after = ends - np.arange(n) - 1
    lo, sums = 0, np.concatenate([[0], np.cumsum(after)])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + limit, side="right")) - 1)
        count = after[lo:hi]
        total = int(count.sum())
        if total:
            i = np.repeat(np.arange(lo, hi), count)
            j = i + 1 + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            yield i, j
        lo = hi


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, by links i-j held in memory."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        if not (a != b).any():
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
    return label
