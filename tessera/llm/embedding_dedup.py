"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact
cosine verification, distributed connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import graph
from tessera.llm.words import lean, mix, stream
from tessera.sources.scratch import Scratch

#: A pair at the threshold shares no table with less probability, and differs in too many bits with less than the second.
MISS, FAR = 4e-8, 1e-9
#: Bits of a table's key that are chosen from, and bits of all tables that are compared first.
BITS, HEAD = (16, 24, 32), 256
_CODED = "id long, label long, dim int, d1 long, d2 long, codes binary, vec binary"


def agreement(threshold: float) -> float:
    """Probability that a hyperplane has two vectors of this cosine on one side."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def shape(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Tables and their bits for so many vectors of one label: keys grow with the rows, so that unlike vectors rarely
    meet, and tables with the keys, so that no more links are missed. At 0.98: 40 of 16 bits, 74 of 24, 132 of 32."""
    bits = next((b for b in BITS if rows << 4 <= 1 << b), BITS[-1])
    together = min(1 - 1e-12, agreement(threshold) ** bits)
    return max(1, math.ceil(math.log(miss) / math.log1p(-together))), bits


def furthest(total: int, threshold: float, miss: float = FAR) -> int:
    """The most of ``total`` bits in which a pair at the threshold differs, but for a probability of ``miss``."""
    p = min(max(1 - agreement(threshold), 1e-12), 1 - 1e-12)
    tail = 0.0
    for k in range(total, 0, -1):
        tail += math.exp(math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(p) + (total - k) * math.log1p(-p))
        if tail > miss:
            return k
    return 0


def _vectors(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and v.values.null_count == 0:
            x = v.values.to_numpy().astype(np.float64) + 0.0
            if not len(x) or not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out, np.array([-1 if x is None else len(x) for x in out])


def _code(batches, tables: int, bits: int, seed: int):
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, labels, column = batch.column(0), batch.column(1), batch.column(2)
        vectors, dims = _vectors(column)
        n = len(vectors)
        codes: list[bytes | None] = [None] * n
        raws: list[bytes | None] = [None] * n
        d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for dim in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == dim)
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
            x = np.stack([vectors[k] for k in at])
            signs = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[dim] > 0
            packed = np.packbits(signs.reshape(len(at), tables, bits), axis=2)
            word = x.view(np.uint64)
            for d, s in ((d1, 31), (d2, 37)):
                d[at] = mix((mix(word) * (stream(s, int(dim)) | np.uint64(1))).sum(axis=1, dtype=np.uint64)).view(np.int64)
            for r, k in enumerate(at):
                codes[k], raws[k] = packed[r].tobytes(), x[r].tobytes()
        good = dims > 0
        yield pa.RecordBatch.from_arrays(
            [ids, labels, pa.array(dims.astype(np.int32)), pa.array(d1, mask=~good), pa.array(d2, mask=~good), pa.array(codes, pa.binary()), pa.array(raws, pa.binary())],
            ["id", "label", "dim", "d1", "d2", "codes", "vec"],
        )


def _words(codes: np.ndarray, width: int, kind: str) -> np.ndarray:
    """Each row's bytes as integers of ``width`` bytes each, with zeros behind."""
    size = np.dtype(kind).itemsize
    parts = np.pad(codes, ((0, 0), (0, -codes.shape[1] % width))).reshape(len(codes), -1, width)
    return np.ascontiguousarray(np.pad(parts, ((0, 0), (0, 0), (0, size - width)))).view(kind)[:, :, 0]


def _candidates(t: pa.Table, tables: int, far: tuple[int, int]):
    """Pairs of rows of blocks that count here: equal labels and lengths, in the first table that they share, and near by their bits."""
    begins = graph.changes(t, ["key", "i", "j"])
    nk, label, dim, table, part = (t.column(c).to_numpy() for c in ("nk", "label", "dim", "table", "slice"))
    across = t.column("i").to_numpy() != t.column("j").to_numpy()
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(nk), -1)
    words, keys = _words(codes, 8, "u8"), _words(codes, codes.shape[1] // tables, "u4")
    head = np.ascontiguousarray(words[:, : HEAD // 64])
    for i, j in graph.pairs(begins, 1 << 15):
        ok = (nk[i] != nk[j]) & (label[i] == label[j]) & (dim[i] == dim[j]) & (~across[i] | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        for own, most in ((head, far[0]), (words, far[1])):
            ok = np.bitwise_count(own[i] ^ own[j]).sum(axis=1, dtype=np.int32) <= most
            i, j = i[ok], j[ok]
        same = keys[i] == keys[j]
        ok = same.argmax(axis=1) == table[i]
        ok &= same[np.arange(len(i)), table[i]]
        yield i[ok], j[ok]


def _near(batches, tables: int, far: tuple[int, int]):
    """The members of blocks that have a candidate there."""
    for t in graph.runs(batches, ["key", "i", "j"]):
        some = np.zeros(t.num_rows, bool)
        for i, j in _candidates(t, tables, far):
            some[i] = some[j] = True
        yield from t.select(_MEMBER).filter(pa.array(some)).combine_chunks().to_batches()


def _link(batches, tables: int, far: tuple[int, int], threshold: float):
    """Links of each block as (node, weight of partners, smallest node reachable in the block)."""
    for t in graph.runs(batches, ["key", "i", "j"]):
        node, mult, dim = (t.column(c).to_numpy() for c in ("node", "mult", "dim"))
        x = np.zeros((len(node), max(dim)))
        for r, b in enumerate(t.column("vec").to_pylist()):
            v = np.frombuffer(b, np.float64)
            x[r, : len(v)] = v / np.abs(v).max()
        norm = np.sqrt((x * x).sum(axis=1))
        got_i, got_j = [], []
        for i, j in _candidates(t, tables, far):
            ok = (x[i] * x[j]).sum(axis=1) / (norm[i] * norm[j]) >= threshold
            got_i.append(i[ok])
            got_j.append(j[ok])
        i, j = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in (got_i, got_j))
        if not len(i):
            continue
        order = np.argsort(node, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = order[graph.roots(len(node), place[i], place[j])][place]
        count = np.bincount(i, mult[j], len(node)) + np.bincount(j, mult[i], len(node))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(count[at].astype(np.int64)), pa.array(node[root[at]])], ["a", "n", "b"])


#: What a member is in a block.
_MEMBER = ["key", "i", "j", "slice", "table", "nk"]


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, tables: int | None = None, bits: int | None = None, seed: int = 7) -> DataFrame:
    """Each row's near copies: (id, n_links, component_id, kept).

    Vectors are compared only within equal labels (all together if
    ``label_col`` is None) and equal length; links have cosine >= threshold in
    double precision. Equal vectors collapse to one node with a multiplicity
    first, so a group of copies costs one row; the links of different vectors
    are counted in bounded blocks and never emitted as pairs. Members of a
    block compare their bits first; vectors travel only to blocks where some
    pair is near by these. Unless given, ``bits`` follow the rows of the
    largest label and ``tables`` the bits (see ``shape``).

    Labels may be of any type that can be hashed; ids are integers below 2^62. Null
    labels; null, zero or empty vectors; vectors with null or non-finite
    components: no links, own component. Null ids: n_links counts, component
    null, kept. Repeated rows: each is a vector of its own in n_links; a
    repeated id is one node of the components. Ties: the smallest id is kept.
    Other columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "embeddings")
    label = F.lit(0).cast("long") if label_col is None else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    if tables is None or bits is None:
        largest = df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        tables, bits = shape(largest, threshold)
    far = furthest(min(HEAD, tables * bits), threshold), furthest(tables * bits, threshold)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    coded = scratch.cut(rows.mapInArrow(lambda it: lean(_code(it, tables, bits, seed)), _CODED), "coded")
    able = coded.where("d1 is not null and label is not null")
    # one row of each set of equal vectors stands for it
    own = able.groupBy("label", "dim", "d1", "d2").agg(F.min("id").alias("node"), F.count("*").alias("mult"), F.min_by(F.struct("codes", "vec"), F.struct(F.col("id").isNull(), "id")).alias("own"))
    nk = F.xxhash64("label", "dim", "d1", "d2")
    nameless = nk.bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)  # behind all ids, so never a component's name
    nodes = scratch.cut(own.select(nk.alias("nk"), "label", "dim", "d1", "d2", F.coalesce("node", nameless).alias("node"), "mult", "own.codes", "own.vec"), "nodes")
    step = bits // 8
    keyed = nodes.select("nk", "label", "dim", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda k: F.substring(F.col("codes"), k * step + 1, step))).alias("table", "code")).select("nk", "table", F.xxhash64("label", "dim", "table", "code").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = graph.blocks(keyed.join(sizes, "key"), "key", "size", "nk").join(nodes.select("nk", "label", "dim", "codes"), "nk")
    dealt = members.select(*_MEMBER, "label", "dim", "codes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "table")
    left = scratch.cut(dealt.mapInArrow(lambda it: lean(_near(it, tables, far)), "key long, i int, j int, slice int, table int, nk long"), "near")
    full = left.join(nodes.select("nk", "label", "dim", "codes", "node", "mult", "vec"), "nk").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "table")
    found = scratch.cut(full.mapInArrow(lambda it: lean(_link(it, tables, far, threshold)), "a long, n long, b long"), "links")
    comp = graph.components(found.select("a", "b"), scratch)
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    known = nodes.select("label", "dim", "d1", "d2", "node", "mult").join(links, "node", "left").join(comp, "node", "left").where("mult > 1 or n > 0")
    known = scratch.lookup(known.select("label", "dim", "d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "node").alias("component")), "known")
    scratch.free(nodes, left, found)
    out = coded.select("id", "label", "dim", "d1", "d2").join(known, ["label", "dim", "d1", "d2"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
