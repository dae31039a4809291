"""MinHash near-dedup with sequential Bayesian verification.

Candidates come from banded signatures. Batches of signature bytes are compared
in turn and a pair is dropped once its posterior probability of reaching the
threshold falls below a chosen miss probability (after Satuluri and
Parthasarathy, "Bayesian Locality Sensitive Hashing", 2012); what survives is
verified on the full shingle sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import graph
from tessera.llm.names import fresh
from tessera.llm.words import lean, mix, shingles, stream, texts
from tessera.sources.scratch import BROADCAST, Scratch

#: At the lowest similarity linked, 0.8, a band of 6 agrees with probability
#: 0.262; all of 50 bands miss a pair with probability below 3e-7.
BANDS, ROWS = 50, 6
#: Signature values compared between two looks at the posterior.
BATCH = 30
#: A pair is dropped when it reaches the threshold with less probability.
MISS = 1e-7
#: Parts that the pairs of one pivot are dealt to.
SPREAD = 64
_META = "id long, n long, d1 long, d2 long, bands array<long>, sig binary"


def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    return (stream(41, count).astype(np.uint32) | np.uint32(1))[:, None], stream(43, count).astype(np.uint32)[:, None]


def minima(x: np.ndarray, count: int) -> np.ndarray:
    """Smallest value of each of ``count`` hash functions over a set of 64-bit hashes."""
    a, b = _hashers(count)
    half = count // 2
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 8192):
        part = x[lo : lo + 8192]
        for at, word in ((slice(0, half), part.astype(np.uint32)), (slice(half, count), (part >> np.uint64(32)).astype(np.uint32))):
            out[at] = np.minimum(out[at], (word[None, :] * a[at] + b[at]).min(axis=1))
    return out


def _sign(batches, k: int, bands: int, rows: int):
    weight = (stream(47, rows) | np.uint64(1))[None, :]
    salt = stream(53, bands)
    for batch in batches:
        n = batch.num_rows
        size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys: list[np.ndarray | None] = [None] * n
        sigs: list[bytes | None] = [None] * n
        for r, words in texts(batch.column(1)):
            s = shingles(words, k)
            if not len(s):
                continue
            size[r] = len(s)
            d1[r], d2[r] = (mix(np.array([mix(s ^ u).sum(dtype=np.uint64)])).view(np.int64)[0] for u in stream(59, 2))
            least = minima(s, bands * rows)
            keys[r] = mix((least.reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + salt).view(np.int64)
            sigs[r] = least.astype(np.uint8).tobytes() + keys[r].astype("<u4").tobytes()
        none = size == 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size), pa.array(d1, mask=none), pa.array(d2, mask=none), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            ["id", "n", "d1", "d2", "bands", "sig"],
        )


@functools.cache
def least_matches(total: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of signature bytes compared, the fewest matches with which a pair stays.

    Bytes of equal minima match; others match by chance, 1 in 256. The prior
    of the similarity is uniform.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    high = j >= threshold
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            ll = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(ll - ll.max())
            if w[high].sum() >= miss * w.sum():
                break
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int = BATCH) -> np.ndarray:
    """Positions of the pairs of signature rows that survive every batch."""
    alive = np.arange(len(a))
    score = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(a.shape[1], batch, threshold, miss)):
        at = slice(k * batch, (k + 1) * batch)
        score = score + (a[alive, at] == b[alive, at]).sum(axis=1, dtype=np.int32)
        keep = score >= least
        alive, score = alive[keep], score[keep]
    return alive


def _signatures(column: pa.Array, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature bytes of each row, and its bands' keys cut to 32 bits."""
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    own = whole.shape[1] - 4 * bands
    return whole[:, :own], np.ascontiguousarray(whole[:, own:]).view("<u4")


def led(pairs: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """Rows (b, s, a, value) of pairs (a, b): runs of (b, s) begin with b's own value, without an a.

    b's value travels once to each of SPREAD parts of its pairs and not with
    every pair, and no part holds all of a large star. ``own`` has (node, value).
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a", F.lit(71)), F.lit(SPREAD)).cast("int").alias("s"))
    members = own.withColumnRenamed("node", "a").join(dealt, "a").select("b", "s", "a", value)
    pivots = own.withColumnRenamed("node", "b").join(dealt.select("b", "s").distinct(), "b").select("b", "s", F.lit(None).cast("long").alias("a"), value)
    return members.unionByName(pivots).repartition("b", "s").sortWithinPartitions("b", "s", F.asc_nulls_first("a"))


def _runs(batches):
    """(table, pivot rows, member rows) of ``led`` rows; a run that goes on in the next batch takes its pivots along.

    A run has several pivots only if an id has several texts: then each member
    meets each of them, one in each of the triples of a table.
    """
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if before is not None and before.num_rows and all(before.column(k)[0] == t.column(k)[0] for k in ("b", "s")):
            t = pa.concat_tables([before, t])
        begins = graph.changes(t, ["b", "s"])
        run, first = np.cumsum(begins) - 1, np.flatnonzero(begins)
        pivot = t.column("a").is_null().to_numpy()
        count = np.bincount(run, pivot, len(first)).astype(np.int64)
        before = t.slice(int(first[-1]), int(count[-1]))
        member = np.flatnonzero(~pivot)
        for k in range(int(count.max())):
            m = member[count[run[member]] > k]
            yield t, first[run[m]] + k, m


def _prune(batches, bands: int, percent: int, miss: float):
    for t, p, m in _runs(batches):
        sig = _signatures(t.column("sig").combine_chunks(), bands)[0]
        keep = m[plausible(sig[p], sig[m], percent / 100, miss)]
        yield from t.select(["a", "b"]).take(pa.array(keep)).combine_chunks().to_batches()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirm(batches, k: int, percent: int):
    """Pairs (a, b) whose full sets are similar enough; a pivot's text is cut into shingles once a batch."""
    for t, p, m in _runs(batches):
        of, keep, held = np.full(t.num_rows, -1), [], {}
        of[m] = p
        wanted = np.isin(np.arange(t.num_rows), p)
        for r, words in texts(t.column("text")):
            if wanted[r]:
                held = {r: shingles(words, k)} if of[r] < 0 else held
            elif of[r] >= 0 and _similar(held[of[r]], shingles(words, k), percent):
                keep.append(r)
        yield from t.select(["a", "b"]).take(pa.array(keep, pa.int64())).combine_chunks().to_batches()


#: What a member brings to a block.
_BLOCK = ["key", "i", "j", "slice", "node", "component", "n", "sig"]


def _meet(batches, bands: int, percent: int, miss: float, k: int | None):
    """Pairs across components inside blocks of a bucket.

    A pair counts in the first band that it shares and is pruned by signature.
    Without ``k``, the members that have some pair left are returned; with it,
    whole texts are compared, and of the links that hold a spanning forest.
    """
    for t in graph.runs(batches, ["key", "i", "j"]):
        begins = graph.changes(t, ["key", "i", "j"])
        key, node, comp, part, n = (t.column(c).to_numpy() for c in ("key", "node", "component", "slice", "n"))
        across = t.column("i").to_numpy() != t.column("j").to_numpy()
        sig, band = _signatures(t.column("sig"), bands)
        here = (band == key.astype(np.uint32)[:, None]).argmax(axis=1)
        got_i, got_j = [], []
        for i, j in graph.pairs(begins, 1 << 15):
            ok = (comp[i] != comp[j]) & (~across[i] | (part[i] != part[j]))
            ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = (band[i] == band[j]).argmax(axis=1) == here[i]
            i, j = i[ok], j[ok]
            keep = plausible(sig[i], sig[j], percent / 100, miss)
            got_i.append(i[keep])
            got_j.append(j[keep])
        i, j = (np.concatenate([np.zeros(0, np.int64), *g]) for g in (got_i, got_j))
        if k is None:
            at = pa.array(np.unique(np.concatenate([i, j])))
            yield t.select(_BLOCK).take(at).combine_chunks().to_batches()[0] if len(at) else _nothing(t)
            continue
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        sets = [s for _, s in ((r, shingles(w, k)) for r, w in texts(t.column("text").take(pa.array(used))))]
        left, right = back[: len(i)], back[len(i) :]
        groups, own = np.unique(comp[used], return_inverse=True)
        root = np.arange(len(groups))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            a, b = top(own[x]), top(own[y])
            if a != b and _similar(sets[x], sets[y], percent):
                root[max(a, b)] = min(a, b)
                links.append((x, y))
        a, b = (used[[link[m] for link in links]] if links else np.zeros(0, np.int64) for m in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _nothing(t: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=t.select(_BLOCK).schema)


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, miss: float = MISS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of near copies: (id, n_shingles, component_id, kept).

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of
    distinct shingles, confirmed on whole sets; a component is what links
    reach. Texts with equal sets are one node. Every member of a bucket is
    first compared with the bucket's smallest id; only where a bucket still
    holds several components do its other members meet, in bounded blocks that
    return links of a spanning forest: groups of copies never become pairs in a
    table, and no bucket is capped.

    Null, empty or blank texts: n_shingles 0, no links. Texts shorter than a
    shingle: the whole sequence is the one shingle. Null ids: component null,
    kept. Repeated ids: one node, their texts share a component. Ties: the
    smallest id stays. Other columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    meta = scratch.cut(docs.mapInArrow(lambda it: lean(_sign(it, shingle_words, bands, rows)), _META), "meta")
    # one row of each set stands for it
    stand = meta.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.min_by(F.struct("bands", "sig"), "id").alias("own"))
    nodes = scratch.cut(stand.where("node is not null").select("node", "n", "d1", "d2", "copies", "own.bands", "own.sig"), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = scratch.cut(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.cut(keyed.join(buckets, "key"), "members")
    scratch.free(buckets)
    stars = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    sigs, whole = nodes.select("node", "sig"), docs.where("text is not null").withColumnRenamed("id", "node")

    def verified(pairs: DataFrame) -> DataFrame:
        left = scratch.lookup(led(pairs, sigs, "sig").mapInArrow(lambda it: lean(_prune(it, bands, percent, miss)), "a long, b long").distinct(), "plausible")
        return scratch.cut(led(left, whole, "text").mapInArrow(lambda it: lean(_confirm(it, shingle_words, percent)), "a long, b long").distinct(), "links")

    def labelled(frame: DataFrame, comp: DataFrame, column: str, out: str) -> DataFrame:
        named = comp.select(F.col("node").alias(column), F.col("component").alias(out))
        return frame.join(named, column, "left").withColumn(out, F.coalesce(out, column))

    # Round 1: each node with the smallest pivot of its buckets.
    first = verified(stars.groupBy("a").agg(F.min("b").alias("b")))
    # Round 2: the pivots that this hasn't led to the same place.
    place = first.select(F.col("a").alias("node"), F.col("b").alias("component"))
    second = verified(labelled(labelled(stars.distinct(), place, "a", "ca"), place, "b", "cb").where("ca <> cb").select("a", "b"))
    comp = scratch.cut(graph.components(first.unionByName(second), scratch), "components")
    # Round 3: members of a bucket that holds several components meet each other.
    spread = labelled(members.where("size > 2").select("key", "node"), comp, "node", "component")
    mixed = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    mixed, found = scratch.measured(spread.join(mixed, "key").select("key", "node", "component"), "mixed", n=F.count("*"))
    if found["n"]:
        links, found = scratch.measured(_across(mixed, nodes, whole, scratch, bands, percent, miss, shingle_words), "links", n=F.count("*"))
    if found["n"]:
        # the components that these links join
        joined = graph.components(labelled(labelled(links, comp, "a", "ca"), comp, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
        up = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        old = comp.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        comp = scratch.cut(old.unionByName(joined.join(comp.select("node"), "node", "left_anti")), "components")

    # what stands alone is its own component
    known = labelled(nodes.select("node", "n", "d1", "d2", "copies"), comp, "node", "component").where("copies > 1 or component <> node")
    known = scratch.lookup(known.select("n", "d1", "d2", "component"), "known")
    out = meta.select("id", "n", "d1", "d2").join(known, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    scratch.free(members, nodes, mixed, first, second)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _across(mixed: DataFrame, nodes: DataFrame, whole: DataFrame, scratch: Scratch, bands: int, percent: int, miss: float, k: int) -> DataFrame:
    """Links (a, b) between components inside buckets of several, from the members (key, node, component) of those.

    In a large bucket the members of its largest component meet the others
    but not each other.
    """
    parts = mixed.groupBy("key", "component").agg(F.count("*").alias("n"))
    tops = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    large = F.col("size") > graph.SLICE
    tops = tops.select("key", F.when(large, F.col("top.component")).alias("major"), F.when(large, F.col("top.n")).otherwise(0).alias("majors"), "size")
    dealt = mixed.join(tops, "key").select("key", "node", "component", F.coalesce(F.col("component") == F.col("major"), F.lit(False)).alias("major"), "majors", (F.col("size") - F.col("majors")).alias("minors"))
    # a member meets its signature, and later its text, once and not in every bucket; it has one bucket a band at most
    held = dealt.groupBy("node", "component").agg(F.collect_list(F.struct("key", "major", "majors", "minors")).alias("buckets"))
    held = held.join(nodes.select("node", "n", "sig"), "node").select("node", "component", "n", "sig", F.explode("buckets").alias("bucket"))
    dealt = graph.blocks(held.select("node", "component", "n", "sig", "bucket.*"), "key", "minors", "node", "major", "majors")
    dealt = dealt.select(_BLOCK).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    left = scratch.cut(dealt.mapInArrow(lambda it: lean(_meet(it, bands, percent, miss, None)), dealt.schema), "unsettled")
    place = F.struct("key", "i", "j", "slice")
    once = scratch.lookup(left.groupBy("node", "component", "n", "sig").agg(F.collect_list(place).alias("places")), "unsettled")
    full = whole.join(once, "node").select("node", "component", "n", "sig", "text", F.explode("places").alias("place"))
    full = full.select("node", "component", "n", "sig", "text", "place.*")
    full = full.select(*_BLOCK, "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return full.mapInArrow(lambda it: lean(_meet(it, bands, percent, miss, k)), "a long, b long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that their group of near copies keeps, with all their columns.

    Rows with a null id stay; of rows that repeat an id, the one whose text
    hashes lowest stays.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    own, rank = fresh(df.columns, "own", "rank")
    found = link_documents(df, id_col, text_col, **options)
    marks = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.bool_or(~F.col("kept")).alias("gone"), F.count("*").alias("n"))
    marks, count = scratch.measured(marks.where("gone or n > 1"), "marks", n=F.count("*"), again=F.count_if(~F.col("gone")))
    marks = F.broadcast(marks) if count["n"] <= BROADCAST else marks
    once = df.join(marks.select(own), F.col(id_col) == F.col(own), "left_anti")
    if not count["again"]:
        return once
    again = df.join(marks.where("not gone").select(own), F.col(id_col) == F.col(own), "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(F.col(text_col)), F.col(text_col))
    return once.unionByName(again.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank))
