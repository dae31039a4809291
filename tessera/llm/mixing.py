"""Mixing sources to target weights.

The words of each source are packed end to end into blocks of a fixed length.
Output shards draw how many slots each source gets from a multinomial over what
the sources still have to give; a source's slots go through pseudorandom
permutations of its block numbers, and blocks are joined by number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.feistel import permute
from tessera.llm.graph import runs, stretches
from tessera.llm.names import fresh
from tessera.llm.words import lean, mix
from tessera.operators.running import rows_above, running_sum
from tessera.sources.scratch import Scratch

#: Words of a block, and output shards.
BLOCK, SHARDS = 32, 64
#: White space between words, in a character class and as characters.
SPACE, BLANKS = r"\x20\x09-\x0D", "\x20\x09\x0a\x0b\x0c\x0d"
#: Slots that one row stands for before they are counted out.
RUN = 1 << 16
#: Groups of sources whose counts per shard are drawn first; a group's sources draw within them.
GROUPS = 1024


def targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """``sources`` (weight, size, ...) with ``target``: ``total`` shared by weight, no target above ``most``
    times its source's size, the excess reshared until none is.

    A source stops if the share of a unit of weight is above its own limit; the
    unit only grows as sources stop, so each pass over the table settles it
    for some more of them.
    """
    limit = most * F.col("size")
    share = lambda unit: F.lit(unit) * F.col("weight")
    unit = 0.0
    while True:
        over = share(unit) > limit
        taken, weight = sources.where("size > 0").agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if not weight or (total - (taken or 0)) / weight <= unit:
            break
        unit = (total - (taken or 0)) / weight
    return sources.withColumn("target", F.when(F.col("size") > 0, F.least(share(unit) if weight else limit, limit)).otherwise(0.0).cast("double"))


def draws(slots: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Slots of each source in shards of given sizes: multinomial draws over what is left, so a source's slots add up to its own."""
    left = slots.astype(np.int64).copy()
    out = np.zeros((len(sizes), len(left)), np.int64)
    for h, want in enumerate(sizes.tolist()):
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[h] += got
            left -= got
            want -= int(got.sum())
    return out


_RUNS = "shard int, source_id long, first long, n long, blocks long, key long"


def _shares(batches, counts: np.ndarray, seed: int):
    """The runs of slots that each source has in each shard, from sources sorted by group."""
    groups = (t.slice(lo, hi - lo) for t in runs(batches, ["part"]) for lo, hi in stretches(t, ["part"]))
    for t in groups:
        part = t.column("part")[0].as_py()
        ids, blocks = t.column("source_id").to_numpy(), t.column("blocks").to_numpy()
        own = draws(t.column("slots").to_numpy(), counts[:, part], np.random.default_rng([seed, part]))
        first = np.cumsum(own, axis=0) - own
        keys = mix((np.int64(seed * 1_000_003) + ids).astype(np.uint64)).view(np.int64)
        h, k = np.nonzero(own)
        for lo in range(0, len(h), 1 << 16):
            a, b = h[lo : lo + (1 << 16)], k[lo : lo + (1 << 16)]
            columns = a.astype(np.int32), ids[b], first[a, b], own[a, b], blocks[b], keys[b]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "source_id", "first", "n", "blocks", "key"])


def _blocks(batches):
    """The block that fills each slot of the runs, a run's ``part`` telling which RUN of its slots."""
    for b in batches:
        shard, source, first, n, blocks, key, part = (b.column(c).to_numpy() for c in ("shard", "source_id", "first", "n", "blocks", "key", "part"))
        size = np.minimum(n - part * RUN, RUN)
        sums, lo = np.concatenate([[0], np.cumsum(size)]), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + RUN, side="right")) - 1)
            row = np.repeat(np.arange(lo, hi), size[lo:hi])
            slot = first[row] + part[row] * RUN + np.arange(len(row)) - (sums[row] - sums[lo])
            turn = mix((slot // blocks[row]).astype(np.uint64) + np.uint64(1)).view(np.int64)  # each pass has its own permutation
            block = permute(slot % blocks[row], blocks[row], key[row] ^ turn)
            yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(source[row]), pa.array(block)], ["shard", "source_id", "block"])
            lo = hi


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


@dataclass
class Mixture:
    sources: DataFrame  # source_id, source, size, target, slots
    placed: DataFrame  # id, text_hash, source_id, size, start: each document in its source's words
    slots: DataFrame  # shard, source_id, block: what each output shard holds
    pieces: DataFrame  # id, text_hash, source_id, size, start, block, words, uses
    repeated: int  # rows that share id, text and source with others


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 29) -> Mixture:
    """Draws a mixture: which block fills each slot of each output shard, and what it takes of each document.

    Sources in order of code points, null last, take ``weights`` in turn and
    share ``share`` times all words. A block is used ``most`` times at most, in
    whole passes over a permutation of all blocks before any is used again.
    Sources are a table, of any number: their ranks and targets are aggregates,
    shards draw counts of GROUPS groups of sources on the driver and those of
    the sources of a group on executors.
    The same rows and seed give the same mixture in any partitioning.

    Null, empty and blank texts: size 0, nothing taken. Null ids and repeated
    rows: documents like any other. Ties in order: repeated rows, which are
    alike. Other columns are ignored. Empty table: no sources, no slots.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = scratch.cut(rows, "sizes")
    named, total = scratch.measured(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sources", size=F.sum("size"), names=F.count("source"), n=F.sum("n"))
    words, n = total["size"] or 0, total["n"] or 0
    rank = F.when(F.col("source").isNull(), F.lit(total["names"])).otherwise(F.lit(total["names"]) - 1 - F.col("above"))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("source_id", F.lit(len(weights))) + 1).cast("int"))
    ranked = scratch.cut(rows_above(named, "source", "above").withColumn("source_id", rank.cast("long")).withColumn("weight", turn), "ranked")
    blocks = F.ceil(F.col("size") / BLOCK)
    slots = F.when(F.col("size") > 0, F.least(most * blocks, F.rint(F.col("target") * blocks / F.col("size")))).otherwise(0).cast("long")
    settled = targets(ranked, share * words, most).withColumn("blocks", blocks.cast("long")).withColumn("slots", slots).withColumn("part", F.pmod("source_id", F.lit(GROUPS)).cast("int"))
    sources = scratch.cut(settled.select("source_id", "source", "size", "target", "blocks", "slots", "part"), "targets")
    known = sized.join(sources.select(F.col("source").alias("name"), "source_id"), F.col("source").eqNullSafe(F.col("name"))).select("id", "text_hash", "source_id", "size")
    placed = scratch.cut(running_sum(known, ["source_id"], ["id", "text_hash"], "size", "start", rows=n), "placed")
    again = placed.where("size > 0").groupBy("id", "text_hash", "source_id").agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") > 1, F.col("n")))).first()[0]

    of = np.zeros(GROUPS, np.int64)
    for r in sources.groupBy("part").agg(F.sum("slots").alias("slots")).collect():  # GROUPS rows at most
        of[r["part"]] = r["slots"]
    sizes = np.diff(int(of.sum()) * np.arange(shards + 1) // shards)
    counts = draws(of, sizes, np.random.default_rng(seed))
    shared = spark.sparkContext.broadcast(counts)
    own = sources.where("slots > 0").select("part", "source_id", "blocks", "slots").repartition("part").sortWithinPartitions("part", "source_id")
    run = scratch.cut(own.mapInArrow(lambda it: lean(_shares(it, shared.value, seed)), _RUNS), "runs")
    parts = run.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    parts = parts.repartition(max(1, int(of.sum()) // (4 * RUN)), "shard", "source_id", "part")  # by slots: rows look small to adaptive execution
    slots = parts.mapInArrow(lambda it: lean(_blocks(it)), "shard int, source_id long, block long")
    uses = slots.groupBy("source_id", "block").agg(F.count("*").alias("uses"))
    low, high = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    covers = placed.where("size > 0").withColumn("block", F.explode(F.sequence(low, high)))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    # by hint, as what is counted out looks small until then
    pieces = covers.withColumn("words", words).join(uses.hint("merge"), ["source_id", "block"])
    return Mixture(sources, placed, slots, pieces, again or 0)


def taken(mixture: Mixture, id_col: str = "doc_id") -> DataFrame:
    """One row per document: (id, size, source_size, target, taken), taken counting repeats."""
    sums = mixture.pieces.groupBy("source_id", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    totals = mixture.sources.select("source_id", F.col("size").alias("source_size"), "target")
    some = mixture.placed.where("size > 0").join(sums, ["source_id", "start"], "left")
    none = mixture.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = some.unionByName(none).join(totals, "source_id")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text: Column, lead: Column, cuts: Column, most: int) -> Column:
    """The words of ``text`` in the blocks of ``cuts`` (at, uses), pass after pass; ``lead`` words of others come first in its first block.

    In Spark's own expressions: no batch of texts is held outside the heap or by a worker.
    """
    block = rf"(?:[^{SPACE}]++[{SPACE}]*+){{1,{BLOCK}}}+"
    blocks = F.regexp_extract_all(F.concat(F.repeat(F.lit("x "), lead), F.trim(text, F.lit(BLANKS))), F.lit(block), F.lit(0))

    def taken(own: Column) -> Column:
        def one(again: int) -> Column:
            picked = F.filter(own["cuts"], lambda u: u["uses"] >= again)
            words = lambda u: F.element_at(own["blocks"], u["at"] + 1)
            text = F.array_join(F.transform(picked, lambda u: F.when(u["at"] == 0, F.substring(words(u), own["lead"] * 2 + 1, F.length(words(u)))).otherwise(words(u))), "")
            return F.when(text.rlike(f"[^{SPACE}]\\z"), F.concat(text, F.lit(" "))).otherwise(text)

        return F.trim(F.concat(*(one(again) for again in range(1, 1 + most))), F.lit(BLANKS))

    # through an array of one row: the blocks are cut out once, not for each that is taken
    return F.transform(F.array(F.struct(blocks.alias("blocks"), lead.alias("lead"), cuts.alias("cuts"))), taken)[0]


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """The mixture as documents: each row's text is cut to the words the mixture takes, with all columns.

    Words taken in the first pass come first, in order, with the white space
    after them; those that are taken again follow. Documents of which nothing
    is taken are left out, so null, empty and blank texts are. ``length_col``,
    if there is one, is set to the new text's characters. Null ids, null
    sources and repeated rows are documents like any other; columns may have
    any names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    mixture = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key, copy, k, c, cuts, lead = fresh(docs.columns, "key", "copy", "own_key", "own_copy", "cuts", "lead")
    # a row's key: two rows that share it by accident share it with probability 2^-64
    of = lambda i, text, source: F.xxhash64(F.coalesce(i, F.lit(0)), i.isNull(), text, F.coalesce(source, F.lit("")), source.isNull())
    cut_at = F.struct((F.col("block") - F.floor(F.col("start") / BLOCK)).cast("int").alias("at"), F.col("uses").cast("int").alias("uses"))
    per = mixture.pieces.groupBy("id", "text_hash", "source_id", "start").agg(F.sort_array(F.collect_list(cut_at)).alias(cuts))
    per = per.join(mixture.sources.select("source_id", "source"), "source_id")
    # repeated rows are numbered, so that each gets its own pieces
    numbered = per.select(of(F.col("id"), F.col("text_hash"), F.col("source")).alias(k), "start", cuts).withColumn(c, F.row_number().over(Window.partitionBy(k).orderBy("start"))).select(k, c, F.pmod("start", F.lit(BLOCK)).cast("int").alias(lead), cuts)
    keyed = docs.withColumn(key, of(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(source_col).cast("string")))
    one = keyed.withColumn(copy, F.lit(1))
    if mixture.repeated:
        again = Scratch(spark, "mixing").lookup(keyed.groupBy(F.col(key).alias(k)).agg(F.count("*").alias("n")).where("n > 1").select(k), "again")
        same = F.col(key) == F.col(k)
        more = keyed.join(again, same, "left_semi").withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))))
        one = keyed.join(again, same, "left_anti").withColumn(copy, F.lit(1)).unionByName(more)

    joined = one.join(numbered, (F.col(key) == F.col(k)) & (F.col(copy) == F.col(c))).withColumn(text_col, _cut(F.col(text_col), F.col(lead), F.col(cuts), options.get("most", 2)))
    if length_col in docs.columns:
        joined = joined.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return joined.select(*docs.columns)
