"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

Each fixed mask ignores some positions of a span of words; the hashes of the
others are joined between benchmark and documents. Around each hit, aligned
windows of words are compared, so substituted words do not hide a passage.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.sources.scratch import Scratch

#: Words of an aligned window, and how many of them must agree.
WINDOW, AGREE = 15, 12
#: Any three substitutions in a window, and any two in 13 or 14 words, leave some
#: placement of some mask intact (tests/llm goes through all); "1" marks the
#: positions that are hashed. Shorter items have masks of their own.
MASKS = ("1111011", "11001000111", "11010110001")
LONG = 13
#: Items are cut into overlapping pieces of this many words.
PIECE = 4096
#: Seeds broadcast in one pass over the documents; more take further passes.
SEEDS = 1_000_000


def masks(n: int) -> tuple[str, ...]:
    """Masks that find an item of ``n`` words with any substitutions that leave 4 of 5 words.

    Up to 4 words none may differ; of 5 to 9 one may, and each mask ignores one
    position; of 10 to 12 two may, and each mask ignores two quarters.
    """
    if n >= LONG:
        return MASKS
    if n < 5:
        return ("1" * n,)
    if n < 10:
        return tuple("".join("0" if o == gone else "1" for o in range(n)) for gone in range(n))
    return tuple("".join("0" if 4 * o // n in gone else "1" for o in range(n)) for gone in combinations(range(4), 2))


def _hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text, in lower case."""
    return F.array_remove(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _seeds(words: Column, at: Column, own: Iterable[str]) -> Column:
    """(seed, span) of every mask laid at one position; beyond the end there are no words."""

    def seed(mask: str) -> Column:
        picked = [F.get(words, at + o) for o, c in enumerate(mask) if c == "1"]
        return F.struct(F.xxhash64(F.lit(mask), *picked).alias("seed"), F.lit(len(mask)).alias("span"))

    return F.array(*map(seed, own))


def _pieces(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct benchmark texts in pieces: (item, copies, piece, length, words); length is the item's if that has masks of its own."""
    items = benchmark.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("item"), F.count("*").alias("copies"))
    items = items.select("item", "copies", _hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
    step = PIECE - WINDOW
    count = F.greatest(F.lit(1), F.ceil((F.size("words") - WINDOW) / step)).cast("int")
    cut = items.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    return cut.select("item", "copies", F.xxhash64("item", "k", "words").alias("piece"), F.least(F.size("words"), F.lit(LONG)).alias("length"), F.slice("words", F.col("k") * step + 1, PIECE).alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Benchmark passages found in documents, one row per document and item.

    (id, item, item_copies, similarity, first_word, last_word, hits, text_hash):
    some window of 15 aligned words (the whole item, if it is shorter) agrees in
    4 of 5 words or more. Words are runs of letters and digits in lower case,
    counted from 0. Equal items are one, under the smallest id.

    Null or empty texts on either side, and documents shorter than an item: no
    rows. Null ids: reported as null, told apart by text_hash. Repeated
    documents: one row for each id and text. Ties between windows: the highest
    similarity. Other columns are ignored. Empty tables: no rows.

    The benchmark is broadcast in blocks of a bounded number of seeds, one pass
    over the documents for each; documents are never shuffled, only hits are.
    """
    pieces = _pieces(benchmark, item_col, item_text_col)
    lengths = pieces.groupBy("length").agg(F.sum(F.size("words")).alias("n")).collect()  # LONG rows at most
    total = sum(r["n"] * len(masks(r["length"])) for r in lengths)
    blocks = max(1, -(-total // SEEDS))
    kinds = {r["length"]: masks(r["length"]) for r in lengths} or {LONG: MASKS}
    every = dict.fromkeys(m for kind in kinds.values() for m in kind)
    least = min(map(len, every))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), _hashes(F.col(text_col)).alias("words")).where(F.size("words") >= least)
    at = words.select("id", "text_hash", "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    placed = at.select("id", "text_hash", "words", "at", F.explode(_seeds(F.col("words"), F.col("at"), every)).alias("s")).select("id", "text_hash", "words", "at", "s.seed")
    found = None
    for block in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("piece", F.lit(3)), F.lit(blocks)) == block)
        each = own.select("piece", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("q"))
        mine = F.coalesce(*(F.when(F.col("length") == n, _seeds(F.col("words"), F.col("q"), kind)) for n, kind in kinds.items()))
        seeds = each.select("piece", "q", F.size("words").alias("n"), F.explode(mine).alias("s")).where(F.col("q") + F.col("s.span") <= F.col("n"))
        seeds = seeds.select(F.col("s.seed").alias("seed"), "piece", "q", F.col("s.span").alias("span")).distinct()
        hits = placed.join(F.broadcast(seeds), "seed").select("id", "text_hash", "words", "at", "piece", "q", "span")
        hits = hits.join(F.broadcast(own.select("piece", "item", "copies", F.col("words").alias("own"))), "piece")
        part = _verified(hits)
        found = part if found is None else found.unionByName(part)
    result = found.groupBy("id", "text_hash", "item").agg(
        F.max("copies").alias("item_copies"), F.max("similarity").alias("similarity"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.count("*").alias("hits")
    )
    return result.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "item_copies", "similarity", "first_word", "last_word", "hits", "text_hash")


def _verified(hits: DataFrame) -> DataFrame:
    """Hits with an aligned window around the seed that agrees in enough words."""
    wide = F.least(F.lit(WINDOW), F.size("own"))
    # item positions where a window that holds the seed can start
    low = F.greatest(F.lit(0), F.col("q") + F.col("span") - wide, F.col("q") - F.col("at"))
    high = F.least(F.col("q"), F.size("own") - wide, F.size("words") - F.col("at") + F.col("q") - wide)
    ranged = hits.withColumn("wide", wide).withColumn("low", low).withColumn("high", high).where("low <= high")
    span = F.col("high") - F.col("low") + F.col("wide")
    cut = ranged.select(
        "id", "text_hash", "item", "copies", "wide", (F.col("low") + F.col("at") - F.col("q")).alias("start"), (F.col("high") - F.col("low")).alias("moves"),
        F.zip_with(F.slice("words", F.col("low") + F.col("at") - F.col("q") + 1, span), F.slice("own", F.col("low") + 1, span), lambda a, b: (a == b).cast("int")).alias("same"),
    )
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("moves")), lambda t: F.aggregate(F.slice("same", t + 1, F.col("wide")), F.lit(0), lambda a, b: a + b)))
    scored = cut.withColumn("best", best).where(F.col("best") * WINDOW >= F.col("wide") * AGREE)
    return scored.select("id", "text_hash", "item", "copies", (F.col("best") / F.col("wide")).alias("similarity"), F.col("start").cast("long").alias("first_word"), (F.col("start") + F.col("moves") + F.col("wide") - 1).cast("long").alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns, whatever they are called.

    Null, empty and short texts stay, null ids are judged by their text; of
    repeated rows all stay or go. An empty table gives no rows.
    """
    own, text = fresh(docs.columns, "own", "text_hash")
    found = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias(own), F.col("text_hash").alias(text)).distinct()
    found = Scratch(docs.sparkSession, "decontamination").lookup(found, "found")
    return docs.join(found, (F.xxhash64(F.col(text_col)) == F.col(text)) & F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
