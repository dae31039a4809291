"""LM scoring with Brown class-based n-grams.

Exchange clustering (Kneser and Ney, 1993; Brown et al., 1992) assigns the most
frequent words to classes so that class bigrams predict best; then every other
word of the corpus joins the class that its own neighbours favour most. A
word's probability is its class's, given the class before, times the word's
share of its class. Words never seen have a class by their last character,
which takes what discounting takes from the seen words of that kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.sources.scratch import Scratch

#: Words that exchange clustering moves in sweeps on the driver, and the classes it moves them between; executors place the others.
CLUSTERED, CLASSES, SWEEPS = 2048, 64, 4
#: Words whose counts and classes every executor holds; those of others are joined.
HELD = 131_072
#: Classes of words never seen, by last character: full stop, comma,
#: other punctuation, digit, ASCII letter, other. The document's end is a class too.
SHAPES = 6
END = np.uint64(0x5A5A5A5A5A5A5A5B)
#: Words of a task whose counts are held before they are passed on; merging needs several times their memory.
BUFFER = 1 << 19

_SHAPE = np.full(256, 5, np.int64)
_SHAPE[[c for c in range(128) if not chr(c).isalnum()]] = 2
_SHAPE[ord(".")], _SHAPE[ord(",")] = 0, 1
_SHAPE[[c for c in range(128) if chr(c).isdigit()]] = 3
_SHAPE[[c for c in range(128) if chr(c).isalpha()]] = 4


def _tokens(column: pa.Array):
    """(first row, hashes with an end after each text, shapes, offsets) for pieces of a column."""
    data, offsets = words.buffers(column)
    for lo, hi in words.chunks(offsets):
        part = offsets[lo : hi + 1]
        h, at = words.hashed(data, part)
        ends = words.spans(data, part)[1]
        shape = _SHAPE[data[part[0] : part[-1]][ends - 1]] if len(ends) else np.zeros(0, np.int64)
        n = hi - lo
        yield lo, np.insert(h, at[1:], END), np.insert(shape, at[1:], 0), at + np.arange(n + 1)


def _count(batches):
    """Partial counts (h, shape, n) of a task's tokens."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        h, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        return keys, shape[first], np.bincount(back, n, len(keys)).astype(np.int64)

    def batch(h, shape, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n)], ["h", "shape", "n"])

    for b in batches:
        for _, h, shape, _ in _tokens(b.column(0)):
            held.append((h, shape, np.ones(len(h), np.int64)))
            size += len(h)
            if size > 2 * BUFFER:
                held = [merged()]
                size = len(held[0][0])
                if size > BUFFER:
                    yield batch(*held[0])
                    held, size = [], 0
    if held:
        yield batch(*merged())


def xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """Classes of symbols from their bigram counts.

    The first ``movable`` symbols start dealt out in turn and move, one at a
    time, to the class that raises the likelihood of the class bigram model
    most, until a sweep moves none; each other symbol keeps a class of its own.
    """
    n = len(bigrams)
    cls = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    k = classes + n - movable
    ahead, behind = bigrams.astype(np.float64), np.ascontiguousarray(bigrams.T).astype(np.float64)
    member = np.zeros((n, k))
    member[np.arange(n), cls] = 1
    g = member.T @ ahead @ member
    rows, columns = g.sum(axis=1), g.sum(axis=0)

    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a = cls[w]
            right, left, self_ = np.bincount(cls, ahead[w], k), np.bincount(cls, behind[w], k), ahead[w, w]
            n_right, n_left = right.sum(), left.sum()
            g[a] -= right
            g[:, a] -= left
            g[a, a] += self_
            rows[a] -= n_right
            columns[a] -= n_left
            right[a] -= self_
            left[a] -= self_
            own, diagonal = xlogx(g[:classes]), np.arange(classes)
            gain = (xlogx(g[:classes] + right) - own).sum(axis=1) + (xlogx(g[:, :classes] + left[:, None]) - xlogx(g[:, :classes])).sum(axis=0)
            d = g[diagonal, diagonal]
            r, l = right[:classes], left[:classes]
            gain += xlogx(d + r + l + self_) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
            gain -= xlogx(rows[:classes] + n_right) - xlogx(rows[:classes]) + xlogx(columns[:classes] + n_left) - xlogx(columns[:classes])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[w] = b
            right[b] += self_
            left[b] += self_
            g[b] += right
            g[:, b] += left
            g[b, b] -= self_
            rows[b] += n_right
            columns[b] += n_left
        if not moved:
            break
    return cls


@dataclass
class Model:
    """What executors hold: bounded whatever the corpus's size."""

    train_tokens: int
    train_words: int
    held: np.ndarray  # sorted hashes of the most frequent words
    held_count: np.ndarray
    held_class: np.ndarray
    transition: np.ndarray  # log10, class before x class
    class_tokens: np.ndarray
    discount: np.ndarray  # of each class: taken from every seen word's count
    unseen: np.ndarray  # log10 share of words never seen
    passed: np.ndarray  # share of each class that discounting passes on to each class

    @property
    def base_log(self) -> float:
        return float(np.log10(self.train_tokens + 0.5 * (self.train_words + 1)))


def _symbols(held: np.ndarray, place: np.ndarray, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Number of each token among clustered words, then shapes, then the end."""
    at = np.minimum(np.searchsorted(held, h), max(0, len(held) - 1))
    known = held[at] == h if len(held) else np.zeros(len(h), bool)
    m = len(held)
    return np.where(h == END, m + SHAPES, np.where(known, place[at] if m else 0, m + shape))


def _bigrams(batches, held: np.ndarray, place: np.ndarray):
    """Counts of neighbouring symbols; a document's first word follows an end."""
    size = len(held) + SHAPES + 1
    sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    n = 0

    def merged():
        codes, counts = np.unique(np.concatenate(waiting), return_counts=True)
        keys, back = np.unique(np.concatenate([sums[0], codes]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([sums[1], counts]), len(keys)).astype(np.int64)

    for b in batches:
        for _, h, shape, _ in _tokens(b.column(0)):
            s = _symbols(held, place, h, shape)
            before = np.concatenate([[size - 1], s[:-1]])
            waiting.append(before * size + s)
            n += len(s)
            if n > BUFFER:
                sums, waiting, n = merged(), [], 0
    if waiting:
        sums = merged()
    yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1])], ["code", "n"])


def _contexts(batches, held: np.ndarray, place: np.ndarray, cls: np.ndarray):
    """Partial neighbour counts (h, shape, contexts) of words outside the clustering.

    A context is count * 256 + code; codes are classes before the word, then
    classes after it. Neighbours outside the clustering count by shape.
    """
    m, k = len(held), int(cls.max()) + 1
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def batch():
        h, shape, before, after = (np.concatenate(x) for x in zip(*waiting, strict=True))
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        codes, counts = np.unique(np.concatenate([back * 256 + before, back * 256 + k + after]), return_counts=True)
        at = np.searchsorted(codes >> 8, np.arange(len(keys) + 1))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((counts << 8) | (codes & 255)))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shape[first].astype(np.int32)), lists], ["h", "shape", "contexts"])

    for b in batches:
        for _, h, shape, _ in _tokens(b.column(0)):
            s = _symbols(held, place, h, shape)
            c = cls[s]
            at = np.flatnonzero((s >= m) & (s < m + SHAPES))
            waiting.append((h[at], shape[at], np.where(at > 0, c[at - 1], k - 1), c[at + 1]))  # an end follows every text
            n += len(at)
            if n > BUFFER:
                yield batch()
                waiting, n = [], 0
    if n:
        yield batch()


def _merged(batches):
    """(h, shape, first, codes, counts) of whole words from partial contexts sorted by word; a word that goes on in the next rows is carried there merged, so its rows are never held together."""
    left = None
    for b in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
        lists = b.column(2)
        value = lists.flatten().to_numpy()
        h, shape, size = b.column(0).to_numpy(), b.column(1).to_numpy(), np.diff(lists.offsets.to_numpy())
        code, count = value & 255, value >> 8
        if left is not None:
            h, shape, size, code, count = (np.concatenate(x) for x in zip(left, (h, shape, size, code, count), strict=True))
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        word = np.repeat(np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])), size)
        keys, back = np.unique(word * 256 + code, return_inverse=True)
        count, code = np.bincount(back, count, len(keys)).astype(np.int64), keys & 255
        first = np.searchsorted(keys >> 8, np.arange(len(begin)))
        h, shape, last = h[begin], np.minimum.reduceat(shape, begin), first[-1]
        left = h[-1:], shape[-1:], np.array([len(keys) - last]), code[last:], count[last:]
        if len(h) > 1:
            yield h[:-1], shape[:-1], first[:-1], code[:last], count[:last]
    if left is not None:
        yield left[0], left[1], np.zeros(1, np.int64), left[3], left[4]


def _placed(batches, g: np.ndarray, classes: int):
    """The class (h, shape, n, class) of each word whose move there raises the likelihood most, from its contexts."""
    k = len(g)
    around = np.concatenate([g[:, :classes], g[:classes].T])  # by code
    own, rows, columns = xlogx(around), g.sum(axis=1)[:classes], g.sum(axis=0)[:classes]
    for h, shape, first, code, count in _merged(batches):
        n = np.add.reduceat(np.where(code < k, count, 0), first)[:, None]
        gain = np.add.reduceat(xlogx(around[code] + count[:, None]) - own[code], first)
        gain -= xlogx(rows + n) - xlogx(rows) + xlogx(columns + n) - xlogx(columns)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(shape), pa.array(n[:, 0]), pa.array(gain.argmax(axis=1).astype(np.int32))], ["h", "shape", "n", "class"])


def learn_words(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """A model without transitions, the table (h, shape, n) of every word's count and (h, shape, n, class) of every word's class."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = scratch.cut(text.mapInArrow(_count, "h long, shape int, n long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")), "counts")
    end = int(END.view(np.int64))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("h") != end).orderBy(F.desc("n"), "h").limit(CLUSTERED).toArrow()
    hashes = top.column("h").to_numpy().view(np.uint64)
    m = len(hashes)
    ranked = np.argsort(hashes)
    clustered, place = hashes[ranked], ranked
    size = m + SHAPES + 1
    shared = spark.sparkContext.broadcast((clustered, place))
    sums = text.mapInArrow(lambda it: _bigrams(it, *shared.value), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    matrix = np.zeros(size * size)
    matrix[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    matrix = matrix.reshape(size, size)
    classes = min(CLASSES, max(1, m))
    cls = exchange(matrix, m, classes, SWEEPS)
    k = int(cls.max()) + 1
    member = np.zeros((size, k))
    member[np.arange(size), cls] = 1
    shared_classes = spark.sparkContext.broadcast((clustered, place, cls, member.T @ matrix @ member))
    contexts = text.mapInArrow(lambda it: words.lean(_contexts(it, *shared_classes.value[:3])), "h long, shape int, contexts array<long>")
    contexts = contexts.repartition("h").sortWithinPartitions("h")
    schema = "h long, shape int, n long, class int"
    further = contexts.mapInArrow(lambda it: words.lean(_placed(it, shared_classes.value[3], classes)), schema)
    own = [(int(h), int(s), int(c), int(a)) for h, s, c, a in zip(hashes.view(np.int64), top.column("shape").to_numpy(), top.column("n").to_numpy(), cls, strict=False)]
    learnt = scratch.cut(further.unionByName(spark.createDataFrame(own, schema)), "classes")
    # absolute discounting inside every class; what it takes goes to the shapes of the words it takes from
    first = k - SHAPES - 1
    total, seen, once, twice = np.zeros(k), np.zeros((k, SHAPES)), np.zeros(k), np.zeros(k)
    for r in learnt.groupBy("class", "shape").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():  # CLASSES * SHAPES rows
        total[r["class"]] += r["n"]
        seen[r["class"], r["shape"]] += r["v"]
        once[r["class"]] += r["n1"]
        twice[r["class"]] += r["n2"]
    discount = np.where(total > 0, np.where(once > 0, np.clip(once / np.maximum(1, once + 2 * twice), 0.1, 0.9), 0.5), 0)
    class_tokens = np.where(total > 0, total - discount * seen.sum(axis=1), 1.0)
    unseen = np.where(total > 0, -np.inf, 0.0)
    unseen[-1] = -np.inf
    passed = np.eye(k)
    taken = discount[:, None] * seen / np.maximum(1, total)[:, None]
    passed[:, first : first + SHAPES] += taken
    passed[np.arange(k), np.arange(k)] -= taken.sum(axis=1)
    held = learnt.orderBy(F.desc("n"), "h").limit(HELD).toArrow()
    hashes = held.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Model(int(n), int(v), hashes[order], held.column("n").to_numpy()[order], held.column("class").to_numpy()[order], np.zeros((k, k)), class_tokens, discount, unseen, passed), counts, learnt


def transitions(model: Model, coded: DataFrame) -> None:
    """Sets the model's transitions from the classes of the texts in ``coded`` that it learns from."""
    k = len(model.passed)
    sums = coded.where("learn").select("codes").mapInArrow(lambda it: _class_bigrams(it, k), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most k * k rows
    matrix = np.zeros(k * k)
    matrix[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    g = model.passed.T @ matrix.reshape(k, k) @ model.passed
    columns, rows = g.sum(axis=0), g.sum(axis=1)
    common = (columns + 0.5) / (columns.sum() + 0.5 * k)
    follow = (g > 0).sum(axis=1)
    # Witten-Bell: a history trusts its own counts by how few followers it has
    trust = np.where(rows > 0, rows / np.maximum(1, rows + follow), 0)
    model.transition = np.log10(trust[:, None] * g / np.where(rows > 0, rows, 1)[:, None] + (1 - trust)[:, None] * common)


def train(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the table (h, shape, n) of every word's count.

    Null texts count as empty: an end alone. No rows: a model without words,
    under which every token is unseen.
    """
    model, counts, learnt = learn_words(docs, scratch, text_col)
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(True).alias("learn"))
    transitions(model, coded_texts(rows, model, learnt, 0, scratch))
    return model, counts


def _class_bigrams(batches, k: int):
    """Counts of neighbouring classes; a text's first word follows an end."""
    sums = np.zeros(k * k, np.int64)
    for b in batches:
        codes, at = words.buffers(b.column(0))
        c = codes[at[0] : at[-1]].astype(np.int64)  # each text ends in an end
        if len(c):
            sums += np.bincount(np.concatenate([[k - 1], c[:-1]]) * k + c, minlength=k * k)
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["code", "n"])


_HELD_PART = "row long, id long, learn boolean, n_known long, base double, emission double, codes binary, rest array<long>"
_CODED = "id long, learn boolean, n_known long, base double, emission double, codes binary"


def _emissions(model: Model, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(count - model.discount[cls], 1e-9)) - np.log10(model.class_tokens[cls])


def _binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _held_part(batches, model: Model, end_count: int):
    """Classes of each text's tokens and sums over the held ones; words not held are coded by shape and listed in order."""
    first = len(model.passed) - SHAPES - 1
    row = TaskContext.get().partitionId() << 33
    end_base = np.log10(end_count + 0.5) - model.base_log
    names = [x.split()[0] for x in _HELD_PART.split(", ")]
    for b in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
        n = b.num_rows
        size, known, base, emission, rest_at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        codes, rest = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)]
        for lo, h, shape, at in _tokens(b.column(1)):
            rows = len(at) - 1
            end = h == END
            found, count, cls = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.where(end, first + SHAPES, first + shape)
            if len(model.held):
                place = np.minimum(np.searchsorted(model.held, h), len(model.held) - 1)
                found = (model.held[place] == h) & ~end
                count = np.where(found, model.held_count[place], 0)
                cls = np.where(found, model.held_class[place], cls)
            part = slice(lo, lo + rows)
            size[part] = np.diff(at)
            known[part] = np.add.reduceat((found | (end & (end_count > 0))).astype(np.int64), at[:-1])
            base[part] = np.add.reduceat(np.where(found, np.log10(count + 0.5) - model.base_log, np.where(end, end_base, 0.0)), at[:-1])
            emission[part] = np.add.reduceat(np.where(found, _emissions(model, count, cls), 0.0), at[:-1])
            other = ~found & ~end
            codes.append(cls.astype(np.uint8))
            rest.append(h[other])
            rest_at[part] = np.add.reduceat(other.astype(np.int64), at[:-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest_at)]).astype(np.int32)), pa.array(np.concatenate(rest).view(np.int64)))
        texts = _binaries(np.concatenate(codes), np.concatenate([[0], np.cumsum(size)]))
        yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), b.column(0), b.column(2), pa.array(known), pa.array(base), pa.array(emission), texts, lists], names)
        row += n


def _completed(batches, model: Model):
    """Texts with the classes and sums of the words that no executor holds; ``more`` has those that were learnt."""
    first = len(model.passed) - SHAPES - 1
    names = [x.split()[0] for x in _CODED.split(", ")]
    for b in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
        known, base, emission = (b.column(x).to_numpy(zero_copy_only=False).copy() for x in ("n_known", "base", "emission"))
        data, at = words.buffers(b.column("codes"))
        data = data[at[0] : at[-1]].copy()
        at = at - at[0]
        rest, more = b.column("rest"), b.column("more").fill_null([])
        h, h_at = rest.flatten().to_numpy(), rest.offsets.to_numpy() - rest.offsets[0].as_py()
        learnt, learnt_at = more.flatten(), more.offsets.to_numpy() - more.offsets[0].as_py()
        word, cls, n = (learnt.field(x).to_numpy(zero_copy_only=False) for x in ("h", "class", "n"))
        for r in np.flatnonzero(np.diff(h_at)):
            text, own = data[at[r] : at[r + 1]], h[h_at[r] : h_at[r + 1]]
            mine = slice(learnt_at[r], learnt_at[r + 1])
            order = np.argsort(word[mine])
            w, c, k = word[mine][order], cls[mine][order], n[mine][order]
            found, count = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
            if len(w):
                place = np.minimum(np.searchsorted(w, own), len(w) - 1)
                found = w[place] == own
                count = np.where(found, k[place], 0)
                where = np.flatnonzero((text >= first) & (text < first + SHAPES))[found]
                text[where] = c[place][found]
                emission[r] += _emissions(model, count[found], c[place][found]).sum()
            known[r] += found.sum()
            base[r] += (np.log10(count + 0.5) - model.base_log).sum()
            missing = text[(text >= first) & (text < first + SHAPES)]
            emission[r] += model.unseen[missing].sum()
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("learn"), pa.array(known), pa.array(base), pa.array(emission), _binaries(data, at)], names)


def coded_texts(rows: DataFrame, model: Model, learnt: DataFrame, end_count: int, scratch: Scratch) -> DataFrame:
    """The class of every token of ``rows`` (id, text, learn) as a byte, with the sums that don't depend on transitions."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    part = scratch.cut(rows.mapInArrow(lambda it: words.lean(_held_part(it, shared.value, end_count)), _HELD_PART), "held_part")
    rest = part.select("row", F.explode(F.array_distinct("rest")).alias("h")).join(learnt.select("h", "class", "n"), "h")
    more = rest.groupBy("row").agg(F.collect_list(F.struct("h", "class", "n")).alias("more"))
    return scratch.cut(part.join(more, "row", "left").drop("row").mapInArrow(lambda it: words.lean(_completed(it, shared.value)), _CODED), "coded")


_SCORED = "id long, n_tokens long, n_known long, base double, score double"


def _score(batches, transition: np.ndarray):
    end = len(transition) - 1
    names = [x.split()[0] for x in _SCORED.split(", ")]
    for b in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
        data, at = words.buffers(b.column("codes"))
        c = data[at[0] : at[-1]]
        at = at - at[0]
        before = np.concatenate([[end], c[:-1]])
        step = np.add.reduceat(transition[before, c], at[:-1])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at)), b.column("n_known"), b.column("base"), pa.array(step + b.column("emission").to_numpy(zero_copy_only=False))], names)


def score_documents(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probabilities of every whole text: (id, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    The model learns from the rows where ``learn`` holds (all, if None); a null
    condition counts as true. base_score is that of add-half unigrams. Words
    never seen in training are one event, in both. perplexity is per token.

    Null and empty texts: an end alone. Null ids and repeated rows: scored like
    any other. Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    learns = F.lit(True) if learn is None else F.coalesce(learn, F.lit(True))
    model, counts, learnt = learn_words(docs.where(learns), scratch, text_col)
    end = counts.where(F.col("h") == int(END.view(np.int64))).first()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), learns.alias("learn"))
    coded = coded_texts(rows, model, learnt, end["n"] if end else 0, scratch)
    transitions(model, coded)
    shared = spark.sparkContext.broadcast(model.transition)
    scored = coded.mapInArrow(lambda it: _score(it, shared.value), _SCORED)
    out = scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
