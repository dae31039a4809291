"""Toxicity: a convolutional text classifier over hashed word embeddings.

Every word has two buckets, so two words share both only rarely; the rows of
the buckets, side by side, are its embedding. Filters of several widths slide
over the whole text, max pooling keeps each filter's best place, and a logistic
layer gives the score. Trained in numpy on the driver from a bounded sample of
labelled rows; thresholds are calibrated by language on every usable labelled
row that it wasn't trained on, scored by executors.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.sources.scratch import BROADCAST, Scratch

BUCKETS, HALF = 1 << 16, 8
WIDTHS, FILTERS = (1, 2, 3), 8
#: Labelled rows of each class that are learnt from, at most.
POSITIVES, NEGATIVES = 3000, 6000
#: Bytes of their words that the driver gets, four a word, at most: rows that would exceed it are not in the sample.
BYTES = 1 << 26
#: One sampled row in this many isn't trained on; these and all rows outside the sample calibrate thresholds.
CALIBRATION = 6
#: A language gets its own threshold from this many positive rows on.
ENOUGH = 20
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.05, 1e-4
#: Words of a text scored at once.
PIECE = 1 << 15


def buckets(h: np.ndarray) -> np.ndarray:
    """The two bucket numbers of each word hash."""
    return np.stack([(h >> np.uint64(48)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(BUCKETS - 1)).astype(np.int64)], axis=1)


@dataclass
class Model:
    embed: np.ndarray  # 2 x BUCKETS x HALF
    filters: dict[int, np.ndarray]  # width -> width x 2 x HALF x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def tables(self) -> list[np.ndarray]:
        """Each bucket's share in each filter at each place of its window, for scoring by lookup."""
        return [np.concatenate([self.embed[k] @ f[o, k] for f in self.filters.values() for o in range(len(f))], axis=1) for k in range(2)]

    def pooled(self, tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Highest response of every filter in one text; windows that overrun its end see zeros."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        reach = max(WIDTHS) - 1
        for lo in range(0, max(1, len(ids)), PIECE):
            part = ids[lo : lo + PIECE + reach]
            own = min(PIECE, max(1, len(ids) - lo))
            share = np.zeros((own + reach, tables[0].shape[1]), np.float32)
            if len(part):
                share[: len(part)] = tables[0][part[:, 0]]
                share[: len(part)] += tables[1][part[:, 1]]
            at = 0
            for n, w in enumerate(self.filters):
                total = share[:own, at : at + FILTERS]
                for o in range(1, w):
                    total = total + share[o : o + own, at + o * FILTERS : at + (o + 1) * FILTERS]
                at += w * FILTERS
                span = slice(n * FILTERS, (n + 1) * FILTERS)
                best[span] = np.maximum(best[span], total.max(axis=0))
        return best

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, column: pa.Array) -> np.ndarray:
        tables = self.__dict__.get("_tables") or self.tables()
        self.__dict__["_tables"] = tables
        best = np.zeros((len(column), len(WIDTHS) * FILTERS), np.float32)
        for r, h in words.texts(column, words.PLAIN):
            best[r] = self.pooled(tables, buckets(h))
        return self.score(best).astype(np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def _start(docs: list[np.ndarray], y: np.ndarray, rng) -> Model:
    """Random weights, but for the first dimension: each bucket's smoothed log odds, which width-1 filters read."""
    embed = rng.normal(0, 0.05, (2, BUCKETS, HALF)).astype(np.float32)
    for k in range(2):
        seen = np.zeros((2, BUCKETS))
        for ids, label in zip(docs, y, strict=True):
            seen[label, np.unique(ids[:, k])] += 1
        rate = (seen + 4 * seen.sum(axis=1, keepdims=True) / max(1.0, seen.sum())) / max(1.0, seen.sum())
        rate = np.maximum(rate, 1e-12)
        odds = np.log(rate[1] / rate[0]) - np.log(max(1e-9, seen[1].sum()) / max(1e-9, seen[0].sum()))
        embed[k, :, 0] = np.clip(odds, -1, 4) / 2
    filters = {w: rng.normal(0, 0.2, (w, 2, HALF, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][0, :, 0, :] += 0.5
    n = len(WIDTHS) * FILTERS
    return Model(embed, filters, np.full(n, -0.5, np.float32), np.full(n, 1 / n, np.float32), -1.0)


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model:
    """Trains on bucket numbers of whole texts by stochastic gradients (Adagrad)."""
    rng = np.random.default_rng(seed)
    m = _start(docs, y, rng)
    memory = {"embed": np.full(m.embed.shape, 1e-3, np.float32), "bias": np.full(m.bias.shape, 1e-3), "out": np.full(m.out.shape, 1e-3), "offset": 1e-3} | {w: np.full(f.shape, 1e-3, np.float32) for w, f in m.filters.items()}
    reach = max(WIDTHS) - 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            pooled = np.zeros((len(batch), len(WIDTHS) * FILTERS), np.float32)
            places, vectors = [], []
            for r, d in enumerate(batch):
                ids = docs[d]
                x = np.zeros((len(ids) + max(1, reach), 2 * HALF), np.float32)
                if len(ids):
                    x[: len(ids), :HALF], x[: len(ids), HALF:] = m.embed[0, ids[:, 0]], m.embed[1, ids[:, 1]]
                where = []
                own = max(1, len(ids))
                for k, w in enumerate(WIDTHS):
                    f = m.filters[w].reshape(w, 2 * HALF, FILTERS)
                    total = sum(x[o : o + own] @ f[o] for o in range(w))
                    top = total.argmax(axis=0)
                    pooled[r, k * FILTERS : (k + 1) * FILTERS] = total[top, np.arange(FILTERS)]
                    where.append(top)
                places.append(where)
                vectors.append(x)
            active = pooled + m.bias
            hidden = np.maximum(active, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ m.out + m.offset, -30, 30))) - y[batch]) / len(batch)
            back = (error[:, None] * m.out) * (active > 0)
            grads = {w: np.zeros_like(f) for w, f in m.filters.items()}
            touched: list[tuple[int, np.ndarray, np.ndarray]] = []
            for r, d in enumerate(batch):
                ids = docs[d]
                for k, w in enumerate(WIDTHS):
                    g = back[r, k * FILTERS : (k + 1) * FILTERS]
                    if not g.any():
                        continue
                    for o in range(w):
                        at = places[r][k] + o
                        grads[w][o] += (vectors[r][at] * g[:, None]).T.reshape(2, HALF, FILTERS)
                        inside = at < len(ids)
                        if inside.any():
                            for s in range(2):
                                touched.append((s, ids[at[inside], s], (m.filters[w][o, s] * g).T[inside]))
            for w, g in grads.items():
                g += DECAY * m.filters[w]
                memory[w] += g * g
                m.filters[w] -= RATE * g / np.sqrt(memory[w])
            for s in range(2):
                own = [(i, g) for t, i, g in touched if t == s]
                if own:
                    rows, back_at = np.unique(np.concatenate([i for i, _ in own]), return_inverse=True)
                    g = np.zeros((len(rows), HALF), np.float32)
                    np.add.at(g, back_at, np.concatenate([g for _, g in own]))
                    g += DECAY * m.embed[s, rows]
                    memory["embed"][s, rows] += g * g
                    m.embed[s, rows] -= RATE * g / np.sqrt(memory["embed"][s, rows])
            for name, g in (("bias", back.sum(axis=0)), ("out", hidden.T @ error + DECAY * m.out), ("offset", error.sum())):
                memory[name] = memory[name] + g * g
                setattr(m, name, getattr(m, name) - RATE * g / np.sqrt(memory[name]))
    return m


#: Thresholds that calibration chooses from.
GRID = np.linspace(0.3, 0.9, 61)


def best_threshold(held: np.ndarray, total: np.ndarray) -> float:
    """The threshold of GRID with the highest F1; of equals, the one nearest to 0.5.

    ``held`` has, for each label, the number of calibration rows that reach so
    many thresholds; ``total`` all labelled rows, those trained on too. Each
    label's rows count by its share of ``total``: training takes a larger part
    of the rarer label, so the rows that are left have another ratio.
    """
    weight = total / np.maximum(1, held.sum(axis=1))
    above = weight[:, None] * held[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + total[1])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(GRID[top[np.abs(GRID[top] - 0.5).argmin()]])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, most: int = BYTES) -> Model:
    """A model of label 1, from labelled rows whose id is ``usable``.

    Of each class the rows whose ids hash lowest are read, at most
    ``positives`` and ``negatives`` and together ``most`` bytes, whole texts
    only, and most are trained on; the others are scored by executors, and
    counts by language, label and threshold choose the thresholds. Null labels
    and ids are skipped, of several labels of an id the highest counts, labels
    without a document are skipped. No labelled rows: a model that scores
    everything near 0.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    named = named if usable is None else named.where(usable)
    named, found = scratch.measured(named.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y")), "labels", n=F.count("*"))
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("id", F.lit(17))
    chosen = [named.where(F.col("y") == k).orderBy(order, "id").limit(n) for k, n in ((1, positives), (0, negatives))]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # positives + negatives rows at most
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    rows = scratch.cut(texts.join(picked, "id").mapInArrow(lambda it: words.lean(_bucketed(it)), "id long, y int, ids binary").distinct(), "sample")
    # repeated ids have several texts; the sample's order is that of the hashes, so rows left out are any rows
    size = rows.groupBy("id", "y").agg(F.sum(F.octet_length("ids") + 64).alias("size")).orderBy(order, "id").collect()  # positives + negatives rows at most
    held, fits = 0, []
    for r in size:
        if held + r["size"] <= most:
            held += r["size"]
            fits.append((r["id"],))
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "id long")), "id", "left_semi").select("id", "y", "ids").orderBy("id", "ids").toArrow()
    ids = [np.frombuffer(b.as_buffer(), np.uint16).reshape(-1, 2) for b in chosen.column("ids")]
    y, doc_ids = chosen.column("y").to_numpy().astype(np.int64), chosen.column("id").to_numpy()
    scratch.free(rows)
    apart = np.zeros(len(y), bool)
    for k in (0, 1):  # both classes are needed on either side; rows of one id stay on one
        apart |= np.isin(doc_ids, np.unique(doc_ids[y == k])[CALIBRATION - 1 :: CALIBRATION])
    model = fit([d for d, c in zip(ids, apart, strict=True) if not c], y[~apart])
    del chosen, ids
    words.release()
    if not len(y) or not y.any():
        model.offset = -10.0
        return model
    sampled, whole = (y == 1).sum() / max(1, (y == 0).sum()), counts.get(1, 0) / max(1, counts.get(0, 0))
    if (y == 0).any() and counts.get(0):
        model.offset += float(np.log(whole / sampled))  # the sample's share of positives isn't the corpus's
    shared = docs.sparkSession.sparkContext.broadcast((model, np.unique(doc_ids[~apart])))
    able = texts.where(F.col("id").isNotNull())
    if found["n"] <= BROADCAST:  # else texts would be shuffled to their labels, which costs more than scoring those without
        able = able.join(F.broadcast(named.select("id")), "id", "left_semi")
    reached = able.mapInArrow(lambda it: words.lean(_reached(it, *shared.value)), "id long, lang string, reached int")
    found = reached.join(named, "id").groupBy("lang", "y", "reached").agg(F.count("*").alias("n")).collect()  # languages x 2 x 63 rows
    shared.destroy()  # Python workers stay, and would keep the model and its tables
    held, total = defaultdict(lambda: np.zeros((2, len(GRID) + 1))), defaultdict(lambda: np.zeros(2))
    for r in found:
        for name in {None, r["lang"] or None}:  # None: all languages
            total[name][r["y"]] += r["n"]
            if r["reached"] >= 0:
                held[name][r["y"], r["reached"]] += r["n"]
    if held[None][1].any():
        model.threshold = best_threshold(held[None], total[None])
    for name in sorted(filter(None, held)):
        if held[name][1].sum() >= ENOUGH:
            model.thresholds[name] = best_threshold(held[name], total[name])
    return model


def _reached(batches, model: Model, trained: np.ndarray):
    """How many thresholds of GRID each text's score reaches; -1 for texts that the model was trained on."""
    for b in words.slices(batches):
        new = ~np.isin(b.column("id").to_numpy(), trained)
        reached = np.full(b.num_rows, -1, np.int32)
        reached[new] = np.searchsorted(GRID, model.scores(b.column("text").filter(pa.array(new))), side="right")
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(reached)], ["id", "lang", "reached"])


def _bucketed(batches):
    for batch in words.slices(batches):
        ids = [b""] * batch.num_rows
        for r, h in words.texts(batch.column("text"), words.PLAIN):
            ids[r] = buckets(h).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(ids, pa.binary())], ["id", "y", "ids"])


def scorer(spark, model: Model):
    """An Arrow UDF: the score of each whole text, 0 to 1. Null and empty texts get the score of no words."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = pa.array(shared.value.scores(text), pa.float64())
        words.release()
        return out

    return score


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a language; the common one for null and rare languages."""
    if not model.thresholds:
        return F.lit(model.threshold)
    known = F.create_map(*(F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv))
    return F.coalesce(F.try_element_at(known, F.coalesce(lang.cast("string"), F.lit(""))), F.lit(model.threshold))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that score at or above their language's threshold; all columns stay.

    Null and empty texts, null languages, repeated rows and null ids are
    scored like any other row; an empty table gives no rows.
    """
    score = scorer(docs.sparkSession, model)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    return docs.where(score(F.col(text_col).cast("string")) < threshold(model, lang))
