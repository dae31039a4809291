import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import class_lm as lm

SCHEMA = "doc_id long, text string, score string, n int"


def texts(n=300):
    """Sentences that alternate between two kinds of words, which classes can learn."""
    rng = random.Random(6)
    out = []
    for k in range(n):
        words = []
        for j in range(rng.randrange(0, 60)):
            words.append(f"{'ab'[j % 2]}{int(rng.paretovariate(0.9)) % 400}" + (rng.choice(["", "", ".", ","])))
        out.append((k, ("\n" if k % 2 else " ").join(words).upper() if k % 3 else " ".join(words), "", 0))
    return out


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_counts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 40)
    monkeypatch.setattr(lm, "CLUSTERED", 30)
    monkeypatch.setattr(lm, "CLASSES", 6)
    data = texts()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    out = {r["doc_id"]: r for r in lm.score_documents(df, learn=fold != 1).collect()}
    assert len(out) == len(data)
    count = collections.Counter()
    held = {k for k, *_ in data if zlib.crc32(str(k).encode()) % 5 == 1}
    for k, t, *_ in data:
        if k not in held:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    for k, t, *_ in data:
        own, r = tokens(t), out[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), abs=1e-6)
        assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(own)))
    assert sum(out[k]["score"] for k in held) > sum(out[k]["base_score"] for k in held)


def test_probabilities_add_up(spark, monkeypatch):
    """Over every word and the unseen event, after any history, the model sums to one or slightly less."""
    monkeypatch.setattr(lm, "CLUSTERED", 30)
    monkeypatch.setattr(lm, "CLASSES", 6)
    from tessera.llm import words
    from tessera.sources.scratch import Scratch

    data = texts(120)
    model, counts = lm.train(spark.createDataFrame(data, SCHEMA), Scratch(spark, "test"))
    first = len(model.transition) - lm.SHAPES - 1
    emission = np.zeros(len(model.transition))
    emission[-1] = 1
    cls = {int(h): int(c) for h, c in zip(model.held.view(np.int64), model.held_class, strict=True)}
    for r in counts.collect():
        if r["h"] != int(lm.END.view(np.int64)):
            c = cls[r["h"]] if cls[r["h"]] >= 0 else first + r["shape"]
            emission[c] += (r["n"] - model.discount[c]) / model.class_tokens[c]
    emission += 10.0**model.unseen
    assert emission == pytest.approx(np.ones(len(emission)), abs=1e-9)
    assert (10.0**model.transition).sum(axis=1) == pytest.approx(np.ones(len(emission)), abs=1e-9)


def test_exchange_finds_the_two_kinds():
    bigrams = np.zeros((9, 9))
    for a in range(8):
        for b in range(8):
            bigrams[a, b] = 20 + a if a % 2 != b % 2 else 1
    cls = lm.exchange(bigrams, 8, 2, 10)
    assert len({cls[k] for k in range(0, 8, 2)}) == len({cls[k] for k in range(1, 8, 2)}) == 1
    assert cls[0] != cls[1] and cls[8] == 2
    rng = np.random.default_rng(0)
    random_ = rng.integers(0, 9, (20, 20)).astype(float)

    def likelihood(cls):
        k = cls.max() + 1
        g = np.zeros((k, k))
        np.add.at(g, (cls[:, None].repeat(20, 1), cls[None, :].repeat(20, 0)), random_)
        x = lambda v: (v * np.log(np.maximum(v, 1e-300))).sum()
        return x(g) - x(g.sum(0)) - x(g.sum(1))

    best = lm.exchange(random_, 20, 4, 20)
    for w in range(20):  # no single move is better
        for c in range(4):
            other = best.copy()
            other[w] = c
            assert likelihood(other) <= likelihood(best) + 1e-6


def test_odd_rows(spark):
    data = [(None, "a b", "", 0), (1, None, "", 0), (2, "", "", 0), (3, "a " * 50_000, "", 0), (4, "a b", "", 0), (4, "a b", "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    out = lm.score_documents(df).collect()
    assert len(out) == 6 and {r["train_tokens"] for r in out} == {50_000 + 6 + 6}
    assert sorted(r["n_tokens"] for r in out) == [1, 1, 3, 3, 3, 50_001]
    assert lm.score_documents(df.limit(0)).count() == 0
    none = lm.score_documents(df, learn=F.lit(False)).collect()
    assert len(none) == 6 and all(r["n_known"] == 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in none)


def test_words_outside_the_clustering_have_learnt_classes(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLUSTERED", 30)
    monkeypatch.setattr(lm, "CLASSES", 2)
    from tessera.llm import words
    from tessera.sources.scratch import Scratch

    data = texts()
    model, counts = lm.train(spark.createDataFrame(data, SCHEMA), Scratch(spark, "test"))
    kind = {}
    for _, t, *_ in data:
        own = t.lower().split()
        for w, h in zip(own, next(h for _, h in words.texts(pa.array([t]))), strict=True):
            kind[int(h)] = w[0]
    cls = {int(h): int(c) for h, c in zip(model.held, model.held_class, strict=True)}
    assert len(kind) > 300 and set(kind) == set(cls) - {int(lm.END)} and set(cls.values()) <= {0, 1}
    of_a = collections.Counter(cls[h] for h, k in kind.items() if k == "a")
    of_b = collections.Counter(cls[h] for h, k in kind.items() if k == "b")
    a, b = of_a.most_common(1)[0], of_b.most_common(1)[0]
    assert a[0] != b[0] and a[1] > 0.95 * of_a.total() and b[1] > 0.95 * of_b.total()


def test_words_that_are_not_held_score_alike(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLUSTERED", 30)
    monkeypatch.setattr(lm, "CLASSES", 6)
    df = spark.createDataFrame(texts(), SCHEMA).repartition(4)
    learn = F.col("doc_id") % 5 != 1
    whole = {r["doc_id"]: r for r in lm.score_documents(df, learn=learn).collect()}
    monkeypatch.setattr(lm, "HELD", 40)
    for r in lm.score_documents(df, learn=learn).collect():
        w = whole[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (w["n_tokens"], w["n_known"])
        assert r["score"] == pytest.approx(w["score"], abs=1e-6) and r["base_score"] == pytest.approx(w["base_score"], abs=1e-6)


@pytest.mark.parametrize("rows", [1, 7, 3000])
def test_partial_contexts_of_a_word_add_up(rows):
    """A word in one row, in several, and in more than a batch holds."""
    rng = np.random.default_rng(4)
    h = np.sort(np.concatenate([np.repeat(7, rows), rng.integers(0, 20, rows)]))
    lists = [[int(c) * 256 + int(x) for x, c in zip(rng.integers(0, 9, s), rng.integers(1, 5, s), strict=True)] for s in rng.integers(1, 6, len(h))]
    want = collections.Counter()
    for w, own in zip(h.tolist(), lists, strict=True):
        for x in own:
            want[w, x & 255] += x >> 8
    table = pa.table({"h": pa.array(h), "shape": pa.array(np.zeros(len(h), np.int32)), "contexts": pa.array(lists, pa.list_(pa.int64()))})
    got, seen = collections.Counter(), []
    for own, shape, first, code, count in lm._merged(table.to_batches(max_chunksize=900)):
        seen += own.tolist()
        assert len(own) == len(shape) == len(first)
        for w, c, n in zip(np.repeat(own, np.diff([*first, len(code)])).tolist(), code.tolist(), count.tolist(), strict=True):
            assert (w, c) not in got
            got[w, c] = n
    assert got == want and seen == sorted(set(h.tolist()))
    assert list(lm._merged([])) == []
