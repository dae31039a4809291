import random

import numpy as np
import pytest
from brute import near_copies, shingles

from tessera.llm import minhash_dedup as m

SCHEMA = "doc_id long, text string, node string, bands int"


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    rows = {}
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 150)))]
        for k in range(14):
            rows[family * 100 + k] = edited(rng, base, k * len(base) // 120 + k % 3)
    base = [f"v{k}" for k in range(100)]
    for k in range(40):  # copies of copies: chains of links
        rows[5000 + k] = " ".join(base)
        base[rng.randrange(100)] = f"u{k}"
    for k in range(30):
        rows[7000 + k] = rows[100] if k % 2 else rows[100].upper() + "\n"
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_matches_all_pairs(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()], SCHEMA).repartition(3)
    out = {r["doc_id"]: r for r in m.link_documents(df, shingle_words=k).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == near_copies(rows, k)
    assert {i: r["n_shingles"] for i, r in out.items()} == {i: len(shingles(t, k)) for i, t in rows.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_odd_rows(spark):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, " \n\t", "", 0), (4, "one", "", 0), (5, "ONE\n", "", 0), (6, "one two", "", 0), (None, "one", "", 0), (7, "x", "", 0), (7, "x", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = m.link_documents(df, shingle_words=2).collect()
    assert len(out) == len(rows)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert found == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (7, 1, 7, True)}
    kept = m.keep_one(df, shingle_words=2)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "one"), (1, ""), (2, ""), (3, " \n\t"), (4, "one"), (6, "one two"), (7, "x")]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.link_documents(df).count() == 0
    assert m.keep_one(df).count() == 0


def test_posterior_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    n = m.BANDS * m.ROWS

    def pair(similarity):
        a = rng.integers(0, 256, (2000, n), np.uint8)
        b = np.where(rng.random((2000, n)) < similarity, a, rng.integers(0, 256, (2000, n), np.uint8))
        return len(m.plausible(a, b, 0.8, m.MISS))

    assert pair(0.8) == 2000
    assert pair(0.2) == 0
    assert pair(0.5) == 0


def test_long_texts_are_read_whole(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, long, "", 0), (2, long + " end", "", 0), (3, " ".join(f"w{k}" for k in range(20_000)), "", 0)]
    out = {r["doc_id"]: r["component_id"] for r in m.link_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
