import collections
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mixing as m
from tessera.llm.feistel import permute, permute_one

SCHEMA = "doc_id long, text string, source string, n_chars long, size int, block string"


def rows(n=400):
    out = []
    for k in range(n):
        words = k * 37 % 90
        out.append((k, "\n ".join(f"d{k}w{j}" for j in range(words)), "hot" if k % 3 == 0 else f"s{k % 7}" if k % 11 else None, 0, 0, ""))
    return out


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2 * sizes[s] for s in over}


def test_targets_and_limits(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = m.taken(m.mix_sources(df)).collect()
    assert len(out) == len(data)
    size = {r[0]: len(r[1].split()) for r in data}
    sizes = collections.Counter()
    for r in data:
        sizes[r[2]] += size[r[0]]
    want, got = plain_targets(sizes), collections.Counter()
    source = {r[0]: r[2] for r in data}
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[source[r["doc_id"]]] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 1.5 * m.BLOCK for s in want)
    again = m.taken(m.mix_sources(df.repartition(7))).collect()
    assert sorted(again) == sorted(out)


def test_slots_fill_shards_evenly(spark):
    mixture = m.mix_sources(spark.createDataFrame(rows(), SCHEMA), shards=8)
    slots = mixture.slots.collect()
    per = collections.Counter(r["shard"] for r in slots)
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 1
    uses = collections.Counter((r["source_id"], r["block"]) for r in slots)
    assert max(uses.values()) <= 2
    for s in mixture.sources.collect():
        own = [uses[s["source_id"], b] for b in range(s["blocks"])]
        assert sum(own) == s["slots"] and (not own or max(own) - min(own) <= 1)


def test_mixed_documents_hold_what_is_taken(spark):
    data = [*rows(), (3, rows()[3][1], "s1", 0, 0, ""), (3, rows()[3][1], "s1", 0, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    taken = m.taken(m.mix_sources(df)).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
    out = m.mixed_documents(df)
    assert out.columns == df.columns
    got = collections.Counter()
    original = {r[0]: r[1].split() for r in data}
    for r in out.collect():
        words = r["text"].split()
        got[r["doc_id"]] += len(words)
        assert set(words) <= set(original[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        assert max(collections.Counter(words).values()) <= 2
    assert got == {r["doc_id"]: r["n"] for r in taken.collect()}


def test_texts_are_cut_without_workers(spark):
    texts = ["  a\tb\xa0c \n\n" * 90, "\u3000x y\x0bz\x1cq " * 70, "é 日本 語\r\n𝒳 w" * 50, "one", " \n ", None, "\x85k\x0c l" * 40]
    df = spark.createDataFrame([(k, t, "pq"[k % 2], 0, 0, "") for k, t in enumerate(texts * 3)], SCHEMA)
    mixture, out = m.mix_sources(df), m.mixed_documents(df)
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    whole = {k: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", (t or "").strip(" \t\n\v\f\r")) for k, t in enumerate(texts * 3)}
    wanted, ids = collections.defaultdict(lambda: collections.defaultdict(list)), set()
    for r in mixture.pieces.orderBy("id", "block").collect():
        ids.add(r["id"])
        first = max(r["start"], r["block"] * m.BLOCK) - r["start"]
        for again in range(r["uses"]):
            wanted[r["id"]][again] += whole[r["id"]][first : first + r["words"]]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got.keys() == ids and len(got) > 10
    for k, passes in wanted.items():
        parts = ["".join(passes[again]) for again in sorted(passes)]
        assert got[k] == "".join(p if p[-1] in " \t\n\v\f\r" else p + " " for p in parts).strip(" \t\n\v\f\r")


def test_odd_rows(spark):
    data = [(None, "a b", None, 0, 0, ""), (1, None, "x", 0, 0, ""), (2, " \n", "y", 0, 0, ""), (3, "one", "x", 0, 0, ""), (3, "one", "x", 0, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    out = m.taken(m.mix_sources(df)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert m.mixed_documents(df).count() <= 3
    assert m.taken(m.mix_sources(df.limit(0))).count() == 0
    assert m.mixed_documents(df.limit(0)).count() == 0


def test_long_texts_are_taken_whole(spark):
    data = [(1, " ".join(f"w{k}" for k in range(50_000)), "a", 0, 0, ""), (2, "b " * 40_000, "b", 0, 0, "")]
    out = {r["doc_id"]: r for r in m.taken(m.mix_sources(spark.createDataFrame(data, SCHEMA))).collect()}
    assert all(abs(r["taken"] - r["target"]) <= m.BLOCK for r in out.values())


def test_permutations():
    for n in (1, 2, 3, 10, 257, 1000):
        for key in (0, -5, 99):
            image = permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(image.tolist()) == list(range(n))
            assert sorted(permute_one(k, n, b"k", bytes([n % 7])) for k in range(n)) == list(range(n))
    assert permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)).tolist()
