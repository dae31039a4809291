import collections
import random
import zlib

import numpy as np

from tessera.llm import sharding as s

SCHEMA = "doc_id long, text string, shard int, slot string, bytes int"


def rows(n=1500, hot=0.3):
    rng = random.Random(2)
    out = []
    for k in range(n):
        text = "the hot text é" if rng.random() < hot else f"t{rng.randrange(n)} " + "word " * int(rng.paretovariate(1.2) * 20 % 2000)
        out.append((k, text, 0, "", 0))
    return out


def test_shards_are_balanced(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    out = s.assign_shards(df).collect()
    text = {r[0]: r[1] for r in data}
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    sizes, slots, words, shards = collections.Counter(), collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in out:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        words[r["shard"]] += len(t.split())
        slots[r["shard"]].append(r["slot"])
        shards[t].add(r["shard"])
    assert set(sizes) == set(range(24))
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    assert max(words.values()) <= 1.25 * min(words.values())
    rows_ = [len(v) for v in slots.values()]
    assert max(rows_) <= 1.5 * min(rows_)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len(v) > 1 for v in shards.values()) == 1  # only the hot group is split
    assert sorted(s.assign_shards(df.repartition(2)).collect()) == sorted(out)


def test_odd_rows(spark):
    data = [(None, "a", 0, "", 0), (1, None, 0, "", 0), (2, "", 0, "", 0), (3, "x" * 300_000, 0, "", 0), (3, "x" * 300_000, 0, "", 0), (4, "é", 0, "", 0)]
    out = s.assign_shards(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(r["size"] for r in out) == [8, 8, 9, 10, 300_008, 300_008]
    assert {r["text_crc32"] for r in out if r["size"] == 8} == {0}
    assert s.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_written_shards(spark, tmp_path):
    data = rows(200)
    df = spark.createDataFrame(data, SCHEMA)
    s.write_shards(df, f"file://{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((r[0], r[1]) for r in data)


def test_place_fills_unequal_items():
    rng = np.random.default_rng(1)
    items = np.stack([rng.pareto(1.5, 500) + 1, rng.random(500), np.ones(500)], axis=1)
    share, left = items / items.sum(axis=0) * 10, np.ones((10, 3))
    at = s.even(share, s.place(share, left), left)
    total = np.bincount(at, items[:, 0], 10)
    assert total.max() <= max(1.02 * total.mean(), items[:, 0].max())
    assert np.allclose(left, 1 - np.stack([np.bincount(at, share[:, d], 10) for d in range(3)], axis=1))


def test_place_takes_the_highest_dot_product():
    rng = np.random.default_rng(5)
    share, left = rng.random((60, 3)) / 12, np.ones((6, 3))
    at = s.place(share, left)
    room = np.ones((6, 3))
    for k in sorted(range(60), key=lambda k: (-share[k].max(), -share[k].sum(), k)):
        open_ = [q for q in range(6) if (room[q] >= share[k] - 1e-12).all()]
        best = max(open_, key=lambda q: (room[q] @ share[k], -q)) if open_ else max(range(6), key=lambda q: ((room[q] - share[k]).min(), -q))
        assert at[k] == best
        room[best] -= share[k]


def test_small_groups_are_placed_one_by_one_in_cells(spark, monkeypatch):
    """Few groups are kept back and cells are small, as in a table with many groups."""
    monkeypatch.setattr(s, "LATE", 150)
    monkeypatch.setattr(s, "CELL", 300)
    monkeypatch.setattr(s, "ALONE", 32)
    data = rows(4000)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = s.assign_shards(df, shards=5).collect()
    text = {r[0]: r[1] for r in data}
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    shards, sizes, counts = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in out:
        shards[text[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert sum(len(v) > 1 for v in shards.values()) == 1
    assert max(sizes.values()) <= 1.01 * min(sizes.values()) and max(counts.values()) <= 1.1 * min(counts.values())
    assert sorted(s.assign_shards(df.repartition(2), shards=5).collect()) == sorted(out)
