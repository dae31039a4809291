import itertools
import random
import re

from tessera.llm import decontamination as d

ITEMS = "item_id long, text string, words string"
DOCS = "doc_id long, text string, item long, own string"


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """(doc, item) with an aligned window of 15 words (or the item) of which 4 in 5 agree."""
    out = set()
    for i, t in docs:
        own = tokens(t)
        for k, u in items:
            item = tokens(u)
            w = min(d.WINDOW, len(item))
            for shift in range(-len(item) + w, len(own) - w + 1):
                for at in range(max(0, -shift), min(len(item), len(own) - shift) - w + 1):
                    same = sum(own[at + shift + j] == item[at + j] for j in range(w))
                    if same * d.WINDOW >= w * d.AGREE:
                        out.add((i, k))
    return out


def test_masks_meet_any_substitutions_that_count():
    for n in range(1, d.WINDOW + 1):
        for gone in itertools.combinations(range(n), n - -(-n * d.AGREE // d.WINDOW)):
            assert any(all(at + o not in gone for o, c in enumerate(mask) if c == "1") for mask in d.masks(n) for at in range(n - len(mask) + 1))


def test_short_items_match_all_alignments(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 15)]
    docs = []
    for k in range(150):
        text = [word() for _ in range(rng.randrange(1, 30))]
        passage = items[k % len(items)][1].split()
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = word()
        at = rng.randrange(len(text))
        text[at:at] = passage if k % 3 else []
        docs.append((k, " ".join(text)))
    docs.append((900, items[5][1]))
    found = d.contaminated(spark.createDataFrame([(*r, 0, "") for r in docs], DOCS), spark.createDataFrame([(*r, "") for r in items], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items)
    assert (900, 6) in {(r["doc_id"], r["item_id"]) for r in found}


def test_positions_count_words(spark):
    item = " ".join(f"word{k}" for k in range(20))
    docs = [(1, item, 0, ""), (2, f"({item})", 0, ""), (3, f"- one two {item}!", 0, "")]
    found = d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, f'"{item}"', "")], ITEMS)).collect()
    assert {r["doc_id"]: (r["first_word"], r["last_word"]) for r in found} == {1: (0, 19), 2: (0, 19), 3: (2, 21)}


def test_a_seed_of_thousands_of_items(spark):
    shared = "these seven words stand in every item"
    items = [(k, f"{shared} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}", "") for k in range(3000)]
    docs = [(k, f"x {items[7 * k][1]} y" if k % 2 else f"{shared} alone", 0, "") for k in range(200)]
    found = d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, 7 * k) for k in range(1, 200, 2)]


def test_clashing_columns(spark):
    names = "doc_id long, text string, own long, text_hash long, item long, Own_ string"
    text = " ".join(f"word{k}" for k in range(20))
    df = spark.createDataFrame([(1, text, 5, 6, 7, "a"), (2, "clean", 5, 6, 7, "b")], names)
    kept = d.decontaminate(df, spark.createDataFrame([(1, text, "")], ITEMS))
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 5, 6, 7, "b")]


def test_matches_all_alignments(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(900)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((16, 25, 50))))) for k in range(12)]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rng.randrange(20, 80))]
        passage = items[k % 12][1].split()
        if k % 5:
            lo = rng.randrange(max(1, len(passage) - 15))
            part = passage[lo : lo + rng.randrange(10, 40)]
            for _ in range(rng.randrange(6)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((k, (", " if k % 2 else " ").join(text).upper() if k % 3 else " ".join(text)))
    want = brute(docs, items)
    assert 10 < len(want) < 60
    found = d.contaminated(spark.createDataFrame([(*r, 0, "") for r in docs], DOCS), spark.createDataFrame([(*r, "") for r in items], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert len(found) == len(want)
    assert all(0.8 <= r["similarity"] <= 1 and r["first_word"] <= r["last_word"] for r in found)


def test_blocks_of_seeds_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for k in range(9)]
    docs = [(k, f"before {items[k][1]} after", 0, "") for k in range(9)]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*r, "") for r in items], ITEMS)
    monkeypatch.setattr(d, "SEEDS", 300)
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(*frames).collect()) == [(k, k) for k in range(9)]


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(d, "PIECE", 40)
    rng = random.Random(4)
    item = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(["x"] * rng.randrange(30) + item[k : k + 15] + ["y"] * 9), 0, "") for k in range(0, 186)]
    found = d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item), "")], ITEMS))
    assert found.select("doc_id").distinct().count() == 186


def test_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(20))
    docs = [(1, None, 0, ""), (2, "", 0, ""), (3, "few words", 0, ""), (None, text, 0, ""), (4, text, 0, ""), (4, text, 0, ""), (5, text + " and more", 0, "")]
    items = [(9, text, ""), (7, text, ""), (1, None, ""), (2, "", ""), (None, "short item", "")]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = d.contaminated(*frames).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["item_copies"]) for r in found) == [(0, 7, 2), (4, 7, 2), (5, 7, 2)]
    kept = d.decontaminate(*frames)
    assert kept.columns == frames[0].columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    for a, b in ((frames[0].limit(0), frames[1]), (frames[0], frames[1].limit(0))):
        assert d.contaminated(a, b).count() == 0
        assert d.decontaminate(a, b).count() == a.count()
