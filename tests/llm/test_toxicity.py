import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as t

DOCS = "doc_id long, text string, lang string, score double, y int"
BAD = ["nasty", "vile", "rotten"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        text = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(5, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", ".", ","]))
        rows.append((k, " ".join(text), ["en", "de", None][k % 3], 0.0, 0))
        labels.append((k, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1200)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = t.train(docs, marks, usable)
    held = docs.where(~usable).select("doc_id", t.scorer(spark, model)("text").alias("s")).collect()
    right = [(r["s"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]
    assert len(right) > 150 and np.mean(right) > 0.95
    assert all(0 <= r["s"] <= 1 for r in held)
    kept = t.reject_toxic(docs.withColumn("lang_threshold", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "lang_threshold"]
    left = {r["doc_id"] for r in kept.collect()}
    assert len([k for k, *_ in rows if k % 4 and k not in left]) <= 9  # clean documents stay
    assert len([k for k, *_ in rows if k % 4 == 0 and k in left]) <= 30


def test_training_is_repeatable_and_bounded(spark):
    rows, labels = corpus(300)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    one = t.train(docs, marks, positives=40, negatives=60)
    two = t.train(docs.repartition(5), marks.repartition(3), positives=40, negatives=60)
    column = pa.array([r[1] for r in rows])
    assert one.scores(column).tolist() == two.scores(column).tolist()


def test_odd_rows(spark):
    rows, labels = corpus(200)
    rows += [(None, "nasty vile", "en", 0.0, 0), (900, None, None, 0.0, 0), (901, "", "xx", 0.0, 0), (902, " ".join(["w1"] * 70_000 + ["vile", "nasty", "rotten"]), "en", 0.0, 0), (902, "w1", "en", 0.0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, ""), (1, None, ""), (2, 7, ""), (4, 0, ""), (12345, 1, "")], "doc_id long, toxic int, text string")
    model = t.train(docs, marks)
    scores = docs.select("doc_id", F.length("text").alias("n"), t.scorer(spark, model)("text").alias("s")).collect()
    assert len(scores) == len(rows) and all(0 <= r["s"] <= 1 for r in scores)
    by = {(r["doc_id"], r["n"]): r["s"] for r in scores}
    assert by[900, None] == by[901, 0]
    assert [s for (k, n), s in by.items() if k == 902 and n > 100][0] > 0.5  # the end of a long text counts
    assert t.reject_toxic(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("marks", [[], [(1, 0)], [(1, 1)], [(0, 1), (1, 0)]])
def test_few_labels(spark, marks):
    docs = spark.createDataFrame(corpus(10)[0], DOCS)
    model = t.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert docs.select(t.scorer(spark, model)("text").alias("s")).where("s between 0 and 1").count() == 10


def test_pieces_of_a_text_score_as_the_whole(monkeypatch):
    rows, labels = corpus(60)
    docs = [t.buckets(h) for _, h in t.words.texts(pa.array([r[1] for r in rows]), t.words.PLAIN)]
    model = t.fit(docs, np.array([r[1] for r in labels]))
    column = pa.array([r[1] for r in rows])
    whole = model.scores(column)
    monkeypatch.setattr(t, "PIECE", 7)
    assert np.allclose(whole, model.scores(column), atol=1e-6)


def test_thresholds_come_from_all_rows(spark, monkeypatch):
    """Far more clean rows than the fit may read, some of which hold a bad word: the sample's ratio would ask for too low a threshold."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(4000):
        toxic = k % 20 == 0
        n = rng.choice([1, 2, 3]) if toxic else rng.choice([0, 0, 0, 0, 1])
        text = [f"w{rng.randrange(300)}" for _ in range(30)] + [rng.choice(BAD) for _ in range(n)]
        rng.shuffle(text)
        rows.append((k, " ".join(text), "en" if k % 3 else "de", 0.0, 0))
        labels.append((k, int(toxic)))
    fitted = []
    fit = t.fit
    monkeypatch.setattr(t, "fit", lambda docs, y, *a: (fitted.extend(d.tobytes() for d in docs), fit(docs, y, *a))[1])
    model = t.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), positives=120, negatives=120)
    assert len(fitted) == 200
    column = pa.array([r[1] for r in rows])
    own = [t.buckets(h).astype(np.uint16).tobytes() for _, h in t.words.texts(column, t.words.PLAIN)]
    new = np.array([o not in set(fitted) for o in own])
    score, y = model.scores(column), np.array([r[1] for r in labels])
    assert (~new).sum() == 200
    grid = np.linspace(0.3, 0.9, 61)
    for name, at in [(None, np.ones(4000, bool)), ("en", np.array([r[2] == "en" for r in rows])), ("de", np.array([r[2] == "de" for r in rows]))]:
        weight = np.array([(at & (y == c)).sum() / (at & new & (y == c)).sum() for c in (0, 1)])[y] * (at & new)
        f1 = [2 * weight[(score >= g) & (y == 1)].sum() / (weight[score >= g].sum() + (at & (y == 1)).sum()) for g in grid]
        got = model.threshold if name is None else model.thresholds[name]
        assert f1[int(np.abs(grid - got).argmin())] >= max(f1) - 1e-9
