import duckdb
import numpy as np
import pytest
from brute import components

from tessera.llm.embedding_dedup import link_embeddings, shape
from tessera.llm.queries import EMBEDDING_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, note string"


def brute(rows, threshold=0.98):
    vectors = {}
    for k, (_, v, label, _) in enumerate(rows):
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            vectors[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in vectors for b in vectors if a < b and rows[a][2] == rows[b][2] and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= threshold]
    count = {k: 0 for k in range(len(rows))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, links


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 16))
    rows = []
    for k in range(240):
        v = centres[k % 6] + rng.standard_normal(16) * (0.02 + 0.1 * (k % 4))
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 3 % 2, "x"))
    rows += [(500 + k, rows[5][1], rows[5][2], "copy") for k in range(40)]  # a group of copies
    count, links = brute(rows)
    comp = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    out = {r["vec_id"]: r for r in link_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r[0]: count[k] for k, r in enumerate(rows)} == {k: r["n_links"] for k, r in out.items()}
    assert comp == {k: r["component_id"] for k, r in out.items()}
    assert all(r["kept"] == (k == r["component_id"]) for k, r in out.items())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0, ""), (2, [0.0, 0.0], 0, ""), (3, [1.0, None], 0, ""), (4, [nan, 1.0], 0, ""), (5, [inf, 1.0], 0, ""), (6, [], 0, ""),
        (7, [1.0, 2.0], None, ""), (8, [1.0, 2.0], None, ""), (9, [1.0, 2.0], 3, ""), (10, [2.0, 4.0], 3, ""), (11, [1.0, 2.0], 3, ""), (11, [1.0, 2.0], 3, ""),
        (12, [1.0, 2.0, 0.0], 3, ""), (None, [1.0, 2.0], 3, ""), (None, [1.0, 2.0], 8, ""), (None, [1.0, 2.0], 8, ""), (13, [1.0, 2.0001], 8, ""),
    ]
    out = link_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert sorted(r["n_links"] for r in out if r["vec_id"] is None) == [2, 2, 4]
    for r in out:
        if r["vec_id"] in (9, 10, 11):
            assert r["n_links"] == 4 and r["component_id"] == 9 and r["kept"] == (r["vec_id"] == 9)
        elif r["vec_id"] is None:
            assert r["component_id"] is None and r["kept"]
        elif r["vec_id"] == 13:
            assert r["n_links"] == 2 and r["component_id"] == 13
        else:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, key long, node long, component_id string")
    assert link_embeddings(df).count() == 0


@pytest.mark.parametrize("cosine", [0.981, 0.979])
def test_threshold(spark, cosine):
    rows = [(1, [1.0, 0.0], 0, ""), (2, [cosine, float(np.sqrt(1 - cosine**2))], 0, "")]
    links = [r["n_links"] for r in link_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert links == ([1, 1] if cosine > 0.98 else [0, 0])


def test_labels_of_any_type(spark):
    rows = [(k, [1.0, 2.0], label) for k, label in enumerate(["a", "a", "b", None, "1", "1"])]
    out = {r["vec_id"]: r["component_id"] for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
    wide = [(k, [1.0, 2.0], 2**40 + k // 2) for k in range(4)]
    out = {r["vec_id"]: r["component_id"] for r in link_embeddings(spark.createDataFrame(wide, "vec_id long, embedding array<float>, label long")).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 2}


@pytest.mark.parametrize("rows", [1000, 10**6, 10**9])
def test_recall_of_thousands_of_links(spark, rows):
    """Every link of noisy groups is found with the tables of any number of rows; groups are split over blocks."""
    tables, bits = shape(rows, 0.98)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 32))
    data = [(k, [float(x) for x in (centres[k % 30] + rng.standard_normal(32) * 0.1).astype(np.float32)], 0, "") for k in range(900)]
    count, links = brute(data)
    assert len(links) > 2000
    out = {r["vec_id"]: r["n_links"] for r in link_embeddings(spark.createDataFrame(data, SCHEMA), tables=tables, bits=bits).collect()}
    assert out == count


def test_sql_states_the_links():
    """The query's SQL, where there are links, against all pairs in numpy."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((5, 12))
    rows = [(k, [float(x) for x in (centres[k % 5] + rng.standard_normal(12) * 0.06).astype(np.float32)], k % 2, "") for k in range(80)]
    rows += [(90, None, 0, ""), (91, [0.0] * 12, 0, ""), (92, [float("nan")] * 12, 0, ""), (93, rows[0][1], None, ""), (94, [], 0, "")]
    count, links = brute(rows)
    assert len(links) > 100
    comp = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in rows])
    got = {r[0]: r[1:] for r in con.execute(EMBEDDING_SQL).fetchall()}
    assert got == {r[0]: (count[k], comp[r[0]], comp[r[0]] == r[0]) for k, r in enumerate(rows)}
