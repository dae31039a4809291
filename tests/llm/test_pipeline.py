import shutil

import corpus_pipeline as c
import pytest
from brute import near_copies
from pyspark.sql import functions as F

from tessera.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, as its successor gets them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in c.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        out.append(docs)
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_stages_return_documents(stages):
    assert [n for n, _ in c.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_ids"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_toxicity_drops_toxic_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id").join(labels, "doc_id")
    before = stages[0].select("doc_id").join(labels, "doc_id")
    assert kept.where("toxic = 0").count() >= 0.97 * before.where("toxic = 0").count()
    assert kept.where("toxic = 1").count() < before.where("toxic = 1").count()


def test_near_copies_match_brute_force(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    want = {k for k, v in near_copies(rows, 5).items() if k == v}
    assert {r["doc_id"] for r in stages[2].collect()} == want


def test_contaminated_documents_go(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    kept = {r["doc_id"] for r in stages[3].collect()}
    holding = {k for k, t in before.items() if any(i in t for i in items)}
    assert not kept & holding and set(before) - kept == holding


def test_mixture_and_files(stages):
    words = {r["doc_id"]: len(r["text"].split()) for r in stages[3].collect()}
    mixed = {r["doc_id"]: len(r["text"].split()) for r in stages[4].collect()}
    assert all(n <= 2 * words[k] for k, n in mixed.items())
    total = sum(words.values())
    assert abs(sum(mixed.values()) - 1.5 * total) <= 0.02 * total
    files = sorted(stages[5].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in files] == sorted(mixed)
    at = 0
    for r in files:
        assert r["start"] == at
        at += r["n_tokens"]


def test_run_gives_what_the_stages_give(spark, stages):
    assert sorted(c.run(spark, SF).collect()) == sorted(stages[-1].collect())


def test_every_query_is_registered():
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in q.QUERIES if n != "pipeline"}
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)


def test_folds_are_those_of_crc32(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", q._fold().alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(q._fold()).first()[0] is None


def test_library_works_without_this_subpackage(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(c.__file__).parent
    for name in ("tessera", "__spark_entry__.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; assert e.llm is None and e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
