"""The operators applied to their whole tables, under the driver's contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import licences, toxicity
from tessera.llm.class_lm import score_documents
from tessera.llm.decontamination import contaminated
from tessera.llm.embedding_dedup import link_embeddings
from tessera.llm.minhash_dedup import link_documents
from tessera.llm.mixing import mix_sources, taken
from tessera.llm.pseudonyms import private_values
from tessera.llm.sharding import assign_shards
from tessera.llm.token_files import read_tokens, write_tokens
from tessera.sources.scratch import Scratch

#: The tokenizer file of op5; executors read it by this path.
TOKENIZER = "word_bpe_49k.json"
#: The key of op10's pseudonyms in queries; a production run passes its own secret.
KEY = b"tessera query key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold() -> Column:
    """One of five parts of the documents, by id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), shingle_words=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), usable=_fold() != 0)
    score = toxicity.scorer(spark, model)
    scored = docs.select("doc_id", (F.coalesce(_fold(), F.lit(-1)) == 0).alias("held_out"), score("text").alias("score"), toxicity.threshold(model, F.col("lang")).alias("lang_threshold"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("rejected", F.col("score") >= F.col("lang_threshold"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = Scratch(spark, "tokens").path("corpus")
    return read_tokens(spark, write_tokens(_table(spark, sf_dir, "documents"), to, tokenizer_path(), end_id=1, by_word=True))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(_table(spark, sf_dir, "documents"), learn=_fold() != 1)
    return scored.withColumn("held_out", F.coalesce(_fold() == 1, F.lit(False)))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix_sources(_table(spark, sf_dir, "documents")))


def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_values(_table(spark, sf_dir, "documents"), KEY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_benchmark_decontamination, op3_minhash_near_dedup, op4_toxicity, op5_token_ids,
        op6_class_lm, op7_licence_scan, op8_source_mixing, op9_vector_sharding, op10_pseudonyms, pipeline,
    )
}

#: All pairs of usable vectors with equal labels, and what they reach.
EMBEDDING_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) >= 0.98 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

#: All pairs of distinct sets of 2-word shingles that share one, and what they reach.
SHINGLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM worded),
alike AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2),
sized AS (SELECT node, s, len(s) AS n FROM alike),
single AS (SELECT node, n, unnest(s) AS x FROM sized),
common AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS n FROM single a JOIN single b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
linked AS (SELECT a, b FROM common WHERE 100 * n >= 80 * (na + nb - n)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT node AS a, node AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
own AS (SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(c.component_id, sets.doc_id) AS component_id
  FROM sets LEFT JOIN sized ON sized.s = list_sort(sets.s) LEFT JOIN comp c ON c.a = sized.node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM own"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": EMBEDDING_SQL, "op3_minhash_near_dedup": SHINGLE_SQL, "op7_licence_scan": licences.oracle_sql()}
