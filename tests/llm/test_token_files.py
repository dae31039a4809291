import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_files as f
from tessera.llm.queries import tokenizer_path
from tessera.sources.scratch import Scratch

SCHEMA = "doc_id long, text string, ids string, start int"
PLAIN = Tokenizer.from_file(tokenizer_path())
CODER = f.Encoder(tokenizer_path(), True, 1)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def coded(coder, texts):
    out = []
    for found, counts in coder.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(found, np.cumsum(counts)[:-1])]
    return out


PART = st.one_of(
    st.text(alphabet=st.characters(codec="utf-8"), max_size=12),
    st.sampled_from(["the.", "it's", "don't,", "…", "été", "éte", "́", "ﬁ", "İstanbul", "ΣΑΣ", "a\xa0b", "<|endoftext|>", "x<|startoftext|>y", "12.5", "\x1c", "ß!", "...", "日本語", "🙂", "word,,", "#tag", "(it's)", "''s", "'sample", "\"q\"", "$$a%%", "e\u0338=", "<|a|>"]),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=8), st.sampled_from([" ", "\n", "\t ", "\r\n", "\x0b", "\x0c"]))
def test_by_word_equals_the_library_on_whole_texts(parts, gap):
    text = gap.join(parts)
    assert coded(CODER, [text]) == [ids(text)]


def rows():
    texts = ["One fish, two fish.", "", None, "the quick brown fox " * 400, "été à la plage", "One fish, two fish."]
    return [(k * 7 % 60, texts[k % len(texts)], "x", 0) for k in range(60)]


@pytest.mark.parametrize("by_word", [True, False])
def test_round_trip(spark, by_word):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    to = Scratch(spark, "test").path("tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one part
    try:
        manifest = f.write_tokens(df, to, tokenizer_path(), 1, by_word)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = sorted(f.read_tokens(spark, manifest, ids=True).collect(), key=lambda r: r["doc_id"])
    at = 0
    for row, (k, text, _, _) in zip(out, sorted(rows()), strict=True):
        want = ids(text)
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (k, at, len(want), want)
        assert row["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert len(manifest.parts) > 1 and manifest.dtype == "<u2"
    with open(f"{to.removeprefix('file://')}/manifest.json") as file:
        saved = json.load(file)
    assert [p["token_base"] for p in saved["parts"]] == [p.token_base for p in manifest.parts]
    tokens = f.PartFile(manifest.parts[0].path, "tokens", "<u2")
    assert isinstance(tokens.mapped, np.memmap) and len(tokens) == manifest.parts[0].tokens


def test_odd_rows(spark):
    data = [(None, "a", "", 0), (5, "b", "", 0), (5, "b", "", 0), (5, "c", "", 0), (-3, None, "", 0)]
    to = Scratch(spark, "test").path("tokens")
    out = f.read_tokens(spark, f.write_tokens(spark.createDataFrame(data, SCHEMA), to, tokenizer_path(), 1, True)).collect()
    out.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, -3, 5, 5, 5]
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1]]


def test_empty(spark):
    to = Scratch(spark, "test").path("tokens")
    manifest = f.write_tokens(spark.createDataFrame([], SCHEMA), to, tokenizer_path(), 1, True)
    assert manifest.parts == [] and f.read_tokens(spark, manifest).count() == 0


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(f, "REMEMBERED", 50)
    monkeypatch.setattr(f, "CHUNK", 300)
    coder = f.Encoder(tokenizer_path(), True, 1)
    texts = [" ".join(f"word{k}x{j}" for j in range(k % 40)) for k in range(200)]
    assert coded(coder, texts) == [ids(t) for t in texts]
    assert len(coder.keys) < 200


def test_workers_get_few_rows_at_once(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id doc_id", "concat('text ', id) text").coalesce(1)
    real, key = type(df).mapInArrow, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def seen(batches):
        for b in batches:
            assert b.num_rows <= 256
            yield b

    monkeypatch.setattr(type(df), "mapInArrow", lambda self, g, *a, **k: real(self, lambda it: g(seen(it)), *a, **k))
    before = spark.conf.get(key, None)
    manifest = f.write_tokens(df, Scratch(spark, "t").path("few"), tokenizer_path(), 1, True)
    assert sum(p.docs for p in manifest.parts) == 5000
    assert spark.conf.get(key, None) == before
