"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A part holds the documents of one range of ids in ascending order, in three
files: ``.tokens`` (all ids end to end, little-endian unsigned integers),
``.offsets`` (unsigned 64-bit, one more than documents, from the part's own
start) and ``.ids`` (signed 64-bit document ids). ``manifest.json`` lists the
parts in order with the tokens and documents before each: bases that are prefix
sums of the parts' counts, so a document's place in the whole corpus is its
part's base plus its offset. Parts are written under names of their own
attempt; what a lost or repeated task leaves behind is in no manifest.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words

#: Words whose ids a worker remembers, about 20 bytes each; beyond them, or 8 times as many ids, it starts anew.
REMEMBERED = 1_000_000
#: Rows that a worker gets at once: a batch is held by the executor's JVM, in its buffer to the worker, and by the worker.
ROWS = 256
#: Bytes of text encoded at once.
CHUNK = 1 << 19
#: Bytes of text in a part, about.
PART = 1 << 27
#: Letters that normalisation leaves alone but for case, in UTF-8, between runs of ASCII punctuation. The tokenizer's
#: pattern always cuts between letters and punctuation, but for an apostrophe before letters; "<" could begin the name
#: of a special token.
_SIMPLE = re.compile(rb"([!-&(-/:;=-@\[-`{-~]*)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
NO_ID = -(2**63)


class Encoder:
    """Ids of whole texts. With ``by_word``, each distinct word is encoded once.

    ``by_word`` is for tokenizers that drop white space, never look across it
    and cut between letters and punctuation: the ids of a text are then those
    of its words, end to end. Only ASCII white space divides words here, and
    only plain words are taken apart; anything else is left to the library.
    Words are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, by_word: bool, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max([end_id, *vocab.values()]) < 1 << 16 else "<u4"
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.by_word, self.end_id = by_word, end_id
        self.forget()

    def forget(self) -> None:
        """Keys of known words in order, each with its place in the flat ids; the end id is at place 0."""
        self.keys = np.zeros(0, np.uint64)
        self.place, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.full(1 << 16, self.end_id, self.dtype), 1

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of letters: many in one text, told apart by the tokens that end words."""
        out = []
        for lo in range(0, len(words), 256):
            part = words[lo : lo + 256]
            ids = self._each([b" ".join(part).decode()])[0]
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(part) else self._each([w.decode() for w in part])
        return out

    def _words(self, words: list[bytes]) -> list[list[int]]:
        parts = [m.groups() if (m := _SIMPLE.fullmatch(w)) else None for w in words]
        bare = list({p[1] for p in parts if p})
        ids = dict(zip(bare, self._runs(bare), strict=True))
        other = list({w for w, p in zip(words, parts, strict=True) if not p}.union(*((p[0], p[2]) for p in parts if p and (p[0] or p[2]))))
        more = dict(zip(other, self._each([w.decode() for w in other]), strict=True))
        return [more[w] if not p else more[p[0]] + ids[p[1]] + more[p[2]] if p[0] or p[2] else ids[p[1]] for w, p in zip(words, parts, strict=True)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        gc.disable()  # the many small lists made here hold no cycles
        try:
            ids = self._words(words)
        finally:
            gc.enable()
        length = np.array([len(i) for i in ids], np.int32)
        total = int(length.sum(dtype=np.int64))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), self.dtype)])
        self.flat[self.used : self.used + total] = np.fromiter((x for i in ids for x in i), self.dtype, total)
        place = (self.used + np.cumsum(length, dtype=np.int64) - length).astype(np.int32)
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.length = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.place, place), (self.length, length)))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of the column's ids, each with its rows' counts; every row ends with the end id."""
        data, offsets = words.buffers(column)
        for lo, hi in words.chunks(offsets, CHUNK):
            part = offsets[lo : hi + 1]
            if not self.by_word:
                own = [[*i, self.end_id] for i in self._each([bytes(data[a:b]).decode() for a, b in zip(part, part[1:], strict=False)])]
                yield np.concatenate([np.array(i, self.dtype) for i in own]), np.array([len(i) for i in own], np.int64)
                continue
            keys, rows = words.hashed(data, part, lower=False)
            distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.keys) > REMEMBERED or self.used > 8 * REMEMBERED:
                self.forget()
            at = np.searchsorted(self.keys, distinct)
            new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
            if len(new):
                starts, ends, _ = words.spans(data, part)
                raw = data[part[0] : part[-1]].tobytes()
                self._learn(distinct[new], [raw[starts[k] : ends[k]] for k in first[new]])
                at = np.searchsorted(self.keys, distinct)
            place, length = (np.insert(x[at][back], rows[1:], end).astype(np.int64) for x, end in ((self.place, 0), (self.length, 1)))
            stops = np.cumsum(length)
            ids = self.flat[np.repeat(place - stops + length, length) + np.arange(stops[-1])]
            yield ids, np.add.reduceat(length, rows[:-1] + np.arange(hi - lo))


@functools.lru_cache(2)
def encoder(path: str, by_word: bool, end_id: int) -> Encoder:
    """One for each worker, with what it remembers from its earlier tasks."""
    return Encoder(path, by_word, end_id)


words.kept["encoder"] = encoder.cache_clear


@contextlib.contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand workers ``rows`` rows at once at most; the caller's setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, own = spark.conf.get(key, None), int(spark.conf.get(key))
    spark.conf.set(key, min(rows, own) if own > 0 else rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@dataclass
class Part:
    order: int
    path: str
    docs: int
    tokens: int
    doc_base: int = 0
    token_base: int = 0


@dataclass
class Manifest:
    directory: str
    dtype: str
    end_id: int
    parts: list[Part]


def write_tokens(docs: DataFrame, directory: str, tokenizer: str, end_id: int, by_word: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Manifest:
    """Writes every whole text's ids under ``directory``, a URI that all executors share.

    Ascending ids; rows that repeat an id in order of their text's hash, then
    the text. Null ids come first and are stored as the lowest integer. Null
    and empty texts are the end id alone. Other columns are ignored. An empty
    table gives a manifest without parts. The tokenizer file is read by path
    on every executor.
    """
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(directory)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    ranged = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "text")
    wide = encoder(tokenizer, by_word, end_id).dtype

    def write(batches):
        coder, files, name = None, None, f"{directory}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        lengths: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                fs, path = pafs.FileSystem.from_uri(name)
                coder, files = encoder(tokenizer, by_word, end_id), [fs.open_output_stream(f"{path}.{kind}") for kind in ("tokens", "ids")]
            for ids, counts in coder.encode(batch.column("text")):
                files[0].write(ids.tobytes())
                lengths.append(counts)
            files[1].write(batch.column("id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
        if files is None:
            return
        offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(lengths), dtype="<u8")])
        for f in files:
            f.close()
        with fs.open_output_stream(f"{path}.offsets") as f:
            f.write(offsets.astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"order": [TaskContext.get().partitionId()], "path": [name], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])]}, schema=pa.schema([("order", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    with _batches(spark, ROWS):
        parts = [Part(*r) for r in sorted(ranged.mapInArrow(lambda it: words.lean(write(it), "encoder"), "order int, path string, docs long, tokens long").collect())]  # one row for each partition
    docs_before = tokens_before = 0
    for p in parts:
        p.doc_base, p.token_base = docs_before, tokens_before
        docs_before, tokens_before = docs_before + p.docs, tokens_before + p.tokens
    manifest = Manifest(directory, wide, end_id, parts)
    out = system.create(jvm.org.apache.hadoop.fs.Path(f"{directory}/manifest.json"), True)
    out.write(json.dumps(asdict(manifest)).encode())
    out.close()
    return manifest


class PartFile:
    """Ranges of one of a part's files: memory-mapped if local, else read as they are asked for."""

    def __init__(self, path: str, kind: str, dtype: str):
        fs, at = pafs.FileSystem.from_uri(f"{path}.{kind}")
        self.dtype = np.dtype(dtype)
        self.mapped = np.memmap(at, dtype, "r") if isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(at).size else None
        self.file = None if self.mapped is not None else fs.open_input_file(at)

    def __len__(self) -> int:
        return len(self.mapped) if self.mapped is not None else self.file.size() // self.dtype.itemsize

    def __getitem__(self, span: slice) -> np.ndarray:
        lo, hi, _ = span.indices(len(self))
        if self.mapped is not None:
            return self.mapped[lo:hi]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * width, lo * width), self.dtype)


def read_tokens(spark: SparkSession, manifest: Manifest, ids: bool = False) -> DataFrame:
    """Each document from the files: (doc_id, start, n_tokens, ids_crc32[, ids]), start counting all ids before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    rows = [(p.path, p.token_base) for p in manifest.parts]
    parts = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    dtype = manifest.dtype

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, offsets, names = (PartFile(path, k, d) for k, d in (("tokens", dtype), ("offsets", "<u8"), ("ids", "<i8")))
                for lo in range(0, len(names), 1024):
                    own = offsets[lo : lo + 1025].astype(np.int64)
                    name = np.array(names[lo : lo + 1024])
                    held = tokens[int(own[0]) : int(own[-1])]
                    cut = [held[a:b] for a, b in zip(own - own[0], own[1:] - own[0], strict=False)]
                    columns = [pa.array(name, mask=name == NO_ID), pa.array(own[:-1] + base), pa.array(np.diff(own)), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in cut], pa.int64())]
                    if ids:
                        columns.append(pa.array([t.astype(np.int64) for t in cut], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return parts.mapInArrow(lambda it: words.lean(read(it), "encoder"), schema)
