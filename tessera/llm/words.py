"""Words of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f, \\r, with
A-Z lower-cased; UTF-8 never uses these bytes inside other characters. Null
texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Turns ASCII punctuation into spaces, for words of letters and digits.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32
#: Bytes of text hashed at once; arrays of eight times this stay in the cache.
CHUNK = 1 << 18


#: Functions that empty what operators keep in a worker between tasks, by operator.
kept: dict[str, Callable[[], None]] = {}


def lean(batches: Iterable, own: str = "") -> Iterator:
    """The batches of a task; at its end the worker, which stays for other tasks, gives freed memory back.

    What operators but ``own`` have kept from earlier tasks goes first.
    """
    for name, empty in kept.items():
        if name != own:
            empty()
    try:
        yield from batches
    finally:
        release()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, a few at a time, so that copies of them stay small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def release() -> None:
    """Returns freed memory to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudorandom 64-bit integers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_factors = stream(11, 64) | U64(1)


def factors(n: int) -> np.ndarray:
    """Odd multipliers by position in a word."""
    global _factors
    if n > len(_factors):
        _factors = stream(11, max(n, 2 * len(_factors))) | U64(1)
    return _factors


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, from the first offset, and each row's word offsets."""
    off = offsets - offsets[0]
    separator = SEPARATOR[data[offsets[0] : offsets[-1]]]
    n = len(separator)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = separator[:-1]
    first[off[:-1][off[:-1] < n]] = True
    first &= ~separator
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = separator[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    last &= ~separator
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashed(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each row's word offsets; ``lower`` takes A-Z for a-z."""
    starts, ends, at = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), at
    raw = data[offsets[0] : offsets[-1]]
    value = (LOWER[raw] if lower else raw).astype(U64) + U64(1)
    value[SEPARATOR[raw]] = 0
    value = value[starts[0] :]
    begin = starts - starts[0]
    gaps = np.diff(np.append(begin, len(value)))
    lengths = ends - starts
    place = np.arange(len(value)) - np.repeat(begin, gaps)
    table = factors(int(lengths.max()))
    np.minimum(place, len(table) - 1, out=place)
    total = np.add.reduceat(value * table[place], begin)
    return mix(total ^ (lengths.astype(U64) * U64(0x9E3779B97F4A7C15))), at


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles of one text; of fewer words, the whole sequence is one."""
    m = len(words)
    if not m:
        return np.zeros(0, U64)
    turn = stream(23, k) | U64(1)
    if m < k:
        return mix((words * turn[:m]).sum(dtype=U64, keepdims=True) + U64(m))
    total = words[: m - k + 1] * turn[0]
    for i in range(1, k):
        total = total + words[i : m - k + 1 + i] * turn[i]
    return np.unique(mix(total + U64(k)))


def texts(column: pa.Array, table: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for each row of a string column; ``table`` replaces bytes first."""
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        words, at = hashed(data, part) if table is None else hashed(table[data[part[0] : part[-1]]], part - part[0])
        for r in range(lo, hi):
            yield r, words[at[r - lo] : at[r - lo + 1]]
