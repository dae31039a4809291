"""Keyed permutations of integer ranges by Feistel networks."""

from __future__ import annotations

import hashlib

import numpy as np

from tessera.llm.words import mix, stream

ROUNDS = 6
_TURNS = stream(61, ROUNDS)


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each index's image under a permutation of 0 .. size-1 that ``key`` picks; all arrays of one length.

    A balanced network on the smallest even number of bits that holds the
    range; images outside it go through the network again (cycle walking),
    four times on average at most.
    """
    size = size.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 0.5)).astype(np.uint64)
    half = np.maximum((bits + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    key = key.astype(np.int64).view(np.uint64)
    todo = np.flatnonzero(size > 1)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in _TURNS:
            left, right = right, left ^ (mix((right + k) ^ turn) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def permute_one(value: int, size: int, key: bytes, tweak: bytes = b"") -> int:
    """The image of one integer of any magnitude, with rounds of keyed BLAKE2b.

    ``tweak`` names the format, so equal numbers of different formats differ.
    """
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS + 2):
            digest = hashlib.blake2b(right.to_bytes(width, "little") + tweak, key=key, digest_size=min(64, width + 8), salt=bytes([r])).digest()
            left, right = right, left ^ (int.from_bytes(digest, "little") & mask)
        value = (left << half) | right
        if value < size:
            return value
