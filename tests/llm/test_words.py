import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import words

TEXT = st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\raAbB\xa0\x1c")), max_size=40))


def split(text):
    return (text or "").encode().lower().split()


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_a_plain_split(texts):
    column = pa.array(texts, pa.string())
    seen = {}
    for r, hashes in words.texts(column):
        own = split(texts[r])
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_and_chunks_hash_alike():
    texts = [f"word{k} Other\tWORD{k}" * (k % 5) for k in range(50)]
    column = pa.array(texts)
    whole = [h.tolist() for _, h in words.texts(column)]
    assert [h.tolist() for _, h in words.texts(column.slice(7, 20))] == whole[7:27]
    data, offsets = words.buffers(column)
    small = [words.hashed(data, offsets[a : b + 1])[0].tolist() for a, b in words.chunks(offsets, 16)]
    assert sum(small, []) == sum(whole, [])


def test_very_long_word():
    (_, one), (_, two) = words.texts(pa.array(["a" * 100_000, "a" * 100_001]))
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_shingles():
    h = np.array([1, 2, 3, 1, 2], np.uint64)
    assert len(words.shingles(h, 2)) == 3
    assert len(words.shingles(h[:1], 2)) == 1
    assert len(words.shingles(h[:0], 2)) == 0
    assert words.shingles(h[:1], 2)[0] not in words.shingles(h, 2)
