import numpy as np
import pyarrow as pa
from brute import shingle_set, word_list
from hypothesis import given, settings
from hypothesis import strategies as st

from contextloom.llm import textkernel as K


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB9 .é\n漢\x00_", max_size=40), max_size=8))
def test_words_and_shingles(texts):
    w = K.words(*K.utf8(pa.array(texts, pa.string())))
    got = [[] for _ in texts]
    for i in range(len(w.start)):
        got[w.doc[i]].append(w.text(i))
    assert got == [word_list(t) for t in texts]
    assert K.word_count(w).tolist() == [len(x) for x in got]
    names = {}
    for x, h in zip((y for x in got for y in x), w.hash, strict=True):
        assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)
    h, doc = K.shingles(w, 5)
    for i, t in enumerate(texts):
        assert len(np.unique(h[doc == i])) == len(shingle_set(t))


def test_blocks_cover_rows_and_long_words_hash_alike():
    col = pa.array(["a b", "c" * 5000, None, "d", "c" * 5000, "x " + "q" * 400_000 + " y", "q" * 400_000])
    seen = [(s, e) for s, e, _, _ in K.blocks(col, 1000)]
    assert [r for s, e in seen for r in range(s, e)] == list(range(7))
    w = K.words(*K.utf8(col))
    big = np.flatnonzero(w.end - w.start == 400_000)
    assert len(big) == 2 and w.hash[big[0]] == w.hash[big[1]]
    sliced = K.words(*K.utf8(col.slice(3, 2)))
    assert sliced.hash.tolist() == w.hash[3:5].tolist()
