from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contextloom.llm import packing as P
from contextloom.llm import textkernel as K


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé 1\n'\t!．strevld漢 \x1c", max_size=30), max_size=5))
def test_ids_equal_the_library(texts):
    t = P.tokenizer(P.default_tokenizer())
    ids, ptr = t.encode(*K.utf8(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [t.bpe.encode_ordinary(x) for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_packing_is_best_fit_decreasing(sizes):
    got = P.best_fit_decreasing(np.array(sizes, np.int64), 40)
    assert sorted(p for r in got for p in r) == list(range(len(sizes)))
    room, want = [], []
    for p in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(x, i) for i, x in enumerate(room) if x >= sizes[p]]
        if fit:
            least = min(fit)[0]
            i = next(i for i, x in enumerate(room) if x == least)
            room[i] -= sizes[p]
        else:
            room.append(40 - sizes[p])
    want = sorted(room)
    assert sorted(40 - sum(sizes[p] for p in r) for r in got) == want


def tokens(packed, width="<u2"):
    """Each document's ids put together again; repeated ids as several."""
    out = defaultdict(list)
    for r in packed.collect():
        ids, pos = np.frombuffer(r.input_ids, width), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(pos) and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 0).all()
        for (d, o, x), a, b in zip(P.unpack(r, width), r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert (pos[a:b] == np.arange(b - a)).all()
            out[d].append((o, x.tolist()))
    return out


@pytest.mark.parametrize("window", [P.WINDOW_TOKENS, 3000])
def test_documents_come_back_whole(documents, window):
    t = P.tokenizer(P.default_tokenizer())
    packed = P.pack(documents, seq_len=512, window_tokens=window)
    got = tokens(packed)
    for r in documents.collect():
        want = t.bpe.encode_ordinary(r.text or "")
        assert [x for _, p in sorted(got.get(r.doc_id, [])) for x in p] == want
    n = packed.selectExpr("count(*) n", "count(distinct pack_id) d", "sum(n_tokens) / (512 * count(*)) f").first()
    assert n.n == n.d and n.f > (0.97 if window > 3000 else 0.6)


def test_messy_rows(messy, messy_rows, nothing):
    t = P.tokenizer(P.default_tokenizer())
    got = tokens(P.pack(messy, seq_len=100))
    want = defaultdict(list)
    for r in messy_rows:
        want[r[0]] += t.bpe.encode_ordinary(r[1] or "")
    for d, x in want.items():
        assert sorted(y for _, p in got.get(d, []) for y in p) == sorted(x)
    assert P.pack(nothing).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(spark, name):
    import public_tokenizers

    df = spark.createDataFrame([(1, "Hello wörld, it's"), (2, ""), (3, None)], "doc_id long, text string")
    got = tokens(P.pack(df, tokenizer_path=public_tokenizers.path(name), seq_len=4))
    t = P.tokenizer(public_tokenizers.path(name))
    ids, _ = t.encode(*K.utf8(pa.array(["Hello wörld, it's"])))
    assert [x for _, p in sorted(got[1]) for x in p] == ids.tolist() and set(got) == {1}
