import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import hits, word_list
from fixtures import words
from util import same

from contextloom.llm import decontam as D
from contextloom.llm import textkernel as K


@pytest.fixture(scope="module")
def items(spark, messy_rows):
    r = random.Random(4)
    long = messy_rows[11][1].split()
    rows = [(1, " ".join(long[50:90])), (2, " ".join(long[29_990:])), (3, "one two"), (4, None), (5, "..."), (6, words(r, 30)), (7, messy_rows[7][1]), (7, "a second text of item seven with just more than ten words in it"), (10, "ÜNÏ çödé"), (None, "a.b@c.de now"), (11, "ünï çödé 12345")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 40])
def test_report_equals_brute_force(messy, messy_rows, items, block_words):
    rows, table = items
    got = D.report(messy, table, block_words=block_words).collect()
    want = Counter()
    for r in messy_rows:
        n, h, ids = hits(r[1], rows)
        ids = sorted(str(i) for i in ids if i is not None)
        want[(r[0], n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(v for k, v in want.items() if k[5]) > 5


def test_decontaminate_keeps_clean_rows_whole(messy, messy_rows, items, nothing):
    rows, table = items
    out = D.decontaminate(messy, table)
    assert out.columns == messy.columns
    assert Counter(str(tuple(r)) for r in out.collect()) == Counter(str(tuple(r)) for r in messy_rows if not hits(r[1], rows)[1])
    assert D.report(nothing, table).count() == 0
    assert D.decontaminate(messy, table.where("false")).count() == len(messy_rows)


def test_documents_equal_sql(spark, duck):
    same(D.op9(spark, "/root/testdata/sf0.001").toPandas(), duck.execute(D.OP9_SQL).df())


def test_longest_matches():
    r = random.Random(2)
    base = [r.choice(["a", "b", "c"]) for _ in range(400)]
    docs = [" ".join(base[i : i + 60]) for i in range(0, 400, 50)] + ["", "z"]
    tests = [("i", " ".join(base[100:180] + ["q"] + base[7:30])), ("j", "b c")]
    items = D.Items(tests)
    shard = D.Shard(*K.utf8(pa.array(docs)), items)
    n, at = shard.longest(items)
    flat = [word_list(d) for d in docs]
    k = 0
    for _, t in tests:
        w = word_list(t)
        for p in range(len(w)):
            best = 0
            for d in flat:
                for q in range(len(d)):
                    m = 0
                    while p + m < len(w) and q + m < len(d) and w[p + m] == d[q + m]:
                        m += 1
                    best = max(best, m)
            if best >= 3:  # shorter ones may begin no window, and are not in the array
                assert n[k] == best or (n[k] < best and not any(tuple(w[p : p + 3]) == tuple(w[s : s + 3]) for s in range(len(w) - 9)))
            k += 1
    assert n.max() >= 60 and (at[n > 0] >= 0).all()


@pytest.mark.parametrize("room", [D.SORT_BYTES, 512])
def test_suffixes_are_sorted_by_all_their_words(room):
    r = np.random.default_rng(6)
    rank = np.concatenate([r.integers(1, 3, 300), np.tile([1, 2], 150), np.ones(200)]).astype(np.uint32)
    stop = np.repeat([300, 450, 600, 800], [300, 150, 150, 200])
    at = np.sort(r.choice(800, 700, replace=False))
    got = at[D.suffix_order(rank, at, stop[at], width=2, room=room)]
    assert got.tolist() == sorted(at.tolist(), key=lambda i: (rank[i : stop[i]].tolist(), i))


def longest_run(a, b):
    """Words of the longest run that two lists share."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        best = max(best, *row)
    return best


def test_longest_matches_of_64_to_500_words(spark):
    """Documents that share 64 to 500 words with one item, in any order, with the same beginnings."""
    r = random.Random(9)
    item = [r.choice(["a", "b", "c", "d", "e", "f"]) + str(r.randrange(40)) for _ in range(520)]
    cuts = [(3, 73), (3, 103), (3, 113), (3, 153), (3, 131), (10, 510), (200, 264), (0, 520), (450, 520)]
    docs = [" ".join(["x", *item[a:b], f"y{i}", *item[5:9]]) for i, (a, b) in enumerate(cuts)] + ["x y z"]
    other = " ".join(["q", *item[100:300], "q", *item[50:90]])
    for order in (docs, docs[::-1]):
        items = D.Items([("i", " ".join(item)), ("o", other)])
        shard = D.Shard(*K.utf8(pa.array(order)), items)
        n, at = shard.longest(items)
        flat = [word_list(d) for d in order]
        text = np.array([w for d in flat for w in d])
        for i, (row, p) in enumerate(zip(items.row, items.pos, strict=True)):
            w = word_list([" ".join(item), other][row])[p:]
            best = max((next((m for m, (x, y) in enumerate(zip(w, d[q:])) if x != y), min(len(w), len(d) - q)) for d in flat for q in range(len(d)) if d[q] == w[0]), default=0)
            if best >= 3 and len(w) >= 10:
                assert n[i] == best
                assert text[at[i] : at[i] + best].tolist() == w[:best]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = D.matches(df, b).collect()
    assert max(x.length for x in got) == 520
    for x in D.report(df, b).collect():
        assert x.n_hit == hits(docs[x.doc_id], [(1, " ".join(item))])[1] and (longest_run(word_list(docs[x.doc_id]), item) >= 10) == x.contaminated


def test_matches_reports_places(spark):
    text = "x y " + " ".join(f"w{i}" for i in range(40)) + " end"
    df = spark.createDataFrame([(5, text), (6, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "start " + " ".join(f"w{i}" for i in range(5, 38)))], "item_id long, text string")
    assert [tuple(r) for r in D.matches(df, b).collect()] == [("9", 1, 5, 7, 33)]


def test_order_of_keys_is_that_of_words():
    rank = np.array([3, 1, 2, 70000, 5], np.uint32)
    k = D.keys(rank, np.arange(5), np.full(5, 5), 3)
    assert np.argsort(k).tolist() == sorted(range(5), key=lambda i: list(rank[i : i + 3]))
