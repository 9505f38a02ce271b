import random
from collections import Counter

import numpy as np
from brute import near_groups
from fixtures import words
from util import same

from contextloom.llm import near_dup as N
from contextloom.llm.graph import components


def found(df):
    return {r.doc_id: (r.class_id, r.class_size, r.n_links, r.group_id) for r in df.collect()}


def test_equals_brute_force_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(N.join(documents)) == near_groups(rows)


def test_equals_its_sql(spark, duck):
    same(N.op2(spark, "/root/testdata/sf0.001").toPandas(), duck.execute(N.OP2_SQL).df())


def test_a_large_group_over_several_blocks(spark):
    r = random.Random(1)
    base = words(r, 120).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(120)] = words(r, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(r, 80)) for i in range(40)] + [(200 + i, rows[3][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = near_groups(rows)
    assert max(v[2] for v in want.values()) > 20
    assert found(N.join(df, block_rows=16)) == want
    assert found(N.join(df)) == want


def test_messy_rows(spark, messy, messy_rows, nothing):
    got = N.join(messy).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in messy_rows)
    assert all(r.class_id is None for r in got if r.doc_id is None)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.class_id, r.group_id))
    assert by[4] == by[5] == by[6] == {(4, 4)} and by[8] == {(7, 7)} and by[9] == {(9, 7)} and by[12] == {(12, 11)}
    assert by[0] == by[1] == {(0, 0)} and by[2] == {(2, 2)} and by[3] == {(3, 3)}
    assert len(by[7]) == 1 and {r.n_links for r in got if r.doc_id == 7} == {0, 1}  # two texts under one id
    kept = N.keep_one(messy)
    assert kept.columns == messy.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and ids[7] == 2 and ids[0] == 1 and not {1, 5, 6, 8, 9, 10, 12} & set(ids)
    assert N.join(nothing).count() == 0 and N.keep_one(nothing).count() == 0


def test_keep_one_leaves_the_least_id_of_each_group(documents):
    want = near_groups([(r.doc_id, r.text) for r in documents.collect()])
    assert {r.doc_id for r in N.keep_one(documents).collect()} == {i for i, v in want.items() if v[3] == i}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    n = N.bands_for(0.8, N.BAND_ROWS, N.MISS) * N.BAND_ROWS
    lost = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.unique(x[:900]), np.unique(x[100:])  # 800 of 1000 in common
        s, t = N.signature(a, n), N.signature(b, n)
        lost += any((s[:m] == t[:m]).sum() < N.least_matches(m, 0.8, N.TOLERANCE) for m in range(N.STEP, n + 1, N.STEP))
        lost += not (s.reshape(-1, N.BAND_ROWS) == t.reshape(-1, N.BAND_ROWS)).all(1).any()
    assert lost == 0
    assert N.least_matches(128, 0.8, N.TOLERANCE) > 60


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(x.node, x.root) for x in got.collect()} == set(want.items())


def test_empty_blocks_add_no_links(spark):
    r = random.Random(11)
    for n in (2, 3):  # two or three near copies in many blocks, most of them empty
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows = [(i, " ".join([*words, f"tail{i}"])) for i in range(n)]
        got = N.join(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=500).collect()
        assert sorted((x.doc_id, x.n_links, x.group_id) for x in got) == [(i, n - 1, 0) for i in range(n)]
    many = [(i, " ".join([*words, f"tail{i}"])) for i in range(12)]
    got = N.join(spark.createDataFrame(many, "doc_id long, text string"), block_rows=4).collect()
    assert {(x.n_links, x.group_id) for x in got} == {(11, 0)}
