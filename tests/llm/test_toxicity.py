import random
import zlib

import numpy as np
import pyarrow as pa
from brute import word_list
from fixtures import words

from contextloom.llm import textkernel as K
from contextloom.llm import toxicity as T


def area(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_machine_learns_what_additive_weights_cannot():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([k for k, on in ((0, a), (1, b), (2, not a), (3, not b), (4 + rng.integers(20), True)) if on]))
        y.append(float(a == b))
    m = T.fit(rows[:1000], np.array(y[:1000]), np.arange(24), epochs=60, rate=0.2)
    s = np.array([m.raw(np.zeros(len(r), int), r, 1)[0] for r in rows[1000:]])
    assert ((s > 0) == np.array(y[1000:])).mean() > 0.97
    m.v[:] = 0
    flat = np.array([m.raw(np.zeros(len(r), int), r, 1)[0] for r in rows[1000:]])
    assert area(np.array(y[1000:]), flat) < 0.6


def test_held_out_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = T.classify(docs, labels).toPandas().merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id")
    assert len(got) and got.score.between(0, 1).all()
    h = got[got.held_out]
    assert area(h.toxic.to_numpy(), h.score.to_numpy()) > 0.95
    assert h[h.toxic == 0].predicted.mean() < 0.02 and h[h.toxic == 1].predicted.mean() > 0.8  # some labels have no sign in the text


def test_messy_rows_and_labels(spark, messy, messy_rows, nothing):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else int(i in (4, 5, 6, 15))) for i in range(40)] + [(4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.classify(messy, labels).collect()
    assert len(got) == len(messy_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert len({round(r.score, 9) for r in got if r.doc_id in (0, 1)}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert T.classify(nothing, labels).count() == 0
    flat = {r.score for r in T.classify(messy, labels.where("false")).collect()}
    assert len(flat) == 1 and flat.pop() < 0.01
    assert T.reject(messy, labels.where("false")).columns == messy.columns


def test_a_pair_without_any_marginal_signal_is_learnt_end_to_end(spark):
    """Two words are each in half of the rows of either label; the label says whether just one of them is there. The vocabulary
    is far larger than the terms that enter the model."""
    r = random.Random(5)
    vocabulary = [f"w{i}q" for i in range(4000)]
    rows = []
    for i in range(6000):
        a, b = r.random() < 0.5, r.random() < 0.5
        text = [r.choice(vocabulary) for _ in range(30)] + ["insult"] * a + ["group"] * b
        r.shuffle(text)
        rows.append((i, " ".join(text), int(a != b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    got = T.classify(df.select("doc_id", "text"), df.select("doc_id", "toxic"), n_terms=200, n_frequent=300).join(df, "doc_id").where("held_out").collect()
    assert len(got) > 1000 and sum(x.predicted == x.toxic for x in got) > 0.9 * len(got)


def test_scores_equal_a_plain_restatement(spark):
    """Given a fitted machine: the sum over terms and over all pairs of terms, one by one."""
    r = random.Random(2)
    texts = [words(r, r.randint(0, 30)) for _ in range(40)] + ["", None, "Über ÜBER über abcdefgh abcdxyz", "a" * 3000]
    rng = np.random.default_rng(1)
    first = np.unique(np.concatenate([T.terms(*K.utf8(pa.array([t], pa.string())))[1] for t in texts]))
    dims = first[rng.random(len(first)) < 0.7]
    m = T.Machine(dims, -0.3, rng.normal(0, 0.2, len(dims)), rng.normal(0, 0.1, (len(dims), 4)), 1.3, 0.2)
    place = {int(d): k for k, d in enumerate(dims)}

    def one(text):
        found = set()
        for w in word_list(text):  # a word and its first four and five bytes, hashed as the kernel hashes a text of that word
            raw = w.encode()
            for piece, n in ((raw, None), (raw, 4), (raw, 5)):
                if n is None or len(piece) > n:
                    k = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), prefixes=(4, 5))
                    h = k.hash[0] if n is None else k.prefix[n][0]
                    found.add((int(h) >> 40) % T.DIMS)
        at = sorted(place[d] for d in found if d in place)
        s = m.w0 + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for x, i in enumerate(at) for j in at[x + 1 :])
        return 1 / (1 + np.exp(-(m.slope * s + m.shift)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in T.score(df, m).collect()}
    assert all(abs(got[i] - one(t)) < 1e-9 for i, t in enumerate(texts))
    held = {x.doc_id: x.h for x in spark.range(50).select("id", T.held_out("id").alias("h")).withColumnRenamed("id", "doc_id").collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
    assert T.score(df.selectExpr("doc_id", "text", "'mine' AS score"), m).columns == ["doc_id", "text", "score"]
