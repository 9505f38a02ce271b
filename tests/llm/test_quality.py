import math
import random
import zlib

import numpy as np
from brute import word_list
from fixtures import words
from pyspark.sql import functions as F

from contextloom.llm import quality as Q
from contextloom.llm import textkernel as K


def test_held_out_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.classify(docs, labels).toPandas().merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id")
    h = got[got.held_out]
    assert (h.predicted == h.quality).mean() > 0.95
    assert h[h.quality == 1].predicted.mean() > 0.97


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.5).astype(float)
    a, b = (np.stack([y + rng.normal(0, 0.45, 3000), *rng.normal(size=(20, 3000))], 1) for _ in range(2))
    few = slice(0, 60)
    hit = lambda v: ((v.score(a[1000:], b[1000:])[2] > 0.5) == y[1000:]).mean()
    teach = lambda pool: Q.co_train((a[few], b[few]), y[few], lambda m: Q.sums(m, (a[pool], b[pool]), Q.SURE), rounds=25, weight=1.0)
    with_pool, alone = teach(slice(120, 1000)), teach(slice(0, 0))
    assert hit(with_pool) > 0.85 and hit(with_pool) > hit(alone) + 0.03


def test_messy_rows_and_labels(spark, messy, messy_rows, nothing):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, 0) for i in range(40)] + [(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(messy, labels).collect()
    assert len(got) == len(messy_rows) and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(nothing, labels).count() == 0
    assert {r.score for r in Q.classify(messy, labels.where("false")).collect()} == {0.5}


def plain_views(text, lang, source):
    """The features of one text, by loops over its words and bytes."""
    raw = (text or "").encode()
    w = word_list(text)
    cells = [0.0] * Q._TERMS
    for x in w:
        h = int(K.words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])).hash[0])
        cells[(h >> 33) % Q._TERMS] += 10 / len(w)
    sizes = [len(x.encode()) for x in w]
    mean = sum(sizes) / max(1, len(w))
    spread = math.sqrt(max(0.0, sum(n * n for n in sizes) / max(1, len(w)) - mean**2))
    content = [*cells, math.log1p(len(w)), len(set(w)) / max(1, len(w)), sum(p == q for p, q in zip(w[:-1], w[1:])) / max(1, len(w)), mean / 5, spread / 5]
    hot = [0.0] * (Q._LANG + Q._SOURCE)
    hot[zlib.crc32(str(lang).encode()) % Q._LANG] = 1
    hot[Q._LANG + zlib.crc32(str(source).encode()) % Q._SOURCE] = 1
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122
    mark = [b < 128 and b > 32 and not letter(b) and not 48 <= b <= 57 for b in raw]
    share = lambda flags: 10 * sum(flags) / max(1, len(raw))
    meta = [math.log1p(len(raw)), share(65 <= b <= 90 for b in raw), share(48 <= b <= 57 for b in raw), share(mark), share(mark[i] and raw[i] == raw[i - 1] for i in range(1, len(raw)))]
    meta += [share(b == 10 for b in raw), share(b == 33 for b in raw), share(b == 124 for b in raw), share(b >= 128 for b in raw), share(b == 32 for b in raw)]
    return np.array(content), np.array([*hot, *meta])


def test_scores_equal_a_plain_restatement(spark):
    """Given fitted views: both features by loops, each view's calibrated log odds, and the curve through their sum. Columns of
    other names, and extra ones that clash, are no matter."""
    r = random.Random(3)
    rows = [(i, words(r, r.randint(1, 40)) + r.choice(["", "!!", " 12 12 12", "\n\n| a | b |", " É é"]), r.choice(["en", None]), r.choice(["a", "b", None])) for i in range(30)] + [(30, None, None, None), (31, "", "", "")]
    rng = np.random.default_rng(0)
    one = lambda n: Q.Logistic(rng.normal(0, 0.1, n), rng.random(n) + 0.5, rng.normal(0, 0.05, n), 0.1, 1.2, -0.1)
    v = Q.Views(one(Q._WIDE), one(Q._META), 0.8, 0.05)
    df = spark.createDataFrame(rows, "k long, body string, l string, s string").withColumns({"score": F.lit("x"), "id": F.lit(1), "text": F.lit("y")})
    got = {x.k: x for x in Q.score(df, v, id_col="k", text_col="body", lang_col="l", source_col="s").collect()}
    for i, text, lang, source in rows:
        odds = []
        for m, x in zip((v.content, v.meta), plain_views(text, lang, source), strict=True):
            raw = sum(min(8.0, max(-8.0, (a - mu) / sd)) * w for a, mu, sd, w in zip(x, m.mean, m.scale, m.w, strict=True)) + m.b
            odds.append(min(12.0, max(-12.0, m.slope * raw + m.shift)))
        curve = lambda t: 1 / (1 + math.exp(-t))
        want = (curve(odds[0]), curve(odds[1]), curve(v.slope * sum(odds) + v.shift))
        assert np.allclose([got[i].score_content, got[i].score_metadata, got[i].score], want, atol=1e-9)


def test_every_row_outside_the_sample_takes_part(spark):
    """The sums over the table are those over all its rows, however it is dealt."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    a, b = (Q.train(docs.repartition(n), labels, max_labelled=150) for n in (2, 7))
    alone = Q.train(docs, labels, max_labelled=150, rounds=0)
    assert np.allclose(a.content.w, b.content.w, atol=1e-6) and np.allclose(a.meta.w, b.meta.w, atol=1e-6)
    assert not np.allclose(a.content.w, alone.content.w, atol=1e-4)
