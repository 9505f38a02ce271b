import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from util import same

from contextloom.llm import exact_dedup as X


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40), st.integers(0, 99)), max_size=200))
def test_index_equals_a_dictionary(steps):
    index, want = X.CuckooIndex(buckets=2), {}
    for insert, key, i in steps:
        d = hashlib.sha256(bytes([key])).digest()
        if insert:
            index.add(d, i)
            k, n = want.get(d, (i, 0))
            want[d] = (min(k, i), n + 1)
        else:
            assert index.delete(d) == (want.pop(d, None) is not None)
    assert {bytes(e[0]): (e[1], e[2]) for e in index.entries()} == want and index.live == len(want)
    assert all(hashlib.sha256(bytes([k])).digest() in index or hashlib.sha256(bytes([k])).digest() not in want for k in range(41))


def test_index_grows_without_loss():
    index = X.CuckooIndex(buckets=2)
    for i in range(5000):
        index.add(hashlib.sha256(str(i).encode()).digest(), i)
    assert index.live == 5000 and index.n >= 1250 and sorted(e[1] for e in index.entries()) == list(range(5000))


def test_documents_equal_sql(spark, duck):
    same(X.op3(spark, "/root/testdata/sf0.001").toPandas(), duck.execute(X.OP3_SQL).df())


def test_messy_rows(messy, messy_rows, nothing):
    got = X.groups(messy).collect()
    by = {}
    for r in messy_rows:
        by.setdefault(sha(r[1]), []).append(r[0])
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((r[0], sha(r[1])) for r in messy_rows)
    for r in got:
        ids = [i for i in by[r.text_sha256] if i is not None]
        assert r.keep_id == (min(ids) if ids else None) and r.group_size == len(by[r.text_sha256])
        assert r.kept == (r.doc_id == r.keep_id or r.keep_id is None)
    left = X.drop_copies(messy)
    assert left.columns == messy.columns
    assert Counter(sha(r.text) for r in left.collect()) == Counter(set(by))
    assert X.groups(nothing).count() == 0 and X.drop_copies(nothing).count() == 0


def test_drop_copies_without_repeats(documents):
    want = {}
    for r in documents.collect():
        want[sha(r.text)] = min(r.doc_id, want.get(sha(r.text), r.doc_id))
    assert {r.doc_id for r in X.drop_copies(documents).collect()} == set(want.values())


def test_a_group_of_most_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).otherwise("same").alias("text"))
    got = X.groups(df).where("keep_id = 1").agg(F.count("*"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (3000, 3000, 1)


def test_update_retires_and_inserts(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, text string").select("id", X.digest("text").alias("digest"))
    live = X.index(rows((1, "a"), (2, "a"), (3, "b")))
    after = X.update(live, rows((4, "b"), (5, "c"), (9, "a")), rows((0, "a")).select("digest"))
    assert {(r.keep_id, r.group_size) for r in after.collect()} == {(9, 1), (3, 2), (5, 1)}


def test_a_full_fold_is_put_out_and_begun_anew(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), X.digest((F.col("id") % 700).cast("string")).alias("digest")).coalesce(2)
    rows = df.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).toArrow().to_batches(max_chunksize=100)
    out = [r for b in X._fold(iter(rows), 150) for r in b.to_pylist()]
    assert len(out) > 700 and sum(r["group_size"] for r in out) == 3000
    monkeypatch.setattr(X, "FOLD_DIGESTS", 50)
    monkeypatch.setattr(X, "SHARD_DIGESTS", 100)
    assert X._parts(df) == 31
    assert sorted((r.keep_id, r.group_size) for r in X.index(df).collect()) == [(i, 5 if i < 200 else 4) for i in range(700)]
