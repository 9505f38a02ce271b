import random
from collections import Counter

import corpus_pipeline
import numpy as np
from brute import hits, near_groups, shingle_set
from fixtures import words

from contextloom.llm import mixing, near_dup, packing, toxicity

DIR = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_in_plain_python(spark, documents):
    rows = {r.doc_id: r for r in documents.collect()}
    bad = {r.doc_id for r in toxicity.op7(spark, DIR).collect() if r.predicted}
    left = {i: r.text for i, r in rows.items() if i not in bad}
    left = {i: left[i] for i, v in near_groups(list(left.items())).items() if v[3] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    left = {i: t for i, t in left.items() if not hits(t, items)[1]}
    got = {}
    for r in corpus_pipeline.run(spark, DIR).collect():
        for d, o, x in packing.unpack(r):
            got.setdefault(d, []).append((o, x))
    t = packing.tokenizer(packing.default_tokenizer())
    want = {i: t.bpe.encode_ordinary(x) for i, x in left.items()}
    assert set(got) == {i for i, x in want.items() if x}
    for i, parts in got.items():
        assert np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]).tolist() == want[i]


def test_stages_return_the_columns_of_documents(spark, documents, nothing):
    docs = nothing.select(documents.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == documents.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == 0


def test_packing_windows_follow_the_mixed_order(spark, documents, tmp_path):
    corpus_pipeline.mix_sources(spark, documents, DIR).repartition(6).write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    at = {r.doc_id: r.position for r in mixing.positions(docs).collect()}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rows = corpus_pipeline.pack_tokens(spark, docs, DIR).collect()
    finally:
        spark.conf.unset(key)
    windows = {}
    for r in rows:
        windows.setdefault(r.pack_id >> 40, []).extend(at[d] for d in r.doc_ids)
    assert len(windows) > 1
    order = [windows[k] for k in sorted(windows)]
    assert all(max(a) < min(b) for a, b in zip(order[:-1], order[1:], strict=True))


def test_messy_documents_through_all_stages(spark, documents, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and repeated ids, together with clean documents."""
    r = random.Random(6)
    long, base = words(r, 40_000), words(r, 70)
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    item = next(x.text for x in bench.collect() if len((x.text or "").split()) > 15)
    texts = [None, "", " ", "one two", "one  two", base, base, base + " tail", long, long + " x", f"{words(r, 5)} {item}", words(r, 30), words(r, 31)]
    odd = [(10**6 + i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    odd += [odd[11], odd[11], (10**6 + 11, words(r, 33), None, None, None), (None, words(r, 20), None, None, None), (None, None, None, None, None)]
    docs = documents.limit(60).unionByName(spark.createDataFrame(odd, documents.schema)).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    bad = Counter(x.doc_id for x in toxicity.op7(spark, str(tmp_path)).collect() if x.predicted)
    assert not any(i is None or i >= 10**6 for i in bad)
    left = [x for x in rows if x[0] not in bad]
    # Near copies: one row of each group of texts stays, the least id's; rows without an id stay.
    named = sorted({(x[0], x[1] or "") for x in left if x[0] is not None})
    keys = {}
    for i, t in named:
        keys.setdefault(shingle_set(t) or t, (i, t))
    numbered = list(enumerate(sorted(keys.values())))
    groups = near_groups([(k, t) for k, (_, t) in numbered])
    stays = {(i, shingle_set(t) or t) for k, (i, t) in numbered if groups[k][3] == k}
    items = [tuple(x) for x in bench.select("item_id", "text").collect()]
    clean = lambda t: not hits(t, items)[1]
    want = Counter(i for i, k in stays if clean(next(t for j, t in named if j == i and (shingle_set(t) or t) == k)))
    want += Counter(None for x in left if x[0] is None and clean(x[1]))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == documents.columns
    assert Counter(x.doc_id for x in at.collect()) == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = packing.tokenizer(packing.default_tokenizer())
    assert sum(x.n_tokens for x in packed) == sum(len(t.bpe.encode_ordinary(x.text or "")) for x in at.collect())
    assert near_dup.keep_one(at).count() == at.count()
