"""Training hosts, scoring by Arrow, metrics at their edges, streaming against batch."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextloom.operators import features as feat
from contextloom.operators import metrics, models, scoring
from contextloom.plans.kernel import Kernel, Params
from contextloom.plans.train import decompose, register_udtf, sweep, train
from contextloom.runtime import ship
from contextloom.schema import observations, rejected
from contextloom.sources import files, synth
from contextloom.streaming.online import OnlineTrainer, replay
from contextloom.streaming.stateful import collective_stream, label_stream

P = Params(drift_threshold=1.2, drift_size=8, model_mem=40)


@pytest.fixture(scope="module")
def obs(spark):
    return synth.stream(spark, [60, 50, 40, 45], n_features=3, offset_scale=6.0, streams=3, seed=4).cache()


def by_kernel(obs, p, key=0):
    k, out = Kernel(p), []
    for r in obs.where(F.col("stream_key") == key).orderBy("seq").collect():
        out += k.step(r.seq, np.array(r.features))
    return k, [(s, c) for s, c, *_ in sorted(out + k.close())]


def found(df, key=0):
    return [(r.seq, r.context_id) for r in df.where(F.col("stream_key") == key).orderBy("seq").collect()]


def test_training_equals_the_kernel_however_rows_are_dealt(spark, obs):
    k, want = by_kernel(obs, P)
    for rows in (obs, obs.repartition(7, F.rand(3)), obs.coalesce(1)):
        t = train(rows, P)
        assert found(t.labels) == want
    assert len(k.models) > 1
    a = {(r.from_id, r.to_id): r.n for r in t.transitions.where("stream_key = 0").collect()}
    assert a == {e: n for e, n in k.transitions.items() if n}
    assert t.models.where("stream_key = 0").count() == len(k.models)


def test_true_concepts_are_found(spark, obs):
    t = train(obs, P)
    u = t.labels.join(obs, ["stream_key", "seq"]).where("stream_key = 0")
    assert metrics.adjusted_rand(metrics.contingency(u, "context_id", "truth")).first()[0] > 0.6


def test_sweep_of_one_is_a_run_and_groups_of_all_columns_too(spark, obs):
    want = found(train(obs, P).labels)
    s = sweep(obs, [replace(P, drift_threshold=9.0), P])
    assert found(s.labels.where("param_id = 1")) == want
    d = decompose(obs, [[0], [0, 1, 2]], P)
    assert found(d.labels.where("group_id = 1")) == want


def test_udtf(spark, obs):
    register_udtf(spark, P, "contexts_test")
    obs.where("stream_key = 0").select("stream_key", "seq", "features").createOrReplaceTempView("obs_test")
    got = spark.sql("SELECT seq, context_id FROM contexts_test(TABLE(obs_test) PARTITION BY stream_key ORDER BY seq) ORDER BY seq").collect()
    assert [tuple(r) for r in got] == by_kernel(obs, P)[1]


def test_saved_models_score_as_the_kernel_does(spark, obs, tmp_path):
    k, _ = by_kernel(obs, P)
    files.save(train(obs.where("stream_key = 0"), P), str(tmp_path / "m"))
    m = files.load(spark, str(tmp_path / "m")).models
    rows = scoring.predict(obs.where("stream_key = 0 and seq < 50"), m, all_scores=True).collect()
    for r in rows:
        s = [k.models[i].score(np.array(r.features)) for i in sorted(k.models)]
        assert np.allclose(r.scores, s) and np.isclose(r.score, min(s)) and r.context_id == sorted(k.models)[int(np.argmin(s))]


def test_arrow_and_sql_scores_agree(spark, obs):
    flat = obs.where("stream_key = 0").select("seq", "truth", "features", *(F.col("features")[i].alias(f"f{i}") for i in range(3)))
    cols = ["f0", "f1", "f2"]
    m = models.mean_cov(flat, "truth", cols).withColumn("model_id", F.col("truth") + 1)
    a = scoring.best(scoring.score_all(flat, m.drop("truth"), cols, ["seq"]), ["seq"]).orderBy("seq").collect()
    b = scoring.predict(flat.select("seq", "features"), models.fit(flat.select("truth", "seq", "features"), "truth", p_var=1.0, mem=10_000)).orderBy("seq").collect()
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-9) and [r.context_id for r in a] == [r.context_id for r in b]


def test_bad_rows_are_set_aside(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 2.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, 3.0, 4.0)], "t long, a double, b double")
    assert observations(df, ["a", "b"], "t").count() == 2 and rejected(df, ["a", "b"], "t").count() == 3


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4\n")
    assert [r.features for r in files.csv_observations(spark, str(tmp_path / "x.csv"), ["a", "b"]).orderBy("seq").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_metrics_at_their_edges(spark):
    one = spark.createDataFrame([(1, 1)] * 5, "u int, v int")
    c = metrics.contingency(one, "u", "v")
    assert metrics.rand_indices(c).first().adjusted == 0 and math.isnan(metrics.adjusted_rand(c).first()[0])
    s = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert metrics.auc(s, "s", "y").first()[0] == pytest.approx(0.875)
    r = spark.createDataFrame([(i, "abc"[i % 3], i % 4) for i in range(60)], "i int, u string, v int")
    x, y = (metrics.adjusted_rand(metrics.contingency(r, a, b)).first()[0] for a, b in (("u", "v"), ("v", "u")))
    assert x == pytest.approx(y)


def test_collective_window_longer_than_the_stream_and_of_one(spark):
    lab = spark.createDataFrame([(1, i, 1 + i % 2) for i in range(4)], "k int, seq long, context_id int")
    chain = spark.createDataFrame([(1, 2, 0.5)], "from_id int, to_id int, p double")
    run = lambda w: [r.anomaly for r in scoring.collective_anomaly(lab, chain, w, ["k"]).orderBy("seq").collect()]
    assert run(9) == [1.0] * 4 and run(1) == [1.0, 0.5, 0.0, 0.5]


def test_detectors_plan_has_one_shuffle_for_both_windows(spark):
    lab = spark.range(100).selectExpr("id % 3 as k", "id as seq", "cast(id % 2 as int) as context_id")
    chain = spark.createDataFrame([(1, 2, 0.5)], "from_id int, to_id int, p double")
    df = scoring.collective_anomaly(lab, chain, 5, ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_zscore_can_keep_the_test_rows_out(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 100.0)], "seq long, a double")
    got = feat.zscore(df, ["a"], fit_on=df.where("seq < 2"), names=["z"]).orderBy("seq").collect()
    assert [r.z for r in got[:2]] == pytest.approx([-0.7071067811, 0.7071067811])


def feed(spark, obs, folder, cuts):
    rows = obs.select("stream_key", "seq", "features", F.lit(False).alias("close"))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.parquet(f"{folder}/in/{i}")
        yield i
    ends = rows.groupBy("stream_key").agg((F.max("seq") + 1).alias("seq")).select("stream_key", "seq", F.lit(None).cast("array<double>").alias("features"), F.lit(True).alias("close"))
    late = rows.where("seq = 3 and stream_key = 1")
    ends.unionByName(late).coalesce(1).write.parquet(f"{folder}/in/end")
    yield -1


def test_streaming_with_restarts_equals_batch(spark, obs, tmp_path):
    ship(spark)
    want = found(train(obs, P).labels, 1)
    (tmp_path / "in").mkdir()
    schema = "stream_key long, seq long, features array<double>, close boolean"
    for _ in feed(spark, obs, str(tmp_path), [0, 70, 71, 200]):  # each step restarts the query from its checkpoint
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = label_stream(src, P).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("late").count() == 1
    assert found(got.where("not late"), 1) == want


def test_online_training_is_deterministic_and_learns_between_batches(spark, obs, tmp_path):
    a = OnlineTrainer(P, str(tmp_path / "a"))
    first = replay(a, obs, 4, 50)
    labels = found(first)
    again = {(r.stream_key, r.seq): r.context_id for r in first.collect()}
    a.process(obs.where("seq >= 150"), 3)  # the last batch runs again
    assert {(r.stream_key, r.seq): r.context_id for r in a.labels(spark).collect()} == again
    k = Kernel(replace(P, deferred=True))
    out = []
    for r in obs.where("stream_key = 0").orderBy("seq").collect():
        if r.seq and r.seq % 50 == 0:
            k.refresh()
        out += k.step(r.seq, np.array(r.features))
    assert labels == [(s, c) for s, c, *_ in sorted(out + k.close())]


def test_online_training_by_foreach_batch_equals_replay(spark, obs, tmp_path):
    want = found(replay(OnlineTrainer(P, str(tmp_path / "a")), obs, 4, 50))
    (tmp_path / "in").mkdir()
    b = OnlineTrainer(P, str(tmp_path / "b"))
    for v in range(4):  # each round restarts from the checkpoint
        obs.where((F.col("seq") >= v * 50) & (F.col("seq") < (v + 1) * 50)).select("stream_key", "seq", "features").coalesce(1).write.parquet(str(tmp_path / "in" / str(v)))
        src = spark.readStream.schema("stream_key long, seq long, features array<double>").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        src.writeStream.foreachBatch(b.process).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    b.finish(spark, 4)
    assert found(b.labels(spark)) == want
    with pytest.raises(RuntimeError, match="snapshot 7 is missing"):
        b.process(obs, 8)


HOSTS = replace(P, drift_size=5)


def test_tied_rows_are_late_in_every_host(spark, tmp_path):
    """Rows with a seq that was there before: the one of the least features counts, the others come out with nulls."""
    r = np.random.default_rng(3)
    rows = [(1, i, (r.normal(0, 1, 2) + 6 * (i // 30 % 2)).tolist()) for i in range(90)]
    twice = [(1, 40, [99.0, 0.0]), (1, 40, [99.0, 1.0]), (1, 0, [99.0, 0.0])]
    df = spark.createDataFrame([*rows, *twice], "stream_key long, seq long, features array<double>").repartition(3)
    k, want = Kernel(HOSTS), []
    for _, s, x in rows:
        want += k.offer(s, np.array(x))
    want = sorted((s, c) for s, c, *_ in want + k.close())
    ship(spark)
    batch = train(df, HOSTS).labels
    swept = sweep(df, [P, HOSTS]).labels.where("param_id = 1").drop("param_id")
    online = replay(OnlineTrainer(HOSTS, str(tmp_path / "o")), df, 1, 100)
    register_udtf(spark, HOSTS, "ties_test")
    df.createOrReplaceTempView("ties")
    udtf = spark.sql("SELECT 1L AS stream_key, * FROM ties_test(TABLE(ties) PARTITION BY stream_key ORDER BY (seq, features))")
    df.select("*", F.lit(False).alias("close")).union(spark.createDataFrame([(1, 89, None, True)], "stream_key long, seq long, features array<double>, close boolean")).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    src = spark.readStream.schema("stream_key long, seq long, features array<double>, close boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    label_stream(src, HOSTS).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out"))
    for got in (batch, swept, online, udtf, stream):
        got = got.collect()
        assert sorted(x.seq for x in got if x.context_id is None) == [0, 40, 40] and len(got) == 93
        if got and "late" in got[0]:
            assert all(x.late == (x.context_id is None) for x in got)
    for got in (batch, swept, udtf, stream):
        assert sorted((x.seq, x.context_id) for x in got.collect() if x.context_id is not None) == want


@pytest.mark.parametrize("change", [{"model_backend": "incremental"}, {}])
def test_streaming_with_merging_equals_batch(spark, tmp_path, change):
    p = replace(P, model_limit=2, drift_size=6, **change)
    obs = synth.stream(spark, [40, 30, 40, 30, 40, 30, 40], n_features=3, n_concepts=4, offset_scale=9.0, seed=2).cache()
    want = train(obs, p)
    ship(spark)
    (tmp_path / "in").mkdir()
    for i, (a, b) in enumerate([(0, 90), (90, 91), (91, 160), (160, 999)]):
        rows = obs.where((F.col("seq") >= a) & (F.col("seq") < b)).select("stream_key", "seq", "features", F.lit(False).alias("close"))
        if b == 999:
            rows = rows.union(spark.createDataFrame([(0, 999, None, True)], "stream_key long, seq long, features array<double>, close boolean"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        src = spark.readStream.schema("stream_key long, seq long, features array<double>, close boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        label_stream(src, p).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert want.labels.agg(F.max("context_id")).first()[0] > 2
    assert found(spark.read.parquet(str(tmp_path / "out"))) == found(want.labels)


def test_auc_is_the_same_however_the_plan_runs(spark):
    df = spark.range(5000).select((F.round(F.rand(5) * 300) / 7).alias("s"), (F.rand(6) < 0.4).cast("int").alias("y")).cache()
    rows = df.collect()
    pos, neg = [r.s for r in rows if r.y], [r.s for r in rows if not r.y]
    raw = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    try:
        for reuse in ("true", "false"):
            for parts in ("1", "4", "64"):
                spark.conf.set("spark.sql.exchange.reuse", reuse)
                spark.conf.set("spark.sql.shuffle.partitions", parts)
                for rows_a_range in (1_000_000, 37):
                    assert metrics.auc(df, "s", "y", rows_a_range).first()[0] == pytest.approx(max(raw, 1 - raw), abs=1e-12)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_models_in_blocks_score_as_at_once(spark, obs):
    m = train(obs.where("stream_key = 0"), replace(P, drift_threshold=0.7)).models
    rows = obs.where("stream_key = 0").drop("truth")
    a, b = (sorted(map(str, scoring.predict(rows, m, all_scores=True, most=n).collect())) for n in (10**6, 13))
    assert m.count() > 3 and a == b
    assert scoring.predict(rows, m.where("false")).where("context_id is null").count() == rows.count()
    flat = rows.select("seq", *(F.col("features")[i].alias(f"f{i}") for i in range(3)), (F.col("seq") % 5).alias("g"))
    own = models.mean_cov(flat, "g", ["f0", "f1", "f2"]).withColumnRenamed("g", "model_id")
    x, y = (sorted(map(str, scoring.score_all(flat, own, ["f0", "f1", "f2"], ["seq"], block=n).collect())) for n in (100, 2))
    assert x == y and len(x) == 5 * rows.count()


def test_scores_by_key_and_by_sql_function(spark, obs):
    t = train(obs, P)
    got = {(r.stream_key, r.seq): (r.context_id, r.score) for r in scoring.score_keyed(obs, t.models).collect()}
    one = scoring.predict(obs.where("stream_key = 1"), t.models.where("stream_key = 1")).collect()
    assert all(got[1, r.seq][0] == r.context_id and got[1, r.seq][1] == pytest.approx(r.score) for r in one) and len(got) == obs.count()
    scoring.register_udf(spark, t.models.where("stream_key = 1"), "score_test")
    obs.where("stream_key = 1").createOrReplaceTempView("obs_udf")
    by_sql = {r.seq: (r.b.context_id, r.b.score) for r in spark.sql("SELECT seq, score_test(features) AS b FROM obs_udf").collect()}
    assert by_sql == {r.seq: (r.context_id, r.score) for r in one}


def test_collective_detector_on_a_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(1)
    lab = spark.createDataFrame([(k, i, int(r.integers(1, 4))) for k in range(3) for i in range(40)], "stream_key long, seq long, context_id int").cache()
    chain = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (3, 3, 1.0)], "from_id int, to_id int, p double")
    (tmp_path / "in").mkdir()
    for w in (4, 1):
        for i, (a, b) in enumerate([(0, 3), (3, 17), (17, 40)]):
            lab.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in{w}/{i}")
            src = spark.readStream.schema("stream_key long, seq long, context_id int").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in{w}")
            collective_stream(src, chain, w).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck{w}").option("path", f"{tmp_path}/out{w}").trigger(availableNow=True).start().awaitTermination()
        got = {(x.stream_key, x.seq): x.anomaly for x in spark.read.parquet(f"{tmp_path}/out{w}").collect()}
        want = {(x.stream_key, x.seq): x.anomaly for x in scoring.collective_anomaly(lab, chain, w, ["stream_key"]).collect()}
        assert got == pytest.approx(want) and len(got) == 120


def test_find_rank_is_strict(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 1.0), ("b", 5.0)], "g string, v double")
    run = lambda s: {r.g: r["rank"] for r in models.find_rank(df, "g", "v", s).collect()}
    assert run(0.5) == {"a": 2, "b": 1} and run(0.49) == {"a": 1, "b": 1} and run(1.0) == {"a": 3, "b": 1}


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from contextloom import runtime

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(type("S", (), {"sparkContext": Context()})())
