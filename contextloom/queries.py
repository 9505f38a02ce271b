"""Queries on the events, embeddings and lineitem tables, each with its SQL where SQL can say the same.

Events are the stream: a user's rows in order of time, with two features, the value and the seconds since the user's
previous event, both standardised; a user's first event has no gap and is left out. Contexts are frozen models, one per
event type in order of name, unless the query trains.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextloom import oracles
from contextloom.operators import features as feat
from contextloom.operators import frozen, metrics, models, scoring, transitions
from contextloom.plans.kernel import Params
from contextloom.plans.train import decompose, feature_groups, sweep, train
from contextloom.runtime import cut, scratch
from contextloom.sources import files

COLS = ["x1", "x2"]
THRESHOLD = 2.5
R = 6


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, seq, value, gap."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", F.col("value").cast("double").alias("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumns({"gap": (us - F.lag(us).over(w)) / F.lit(1e6), "seq": (F.row_number().over(w) - 2).cast("long")})
    return e.where(F.col("gap").isNotNull() & F.col("value").isNotNull()).drop("ts")


EVENTS = """e0 AS (SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS value,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap, row_number() OVER w - 2 AS seq FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT * FROM e0 WHERE gap IS NOT NULL AND value IS NOT NULL)"""
Z = EVENTS + """, m AS (SELECT avg(value) AS m1, stddev_samp(value) AS d1, avg(gap) AS m2, stddev_samp(gap) AS d2 FROM e),
z AS MATERIALIZED (SELECT event_id, user_id, event_type, seq, (value - m1) / (d1 + 1e-14) AS x1, (gap - m2) / (d2 + 1e-14) AS x2 FROM e CROSS JOIN m)"""
M = Z + """, g AS (SELECT event_type, count(*) AS n, avg(x1) AS mu_0, avg(x2) AS mu_1, covar_samp(x1, x1) AS s_0_0, covar_samp(x1, x2) AS s_0_1, covar_samp(x2, x2) AS s_1_1 FROM z GROUP BY event_type),
mm AS (SELECT *, row_number() OVER (ORDER BY event_type) AS model_id FROM g)"""
S = M + """, sc AS (SELECT event_id, user_id, z.event_type AS event_type, seq, model_id,
  sqrt(greatest(s_0_0 * (x1 - mu_0) * (x1 - mu_0) + 2 * s_0_1 * (x1 - mu_0) * (x2 - mu_1) + s_1_1 * (x2 - mu_1) * (x2 - mu_1), 0)) AS score FROM z CROSS JOIN mm)"""
P = S + """, p AS MATERIALIZED (SELECT event_id, user_id, event_type, seq, model_id AS context_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score, model_id) AS rk FROM sc) WHERE rk = 1)"""
A = P + """, l AS (SELECT *, coalesce(lag(context_id) OVER (PARTITION BY user_id ORDER BY seq), context_id) AS from_id FROM p),
a AS (SELECT from_id, context_id AS to_id, count(*) AS n FROM l GROUP BY 1, 2)"""
#: The same counts over the event types themselves.
T = Z + """, ty AS (SELECT DISTINCT event_type FROM z), id AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS context_id FROM ty),
tl AS (SELECT z.*, context_id, coalesce(lag(context_id) OVER (PARTITION BY user_id ORDER BY seq), context_id) AS from_id FROM z JOIN id USING (event_type)),
a AS (SELECT from_id, context_id AS to_id, count(*) AS n FROM tl GROUP BY 1, 2)"""
C = A + """, ch AS (SELECT from_id, to_id, n, n / sum(n) OVER (PARTITION BY from_id) AS p FROM a)"""


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.zscore(events(spark, sf_dir), ["value", "gap"], names=COLS).select("event_id", "user_id", "event_type", "seq", *COLS)


def ids(df: DataFrame, by: str) -> DataFrame:
    """Groups numbered from 1 by name; they are few."""
    return df.withColumn("model_id", F.row_number().over(Window.orderBy(by)))


def type_models(z: DataFrame) -> DataFrame:
    return ids(models.mean_cov(z, "event_type", COLS), "event_type")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = cut(standard(spark, sf_dir))  # once for the models and the rows
    found = scoring.best_inline(z, scoring.bounded(type_models(z), 64), COLS)
    return found.select("event_id", "user_id", "event_type", "seq", "context_id", "score")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = standard(spark, sf_dir)
    names = F.broadcast(ids(z.select("event_type").distinct(), "event_type").withColumnRenamed("model_id", "context_id"))
    return z.join(names, "event_type")


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("SELECT") else "WITH RECURSIVE " + sql
        return f

    return add


@query(EVENTS + " SELECT event_id, user_id, CAST(seq AS BIGINT) AS seq, round(gap, 6) AS gap FROM e")
def seq_index_events(spark, d):
    return events(spark, d).select("event_id", "user_id", "seq", r6("gap").alias("gap"))


@query(Z + " SELECT event_id, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM z")
def zscore_events(spark, d):
    return standard(spark, d).select("event_id", r6("x1").alias("x1"), r6("x2").alias("x2"))


@query(EVENTS + ", n AS (SELECT user_id, floor(0.8 * count(*)) AS k FROM e GROUP BY 1), t AS (SELECT avg(value) AS m1, stddev_samp(value) AS d1 FROM e JOIN n USING (user_id) WHERE seq < k) SELECT event_id, round((value - m1) / (d1 + 1e-14), 6) AS x1 FROM e JOIN n USING (user_id) CROSS JOIN t WHERE seq >= k")
def zscore_train_only_events(spark, d):
    first, rest = feat.split(events(spark, d), 0.8, ["user_id"])
    return feat.zscore(rest, ["value"], fit_on=first, names=["x1"]).select("event_id", r6("x1").alias("x1"))


@query(EVENTS + ", n AS (SELECT user_id, floor(0.8 * count(*)) AS k FROM e GROUP BY 1) SELECT event_id, user_id, CAST(seq AS BIGINT) AS seq, CASE WHEN seq < k THEN 'train' ELSE 'test' END AS part FROM e JOIN n USING (user_id)")
def split_prefix_events(spark, d):
    a, b = feat.split(events(spark, d), 0.8, ["user_id"])
    part = lambda x, s: x.select("event_id", "user_id", "seq", F.lit(s).alias("part"))
    return part(a, "train").unionByName(part(b, "test"))


@query(EVENTS + " SELECT event_id, user_id, CAST(seq AS BIGINT) AS seq FROM e WHERE seq < 25")
def init_rows_events(spark, d):
    return feat.prefix(events(spark, d), 25).select("event_id", "user_id", "seq")


@query(EVENTS + " SELECT user_id, CAST(floor(seq / 20) AS BIGINT) AS chunk_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM e GROUP BY 1, 2")
def chunk_events(spark, d):
    return feat.chunk(events(spark, d), 20).groupBy("user_id", "chunk_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(EVENTS + " SELECT event_id, event_type, round(value, 6) AS value FROM e WHERE event_type = 'view'")
def train_sanitized_events(spark, d):
    return feat.sanitise(events(spark, d), "event_type", "view").select("event_id", "event_type", r6("value").alias("value"))


@query(EVENTS + " SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS truth FROM e")
def label_recode_events(spark, d):
    return events(spark, d).select("event_id", feat.recode("event_type", "view").alias("truth"))


_GROUPS = [[0, 1], [2, 3], [0, 3]]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as a stream per order; (l_orderkey, l_linenumber) repeats, so all columns give the order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = ["l_linenumber", "l_partkey", "l_suppkey", *nums, "l_returnflag", "l_linestatus", "l_shipdate"]
    s = feat.with_seq(li, ["l_orderkey"], order)
    return s.select(F.col("l_orderkey").alias("stream_key"), "seq", F.array(*(F.col(c).cast("double") for c in nums)).alias("features"))


@query("""SELECT g.group_id, stream_key, CAST(seq AS BIGINT) AS seq, round(CASE g.group_id WHEN 0 THEN q WHEN 1 THEN dc ELSE q END, 6) AS f0, round(CASE g.group_id WHEN 0 THEN pr WHEN 1 THEN tx ELSE tx END, 6) AS f1
FROM (SELECT l_orderkey AS stream_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq,
  l_quantity AS q, l_extendedprice AS pr, l_discount AS dc, l_tax AS tx FROM lineitem) CROSS JOIN (VALUES (0), (1), (2)) g(group_id)""")
def feature_groups_lineitem(spark, d):
    g = feature_groups(lines(spark, d), _GROUPS)
    return g.select("group_id", "stream_key", "seq", r6(F.col("features")[0]).alias("f0"), r6(F.col("features")[1]).alias("f1"))


@query(M + " SELECT event_type, n, round(mu_0, 6) AS mu_0, round(mu_1, 6) AS mu_1, round(s_0_0, 6) AS s_0_0, round(s_0_1, 6) AS s_0_1, round(s_1_1, 6) AS s_1_1 FROM g")
def model_mean_cov_events(spark, d):
    m = models.mean_cov(standard(spark, d), "event_type", COLS)
    return m.select("event_type", "n", *(r6(c).alias(c) for c in m.columns[2:]))


EIG = M + """, ei AS (SELECT event_type, (s_0_0 + s_1_1) / 2 + sqrt((s_0_0 - s_1_1) * (s_0_0 - s_1_1) / 4 + s_0_1 * s_0_1) AS l1, (s_0_0 + s_1_1) / 2 - sqrt((s_0_0 - s_1_1) * (s_0_0 - s_1_1) / 4 + s_0_1 * s_0_1) AS l2 FROM g)"""


def _eigen(spark, d):
    m = models.mean_cov(standard(spark, d), "event_type", COLS)
    a, b = models.eigen2(F.col("s_0_0"), F.col("s_0_1"), F.col("s_1_1"))
    return m.select("event_type", a.alias("l1"), b.alias("l2"))


@query(EIG + " SELECT event_type, round(l1, 6) AS l1, round(greatest(l2, 0), 6) AS l2, round(l1 / (l1 + l2), 6) AS share FROM ei")
def model_eigen2_events(spark, d):
    return _eigen(spark, d).select("event_type", r6("l1").alias("l1"), r6("l2").alias("l2"), r6(F.col("l1") / (F.col("l1") + F.col("l2"))).alias("share"))


@query(EIG + " SELECT event_type, CAST(CASE WHEN l1 / (l1 + l2) >= 0.52 THEN 1 ELSE 2 END AS BIGINT) AS n_pcs FROM ei")
def component_count_events(spark, d):
    e = _eigen(spark, d).select("event_type", F.explode(F.array("l1", "l2")).alias("v"))
    return models.component_count(e, "event_type", "v", 0.52)


@query(S + " SELECT event_id, CAST(model_id AS BIGINT) AS model_id, round(score, 6) AS score FROM sc")
def score_all_events(spark, d):
    z = standard(spark, d)
    return longs(scoring.score_all(z, type_models(z), COLS, ["event_id"]), "model_id").select("event_id", "model_id", r6("score").alias("score"))


@query(P + " SELECT event_id, CAST(context_id AS BIGINT) AS context_id, round(score, 6) AS score FROM p")
def predict_events(spark, d):
    z = standard(spark, d)
    return longs(scoring.best(scoring.score_all(z, type_models(z), COLS, ["event_id"]), ["event_id"]), "context_id").select("event_id", "context_id", r6("score").alias("score"))


@query(P + " SELECT event_id, user_id, event_type, CAST(context_id AS BIGINT) AS context_id, round(score, 6) AS anomaly, score > 2.5 AS is_outlier FROM p")
def point_anomaly_events(spark, d):
    return longs(scoring.point_anomaly(predicted(spark, d)), "context_id").select("event_id", "user_id", "event_type", "context_id", r6("anomaly").alias("anomaly"), (F.col("score") > THRESHOLD).alias("is_outlier"))


@query(A + ", ra AS (SELECT to_id, sum(n) / sum(sum(n)) OVER () AS rarity FROM a GROUP BY 1) SELECT event_id, round(CASE WHEN score < 2.5 THEN coalesce(rarity, 0) ELSE 0 END, 6) AS anomaly FROM p LEFT JOIN ra ON ra.to_id = p.context_id")
def context_anomaly_events(spark, d):
    p = predicted(spark, d)
    a = transitions.pooled(transitions.counts(p, ["user_id"]))
    return scoring.context_anomaly(p, transitions.rarity(a), THRESHOLD).select("event_id", r6("anomaly").alias("anomaly"))


@query(C + """, t AS (SELECT event_id, l.user_id, seq, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE coalesce(ch.p, 0) END AS p, row_number() OVER w AS k
  FROM l LEFT JOIN ch ON ch.from_id = l.from_id AND ch.to_id = l.context_id WINDOW w AS (PARTITION BY l.user_id ORDER BY seq))
SELECT event_id, round(CASE WHEN k >= 5 THEN avg(p) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE 1 END, 6) AS anomaly FROM t""")
def collective_anomaly_events(spark, d):
    p = predicted(spark, d)
    chain = transitions.markov(transitions.pooled(transitions.counts(p, ["user_id"])))
    return scoring.collective_anomaly(p, chain, 5, ["user_id"]).select("event_id", r6("anomaly").alias("anomaly"))


def _pooled(spark, d):
    return transitions.pooled(transitions.counts(typed(spark, d), ["user_id"]))


@query(T + " SELECT CAST(from_id AS BIGINT) AS from_id, CAST(to_id AS BIGINT) AS to_id, CAST(n AS BIGINT) AS n FROM a")
def transition_counts_events(spark, d):
    return longs(_pooled(spark, d), "from_id", "to_id")


@query(T + " SELECT CAST(from_id AS BIGINT) AS from_id, CAST(to_id AS BIGINT) AS to_id, round(n / sum(n) OVER (PARTITION BY from_id), 6) AS p FROM a")
def markov_events(spark, d):
    return longs(transitions.markov(_pooled(spark, d)), "from_id", "to_id").select("from_id", "to_id", r6("p").alias("p"))


@query(T + " SELECT CAST(to_id AS BIGINT) AS to_id, round(sum(n) / (SELECT sum(n) FROM a), 6) AS rarity FROM a GROUP BY 1")
def node_rarity_events(spark, d):
    return longs(transitions.rarity(_pooled(spark, d)), "to_id").select("to_id", r6("rarity").alias("rarity"))


@query(T + ", b AS (SELECT from_id, to_id, n / sum(n) OVER (PARTITION BY from_id) AS p FROM a) SELECT CAST(from_id AS BIGINT) AS from_id, CAST(to_id AS BIGINT) AS next_id, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY p DESC, to_id) AS k FROM b) WHERE k = 1")
def next_context_events(spark, d):
    return longs(transitions.next_context(transitions.markov(_pooled(spark, d))), "from_id", "next_id").select("from_id", "next_id", r6("p").alias("p"))


@query(T + " SELECT CAST(from_id AS BIGINT) AS from_id, CAST(sum(n) AS BIGINT) AS degree, rank() OVER (ORDER BY sum(n), from_id) AS place FROM a GROUP BY from_id")
def out_degree_events(spark, d):
    deg = transitions.out_degree(_pooled(spark, d))
    return longs(deg.withColumn("place", F.rank().over(Window.orderBy("degree", "from_id"))), "from_id", "place")


@query(T + ", dg AS (SELECT from_id, sum(n) AS degree FROM a GROUP BY 1) SELECT CAST(CASE WHEN degree >= 5000 THEN 11 ELSE floor(degree / 500) + 1 END AS BIGINT) AS bin, count(*) AS n FROM dg GROUP BY 1")
def degree_hist_events(spark, d):
    return longs(transitions.degree_histogram(transitions.out_degree(_pooled(spark, d)), 10, 0, 5_000), "bin")


@query(P + " SELECT CAST(context_id AS BIGINT) AS u, event_type AS v, count(*) AS n FROM p GROUP BY 1, 2")
def contingency_events(spark, d):
    return longs(metrics.contingency(predicted(spark, d), "context_id", "event_type"), "u")


CT = P + """, ct AS (SELECT context_id AS u, event_type AS v, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1, 2),
q AS (SELECT (SELECT sum(n) FROM ct) AS n, (SELECT sum(n * (n - 1) / 2) FROM ct) AS p, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY u)) AS pu, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY v)) AS pv),
q2 AS (SELECT *, n * (n - 1) / 2 AS t FROM q)"""


@query(CT + " SELECT round((p - pu * pv / t) / ((pu + pv) / 2 - pu * pv / t), 6) AS adjusted, round((t + 2 * p - pu - pv) / t, 6) AS rand, round(1 - (t + 2 * p - pu - pv) / t, 6) AS mirkin, round(2 * (t + 2 * p - pu - pv) / t - 1, 6) AS hubert FROM q2")
def rand_indices_events(spark, d):
    x = metrics.rand_indices(metrics.contingency(predicted(spark, d), "context_id", "event_type"))
    return x.select(*(r6(c).alias(c) for c in x.columns))


@query(CT + " SELECT round((p - pu * pv / t) / ((pu + pv) / 2 - pu * pv / t), 6) AS ari FROM q2")
def ari_events(spark, d):
    return metrics.adjusted_rand(metrics.contingency(predicted(spark, d), "context_id", "event_type")).select(r6("ari").alias("ari"))


@query(P + """, x AS (SELECT round(score, 6) AS s, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS y FROM p),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x),
u AS (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS v FROM k) SELECT round(greatest(v, 1 - v), 6) AS auc FROM u""")
def auc_events(spark, d):
    p = predicted(spark, d).select(r6("score").alias("score"), feat.recode("event_type", "view").alias("truth"))
    return metrics.auc(p, "score", "truth").select(r6("auc").alias("auc"))


@query(P + " SELECT CAST(context_id AS BIGINT) AS context_id, count(*) AS n FROM p GROUP BY 1")
def cluster_sizes_events(spark, d):
    return longs(metrics.cluster_sizes(predicted(spark, d)), "context_id")


@query(P + """, f AS (SELECT user_id, seq, score > 1.5 AS o, row_number() OVER (PARTITION BY user_id ORDER BY seq) - row_number() OVER (PARTITION BY user_id, score > 1.5 ORDER BY seq) AS i FROM p)
SELECT user_id, CAST(min(seq) AS BIGINT) AS run_start, CAST(max(seq) AS BIGINT) AS run_end, count(*) AS length FROM f WHERE o GROUP BY user_id, i""")
def drift_runs_events(spark, d):
    return frozen.drift_runs(predicted(spark, d), 1.5, ["user_id"])


@query(P + """, f AS (SELECT event_id, user_id, seq, CASE WHEN score > 1.0 THEN 1 ELSE 0 END AS o FROM p),
v AS (SELECT event_id, o, sum(o) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n_out, lag(o, 5) OVER w AS old, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT event_id, CAST(n_out AS BIGINT) AS n_out, k >= 6 AND o = 1 AND coalesce(old, 0) = 1 AND n_out > 3 AS detected FROM v""")
def v2_detect_window_events(spark, d):
    return frozen.window_drift(predicted(spark, d), 1.0, 6, ["user_id"]).select("event_id", "n_out", "detected")


@query(P + " SELECT * FROM (SELECT event_id, CAST(context_id AS BIGINT) AS context_id, row_number() OVER (PARTITION BY context_id ORDER BY event_id DESC) AS age FROM p) WHERE age <= 50")
def retained_memory_events(spark, d):
    return longs(frozen.retained_memory(predicted(spark, d), 50, ["context_id"], "event_id"), "context_id").select("event_id", "context_id", "age")


@query(P + """, r AS (SELECT event_id, context_id, row_number() OVER (PARTITION BY context_id ORDER BY event_id DESC) AS age FROM p WHERE context_id <= 2),
k AS (SELECT event_id, context_id - 1 AS side, age FROM r WHERE age <= 50) SELECT event_id, CAST(side AS INTEGER) AS side, row_number() OVER (ORDER BY age, side) AS place FROM k""")
def interleave_events(spark, d):
    kept = frozen.retained_memory(predicted(spark, d).where("context_id <= 2"), 50, ["context_id"], "event_id")
    side = lambda i: kept.where(F.col("context_id") == i).select("event_id")
    return frozen.interleave(side(1), side(2), "event_id").select("event_id", "side", "place")


@query(P + " SELECT CAST(context_id AS BIGINT) AS model_id, m AS last_update_seq FROM (SELECT context_id, max(event_id) AS m FROM p GROUP BY 1) ORDER BY m, context_id LIMIT 1")
def oldest_model_events(spark, d):
    m = predicted(spark, d).groupBy(F.col("context_id").alias("model_id")).agg(F.max("event_id").alias("last_update_seq"))
    return longs(frozen.oldest_model(m), "model_id")


@query(M + """, c AS (SELECT a.model_id, b.model_id AS near_id, sqrt((a.mu_0 - b.mu_0) * (a.mu_0 - b.mu_0) + (a.mu_1 - b.mu_1) * (a.mu_1 - b.mu_1)) AS distance FROM mm a JOIN mm b ON a.model_id <> b.model_id)
SELECT CAST(model_id AS BIGINT) AS model_id, CAST(near_id AS BIGINT) AS near_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY distance, near_id) AS k FROM c) WHERE k = 1""")
def nearest_model_events(spark, d):
    return longs(frozen.nearest_model(type_models(standard(spark, d)), ["mu_0", "mu_1"]), "model_id", "near_id").select("model_id", "near_id", r6("distance").alias("distance"))


@query(P + " SELECT event_id, CAST(context_id AS BIGINT) AS context_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM p) WHERE k = 1")
def classify_last_events(spark, d):
    last = predicted(spark, d).groupBy("user_id").agg(F.max_by(F.struct("event_id", "context_id", "score"), "seq").alias("b")).select("b.*")
    return longs(last, "context_id").select("event_id", "context_id", r6("score").alias("score"))


@query(M + """, pr(param_id, thr) AS (VALUES (0, 1.5), (1, 2.5), (2, 3.5)),
sc AS (SELECT event_id, min(sqrt(greatest(s_0_0 * (x1 - mu_0) * (x1 - mu_0) + 2 * s_0_1 * (x1 - mu_0) * (x2 - mu_1) + s_1_1 * (x2 - mu_1) * (x2 - mu_1), 0))) AS score FROM z CROSS JOIN mm GROUP BY event_id)
SELECT param_id, CAST(count(*) FILTER (WHERE score > thr) AS BIGINT) AS n_out FROM sc CROSS JOIN pr GROUP BY param_id""")
def threshold_sweep_events(spark, d):
    grid = F.broadcast(spark.createDataFrame([(0, 1.5), (1, 2.5), (2, 3.5)], "param_id int, thr double"))
    return predicted(spark, d).crossJoin(grid).groupBy("param_id").agg(F.sum((F.col("score") > F.col("thr")).cast("long")).alias("n_out"))


def _obs(spark, d):
    return standard(spark, d).select(F.col("user_id").alias("stream_key"), "seq", F.array(*COLS).alias("features"))


def _labels(t):
    return t.labels.select("stream_key", "seq", "context_id", r6("score").alias("score"), "is_outlier")


#: Training parameters of the event queries.
BASE = Params(drift_threshold=0.6, drift_size=4, p_var=0.98, model_mem=40)


@query()
def predict_embeddings(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return scoring.predict(e, models.fit(e, "label", p_var=0.9, mem=1000)).select(F.col("seq").alias("vec_id"), "label", "context_id", r6("score").alias("score"))


def _trained(name: str, **changes):
    p = replace(BASE, **changes)

    def run(spark, d):
        return _labels(train(_obs(spark, d), p))

    run.__name__ = name
    # The recursive query knows the first algorithm with models of a memory, without a limit.
    plain = not set(changes) & {"algorithm", "model_backend", "model_limit", "end_buffer"}
    query(oracles.trainer(Z, [p]) + oracles.LABELS if plain else None)(run)


_trained("train_v1_events")
_trained("train_v1_current_events", partial_memory_to="current", init_size=10)
_trained("train_v1_best_events", partial_label_to="best")
_trained("train_java_events", end_buffer="model", model_limit=4, merge="alternate")
_trained("train_v2_events", algorithm="v2")
_trained("train_ipca_events", model_backend="incremental")
_trained("train_merge_events", model_limit=2)
_trained("train_mahalanobis_events", score="mahalanobis", p_var=1.0, drift_threshold=3.0)


@query(oracles.trainer(Z, [BASE]) + """, tr AS (SELECT uid, coalesce(lag(context_id) OVER (PARTITION BY uid ORDER BY seq), context_id) AS from_id, context_id AS to_id FROM lab)
SELECT uid AS stream_key, CAST(from_id AS INTEGER) AS from_id, CAST(to_id AS INTEGER) AS to_id, count(*) AS n FROM tr GROUP BY 1, 2, 3""")
def train_transitions_events(spark, d):
    return train(_obs(spark, d), BASE).transitions


@query(oracles.trainer(Z, [BASE]) + " SELECT uid AS stream_key, CAST(m.id AS INTEGER) AS model_id, m.k AS n_pcs, round(m.m1, 6) AS centroid_0, round(m.m2, 6) AS centroid_1, CAST(len(m.r) AS INTEGER) AS n_memory, m.last AS last_update_seq FROM mo")
def train_models_events(spark, d):
    m = train(_obs(spark, d), BASE).models
    return m.select("stream_key", "model_id", "n_pcs", *(r6(F.col("centroid")[i]).alias(f"centroid_{i}") for i in (0, 1)), F.size("memory").alias("n_memory"), "last_update_seq")


GRID = [Params(drift_threshold=t, drift_size=s, model_mem=40) for t in (1.5, 2.0, 3.0) for s in (5, 8)]


@query(oracles.trainer(Z, GRID) + " SELECT pid AS param_id, uid AS stream_key, count(*) AS n_contexts FROM mo GROUP BY 1, 2")
def sweep_events(spark, d):
    return sweep(_obs(spark, d), GRID).models.groupBy("param_id", "stream_key").agg(F.count("*").alias("n_contexts"))


#: Models of the latest 500 rows of each event type, and every row's best one.
F500 = Z + """, f AS (SELECT event_type, avg(x1) AS mu_0, avg(x2) AS mu_1, covar_samp(x1, x1) AS s_0_0, covar_samp(x1, x2) AS s_0_1, covar_samp(x2, x2) AS s_1_1
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM z) WHERE age <= 500 GROUP BY event_type),
fm AS (SELECT *, row_number() OVER (ORDER BY event_type) AS model_id FROM f),
fs AS (SELECT event_id, model_id, sqrt(greatest(s_0_0 * (x1 - mu_0) * (x1 - mu_0) + 2 * s_0_1 * (x1 - mu_0) * (x2 - mu_1) + s_1_1 * (x2 - mu_1) * (x2 - mu_1), 0)) AS score FROM z CROSS JOIN fm)
SELECT event_id, CAST(model_id AS INTEGER) AS context_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score, model_id) AS k FROM fs) WHERE k = 1"""


def _fitted(spark, d):
    rows = cut(standard(spark, d).select("event_type", F.col("event_id").alias("seq"), F.array(*COLS).alias("features")))
    return rows, models.fit(rows, "event_type", p_var=1.0, mem=500)


@query(F500)
def predict_fitted_events(spark, d):
    """Fitted models, and their scores by Arrow batches."""
    rows, m = _fitted(spark, d)
    return scoring.predict(rows.select("seq", "features"), m).select(F.col("seq").alias("event_id"), "context_id", r6("score").alias("score"))


@query(F500)
def sql_function_events(spark, d):
    """The same by the registered SQL function."""
    rows, m = _fitted(spark, d)
    scoring.register_udf(spark, m, "score_context")
    found = rows.select("seq", F.expr("score_context(features)").alias("b"))
    return found.select(F.col("seq").alias("event_id"), "b.context_id", r6("b.score").alias("score"))


@query(EIG + " SELECT event_type, CAST(CASE WHEN l1 / (l1 + greatest(l2, 0)) > 0.52 THEN 1 ELSE 2 END AS BIGINT) AS rank FROM ei")
def find_rank_events(spark, d):
    return models.find_rank(_eigen(spark, d).select("event_type", F.explode(F.array("l1", "l2")).alias("v")), "event_type", "v", 0.52)


@query(Z + " SELECT event_id AS seq, round(x1, 6) AS f0, round(x2, 6) AS f1 FROM z")
def csv_scan_events(spark, d):
    """Standardised events, written as CSV and read by the CSV source."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    standard(spark, d).select("event_id", *COLS).write.option("header", True).csv(path)
    rows = files.csv_observations(spark, path, ["event_id", *COLS], order="event_id")
    return rows.select("seq", *(r6(F.col("features")[i]).alias(f"f{i}") for i in (0, 1)))


@query(oracles.trainer(Z, [BASE]) + """, tt AS (SELECT lab.uid, context_id AS u, event_type AS v, CAST(count(*) AS DOUBLE) AS n FROM lab JOIN z ON z.user_id = lab.uid AND z.seq = lab.seq GROUP BY 1, 2, 3),
pu AS (SELECT uid, sum(m * (m - 1) / 2) AS pu FROM (SELECT uid, u, sum(n) AS m FROM tt GROUP BY 1, 2) GROUP BY 1), pv AS (SELECT uid, sum(m * (m - 1) / 2) AS pv FROM (SELECT uid, v, sum(n) AS m FROM tt GROUP BY 1, 2) GROUP BY 1),
tp AS (SELECT uid, sum(n) AS n, sum(n * (n - 1) / 2) AS p FROM tt GROUP BY 1),
ari AS (SELECT uid, (p - pu * pv / nullif(n * (n - 1) / 2, 0)) / nullif((pu + pv) / 2 - pu * pv / nullif(n * (n - 1) / 2, 0), 0) AS ari FROM tp JOIN pu USING (uid) JOIN pv USING (uid)),
la1 AS (SELECT uid, arg_max({'x1': x1, 'x2': x2}, seq) AS x FROM zz GROUP BY uid),
ls AS (SELECT mo.uid, min({'s': """ + oracles.score("m", "variance_weighted").replace("x1", "la1.x.x1").replace("x2", "la1.x.x2") + """, 'id': m.id}) AS b FROM mo JOIN la1 ON la1.uid = mo.uid GROUP BY 1)
SELECT ls.uid AS stream_key, round(ari, 6) AS ari, CAST(b.id AS INTEGER) AS last_context, round(b.s, 6) AS last_score FROM ls JOIN ari ON ari.uid = ls.uid""")
def train_ari_last_events(spark, d):
    """Train, agree with the truth, predict the last row again: one row per stream."""
    z = cut(standard(spark, d))
    obs = z.select(F.col("user_id").alias("stream_key"), "seq", F.array(*COLS).alias("features"))
    t = train(obs, BASE)
    truth = t.labels.join(z.select(F.col("user_id").alias("stream_key"), "seq", "event_type"), ["stream_key", "seq"])
    ari = metrics.adjusted_rand(metrics.contingency(truth, "context_id", "event_type", ["stream_key"]), ["stream_key"])
    last = obs.groupBy("stream_key").agg(F.max_by(F.struct("seq", "features"), "seq").alias("b")).select("stream_key", "b.*")
    got = scoring.score_keyed(last, t.models).join(ari, "stream_key")
    return got.select("stream_key", r6(F.when(~F.isnan("ari"), F.col("ari"))).alias("ari"), F.col("context_id").alias("last_context"), r6("score").alias("last_score"))


@query()
def decompose_lineitem(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    z = feat.zscore(li, nums, names=["f0", "f1", "f2", "f3"])
    order = ["l_orderkey", "l_linenumber", "l_partkey", *nums, "l_shipdate"]
    s = feat.with_seq(z, ["l_suppkey"], order).select(F.col("l_suppkey").alias("stream_key"), "seq", F.array("f0", "f1", "f2", "f3").alias("features"))
    return decompose(s, _GROUPS, Params(drift_threshold=2.0, drift_size=20, model_mem=200)).models.groupBy("group_id", "stream_key").agg(F.count("*").alias("n_contexts"))


@query()
def online_offline_events(spark, d):
    from contextloom.streaming.online import OnlineTrainer, replay

    obs = _obs(spark, d)
    last = obs.agg(F.max("seq")).first()[0]
    size = 1 + last // 4
    out = replay(OnlineTrainer(BASE, f"{scratch(spark)}/online-{uuid.uuid4().hex}"), obs, 4, size)
    return out.select("stream_key", "seq", "context_id", r6("score").alias("score"), "is_outlier")


@query()
def clustering_pipeline_events(spark, d):
    """Split, standardise on the first part, train on it, predict the rest, agree with the truth, and the transitions that leave
    the contexts: one row per stream."""
    first, rest = feat.split(events(spark, d), 0.8, ["user_id"])
    z = lambda x: feat.zscore(x, ["value", "gap"], fit_on=first, names=COLS).select(F.col("user_id").alias("stream_key"), "seq", "event_type", F.array(*COLS).alias("features"))
    t = train(z(first).drop("event_type"), BASE)
    found = cut(scoring.score_keyed(z(rest), t.models))
    ari = metrics.adjusted_rand(metrics.contingency(found, "context_id", "event_type", ["stream_key"]), ["stream_key"])
    left = t.transitions.groupBy("stream_key", "from_id").agg(F.sum("n").alias("degree")).groupBy("stream_key").agg(F.max("degree").alias("max_degree"), F.sort_array(F.collect_list("degree"), asc=False).alias("degrees"))
    one = found.groupBy("stream_key").agg(F.count("*").alias("n"), F.countDistinct("context_id").alias("n_contexts"), F.round(F.avg("score"), R).alias("mean_score"))
    return one.join(ari, "stream_key").join(left, "stream_key").withColumn("ari", r6(F.when(~F.isnan("ari"), F.col("ari"))))


@query(EVENTS + " SELECT count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value, round(avg(gap), 3) AS mean_gap, round(stddev_samp(gap), 3) AS sd_gap FROM e")
def column_moments_events(spark, d):
    e = events(spark, d)
    m = feat.moments(e, ["value", "gap"]).crossJoin(F.broadcast(e.agg(F.count("*").alias("n"))))
    return m.select("n", r6("mean_value").alias("mean_value"), r6("sd_value").alias("sd_value"), F.round("mean_gap", 3).alias("mean_gap"), F.round("sd_gap", 3).alias("sd_gap"))


@query(M + " SELECT event_id, round(x1 - mu_0, 6) AS d0, round(x2 - mu_1, 6) AS d1 FROM z JOIN g USING (event_type)")
def centred_events(spark, d):
    z = standard(spark, d)
    mu = F.broadcast(models.mean_cov(z, "event_type", COLS).select("event_type", F.array("mu_0", "mu_1").alias("mu")))
    c = z.join(mu, "event_type").select("event_id", feat.centred(F.array(*COLS), F.col("mu")).alias("c"))
    return c.select("event_id", r6(F.col("c")[0]).alias("d0"), r6(F.col("c")[1]).alias("d1"))


@query("SELECT label, count(*) AS n, round(sum(l), 5) AS total, round(avg(l), 5) AS mean FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS l FROM embeddings) GROUP BY label")
def column_norms_embeddings(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", feat.norm("embedding").alias("l"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("l"), 5).alias("total"), F.round(F.avg("l"), 5).alias("mean"))


@query(EVENTS + " SELECT event_id, user_id, CAST(seq AS BIGINT) AS seq FROM e ORDER BY user_id, seq LIMIT 1")
def first_row_events(spark, d):
    return events(spark, d).select("event_id", "user_id", "seq").orderBy("user_id", "seq").limit(1)


@query("SELECT group_id, count(*) AS n, round(sum(f), 2) AS total FROM (SELECT 0 AS group_id, l_quantity + l_extendedprice AS f FROM lineitem UNION ALL SELECT 1, l_discount + l_tax FROM lineitem UNION ALL SELECT 2, l_quantity + l_tax FROM lineitem) GROUP BY 1")
def bag_union_lineitem(spark, d):
    """The union of keyed streams from one scan."""
    g = feature_groups(lines(spark, d), _GROUPS)
    return g.groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[0] + F.col("features")[1]), 2).alias("total"))


@query()
def anomaly_pipeline_events(spark, d):
    """Train on the normal rows of each user's first part, score the rest by the user's own models with the three detectors,
    measure each over all users: one row."""
    first, rest = feat.split(events(spark, d), 0.8, ["user_id"])
    z = lambda x: feat.zscore(x, ["value", "gap"], fit_on=first, names=COLS).select(F.col("user_id").alias("stream_key"), "seq", "event_type", F.array(*COLS).alias("features"))
    t = train(z(feat.sanitise(first, "event_type", "view")).drop("event_type"), BASE)
    scored = cut(scoring.score_keyed(z(rest), t.models).where("score is not null").withColumn("truth", feat.recode("event_type", "view")).drop("features"))
    key = ["stream_key"]
    point = metrics.auc(scoring.point_anomaly(scored), "anomaly", "truth").withColumnRenamed("auc", "auc_point")
    context = metrics.auc(scoring.context_anomaly(scored, transitions.rarity(t.transitions, key), BASE.drift_threshold, key), "anomaly", "truth").withColumnRenamed("auc", "auc_context")
    together = metrics.auc(scoring.collective_anomaly(scored, transitions.markov(t.transitions, key), 5, key), "anomaly", "truth").withColumnRenamed("auc", "auc_collective")
    return point.crossJoin(F.broadcast(context)).crossJoin(F.broadcast(together)).select(*(r6(c).alias(c) for c in ("auc_point", "auc_context", "auc_collective")))  # a row each


@query()
def variants_synthetic(spark, d):
    """The first algorithm, the overlap-aware one and incremental models on one stream of known concepts: contexts found and
    agreement with the truth. The stream is generated; sf_dir is not read."""
    from contextloom.sources import synth

    obs = synth.stream(spark, [150, 100, 120, 90, 140], n_features=4, offset_scale=6.0, seed=9)
    grid = [Params(drift_threshold=1.2, drift_size=12, model_mem=100, p_var=0.9, algorithm=a, model_backend=b) for a, b in (("v1", "batch_pca"), ("v2", "batch_pca"), ("v1", "incremental"))]
    got = sweep(obs.select("stream_key", "seq", "features"), grid).labels.join(obs, ["stream_key", "seq"])
    table = got.groupBy("param_id", F.col("context_id").alias("u"), F.col("truth").alias("v")).agg(F.count("*").alias("n"))
    rows = None
    for i, name in enumerate(("v1", "v2", "incremental")):
        mine = table.where(F.col("param_id") == i)
        one = metrics.adjusted_rand(mine).crossJoin(F.broadcast(mine.agg(F.countDistinct("u").alias("n_contexts")))).select(F.lit(name).alias("variant"), r6("ari").alias("ari"), "n_contexts")
        rows = one if rows is None else rows.unionByName(one)
    return rows
