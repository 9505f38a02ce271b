"""Scoring rows against models, and the three detectors.

With every component retained a model's score is the square root of the quadratic form (x - mu)' Sigma (x - mu), so it needs
no decomposition and stays in generated code. Truncated models are scored by Arrow batches against broadcast matrices.
Model collections are small by design (model_limit); their size is checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from contextloom.plans.train import features_of
from contextloom.runtime import cut, ship

#: Most models that are broadcast at a time, and most doubles of their matrices.
MAX_MODELS = 100_000
MAX_DOUBLES = 50_000_000


def quadratic_score(cols: list[str]) -> Column:
    """The score from columns x, mu_<i> and s_<i>_<j> (i <= j) of one row; rounding below zero counts as 0."""
    d = [F.col(c) - F.col(f"mu_{i}") for i, c in enumerate(cols)]
    form = None
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            term = F.col(f"s_{i}_{j}") * d[i] * d[j] * (1 if i == j else 2)
            form = term if form is None else form + term
    return F.sqrt(F.greatest(form, F.lit(0.0)))


def bounded(small: DataFrame, most: int = MAX_MODELS) -> list[Row]:
    """The rows of a table of models or of their transitions on the driver: an error if there are more than `most`."""
    got = small.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows of models: train with model_limit")
    return got


def held(small: DataFrame) -> DataFrame:
    """A table of models or of their transitions, computed once; for equi joins. It is broadcast if it has at most MAX_MODELS
    rows and shuffled otherwise."""
    small = cut(small)
    return F.broadcast(small) if small.limit(MAX_MODELS + 1).count() <= MAX_MODELS else small


def score_all(rows: DataFrame, models: DataFrame, cols: list[str], keep: list[str], block: int = MAX_MODELS) -> DataFrame:
    """Every row with every model: keep, model_id, score. models: model_id, mu_<i>, s_<i>_<j>. Models beyond `block` are
    broadcast in blocks, one scan of the rows for each."""
    models = cut(models)
    parts = -(-max(1, models.count()) // block)
    out = None
    for k in range(parts):
        some = models if parts == 1 else models.where(F.pmod(F.xxhash64("model_id"), F.lit(parts)) == k)
        one = rows.crossJoin(F.broadcast(some)).select(*keep, "model_id", quadratic_score(cols).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def best(scores: DataFrame, keep: list[str]) -> DataFrame:
    """The least score and its model; of equal scores the least model_id."""
    return scores.groupBy(*keep).agg(F.min(F.struct("score", "model_id")).alias("b")).select(*keep, F.col("b.model_id").alias("context_id"), F.col("b.score").alias("score"))


def best_inline(rows: DataFrame, models: list, cols: list[str]) -> DataFrame:
    """As best(score_all()), for a few models given as collected rows: no join, no shuffle, one expression per model."""
    scored = []
    for m in models:
        d = [F.col(c) - F.lit(m[f"mu_{i}"]) for i, c in enumerate(cols)]
        form = sum((F.lit(m[f"s_{i}_{j}"]) * d[i] * d[j] * (1 if i == j else 2) for i in range(len(cols)) for j in range(i, len(cols))), F.lit(0.0))
        scored.append(F.struct(F.sqrt(F.greatest(form, F.lit(0.0))).alias("score"), F.lit(m["model_id"]).alias("context_id")))
    return rows.withColumn("__b", F.array_min(F.array(*scored))).select("*", F.col("__b.context_id").alias("context_id"), F.col("__b.score").alias("score")).drop("__b")


def _matrices(rows: list[Row]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    got = sorted(rows, key=lambda m: m.model_id)
    return np.array([m.model_id for m in got], np.int32), [(np.array(m.centroid), np.array(m.coeff, float).reshape(len(m.centroid), -1)) for m in got]


def _score_matrix(x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.stack([np.sqrt((((x - mu) @ a) ** 2).sum(1)) for mu, a in parts], 1)


def predict(obs: DataFrame, models: DataFrame, all_scores: bool = False, most: int = MAX_DOUBLES) -> DataFrame:
    """obs with context_id and score of the best model by Arrow batches; all_scores: also the array of every model's score,
    by model_id. models: model_id, centroid, coeff. Models of more than `most` numbers are broadcast in blocks of model ids:
    each block is a pass over the rows, which keeps the better of its best and the one before. Without models nulls."""
    spark = ship(obs.sparkSession)
    models = cut(models.select("model_id", "centroid", "coeff", (F.size("centroid") * (F.size(F.col("coeff")[0]) + 1)).cast("long").alias("n")))
    total, count = models.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // most), -(-count // MAX_MODELS))
    out = obs.withColumns({"context_id": F.lit(None).cast("int"), "score": F.lit(None).cast("double"), **({"scores": F.lit(None).cast("array<double>")} if all_scores else {})})
    place, schema = obs.columns.index("features"), out.schema
    order = sorted(r[0] for r in models.select("model_id").collect()) if parts > 1 else []
    for k in range(parts):
        some = models if parts == 1 else models.where(F.col("model_id").between(order[k * count // parts], order[(k + 1) * count // parts - 1]))
        ids, mats = _matrices(some.collect())
        if not len(ids):
            break
        sent = spark.sparkContext.broadcast((ids, mats))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, mats = sent.value
            for batch in batches:
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                s = _score_matrix(features_of(batch.column(place)), mats)
                b = s.argmin(1)
                new, score = ids[b], s[np.arange(len(b)), b]
                if batch.column(schema.names.index("score")).null_count == 0 and len(b):  # an earlier block had models, of smaller ids
                    old = cols["score"].to_numpy()
                    stay = old <= score
                    new, score = np.where(stay, cols["context_id"].to_numpy(), new), np.where(stay, old, score)
                cols |= {"context_id": pa.array(new.astype(np.int32)), "score": pa.array(score)}
                if all_scores:
                    before = cols["scores"].to_pylist()
                    cols["scores"] = pa.array([(a or []) + v for a, v in zip(before, s.tolist(), strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

        out = out.mapInArrow(run, schema)
        if k + 1 < parts:
            out = cut(out)  # one block's matrices at a time
    return out


def score_keyed(obs: DataFrame, models: DataFrame) -> DataFrame:
    """obs with context_id and score of the best model among those of the row's own stream_key; of equal scores the least id.

    A stream's models are put in one array (they are model_limit at most), so a row meets them without being multiplied.
    Rows of a stream without models get nulls."""
    mine = models.groupBy("stream_key").agg(F.collect_list(F.struct("model_id", "centroid", "coeff")).alias("__m"))
    zero = F.lit(0.0)

    def one(m: Column) -> Column:
        d = F.zip_with("features", m.centroid, lambda a, b: a - b)
        at = lambda k: F.aggregate(F.zip_with(d, m.coeff, lambda a, r: a * r[k]), zero, lambda s, v: s + v)
        square = F.aggregate(F.sequence(F.lit(0), F.size(m.coeff[0]) - 1), zero, lambda s, k: s + F.pow(at(k), 2))
        return F.struct(F.sqrt(square).alias("score"), m.model_id.alias("context_id"))

    found = obs.join(mine, "stream_key", "left").withColumn("__b", F.array_min(F.transform("__m", one)))
    return found.select(*obs.columns, F.col("__b.context_id").alias("context_id"), F.col("__b.score").alias("score"))


def register_udf(spark: SparkSession, models: DataFrame, name: str = "score_context") -> None:
    """SQL: name(features) gives struct<context_id int, score double>, the best of the models (model_id, centroid, coeff),
    which are broadcast; their number is checked."""
    ship(spark)
    sent = spark.sparkContext.broadcast(_matrices(bounded(models.select("model_id", "centroid", "coeff"))))

    def best_of(features: pd.Series) -> pd.DataFrame:
        ids, mats = sent.value
        if not len(features):
            return pd.DataFrame({"context_id": pd.Series([], dtype="int32"), "score": pd.Series([], dtype="float64")})
        s = _score_matrix(np.array(features.tolist(), float), mats)
        b = s.argmin(1)
        return pd.DataFrame({"context_id": ids[b], "score": s[np.arange(len(b)), b]})

    best_of.__annotations__ = {"features": pd.Series, "return": pd.DataFrame}
    spark.udf.register(name, F.pandas_udf(best_of, "context_id int, score double"))


def point_anomaly(labels: DataFrame) -> DataFrame:
    """Higher is more anomalous: the least score."""
    return labels.withColumn("anomaly", F.col("score"))


def context_anomaly(labels: DataFrame, rarity: DataFrame, threshold: float, key: list[str] | None = None) -> DataFrame:
    """The share of transitions that lead to the row's context, if its score is below the threshold, else 0. Frequent
    contexts score high: read it with metrics.auc, which takes either direction. rarity: key, to_id, rarity."""
    r = held(rarity.withColumnRenamed("to_id", "context_id"))  # a row per model
    return labels.join(r, [*(key or []), "context_id"], "left").withColumn("anomaly", F.when(F.col("score") < threshold, F.coalesce("rarity", F.lit(0.0))).otherwise(F.lit(0.0))).drop("rarity")


def collective_anomaly(labels: DataFrame, chain: DataFrame, window: int, key: list[str], seq: str = "seq") -> DataFrame:
    """Low is anomalous: the mean chance of the last `window` transitions, 1 for the first window - 1 rows of a key. The first
    row's chance is 1, that of a transition never seen 0. chain: from_id, to_id, p, and those columns of the key that it has
    a chain for each of. Both windows share one sort."""
    w = Window.partitionBy(*key).orderBy(seq)
    own = [k for k in key if k in chain.columns]
    moved = labels.withColumns({"from_id": F.lag("context_id").over(w), "__k": F.row_number().over(w)})
    c = held(chain.select(*own, "from_id", F.col("to_id").alias("context_id"), "p"))  # a row per pair seen
    p = F.when(F.col("__k") == 1, F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0.0)))
    scored = moved.join(c, [*own, "from_id", "context_id"], "left").withColumn("p", p)
    mean = F.avg("p").over(w.rowsBetween(-(window - 1), 0))
    return scored.withColumn("anomaly", F.when(F.col("__k") >= window, mean).otherwise(F.lit(1.0))).drop("__k", "from_id", "p")
