"""Training: the sequential kernel on each key of a partitioned, sorted stream.

Rows of a key depend on each other in order, so a key is one task's work by meaning; keys run in parallel, and so do parameter
sets and feature groups where keys are few. Where keys are many, a stream crosses the shuffle once and one task feeds all its
variants in a single pass. A task streams its sorted rows and never holds a key's rows: what it holds is the models. Only
key, seq and features reach Python.

Rows of a key with equal seq go by their features: the least one counts, the others are late. A late row is put out with a
null context, score and is_outlier, and teaches nothing; every host has this rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.plans.kernel import IncrementalModel, Kernel, Model, Params
from contextloom.runtime import cut, ship
from contextloom.schema import LABELS, MODEL, TRANSITION


@dataclass(frozen=True)
class Trained:
    """labels: stream_key, seq, context_id, score, is_outlier. models: stream_key and the fields of a model. transitions:
    stream_key, from_id, to_id, n. A sweep's have param_id first."""

    labels: DataFrame
    models: DataFrame
    transitions: DataFrame


def model_row(m: Model | IncrementalModel) -> dict:
    return {"model_id": m.id, "n_pcs": m.n_pcs, "centroid": m.centroid.tolist(), "coeff": m.coeff.tolist(), "variances": m.variances.tolist(), "memory": [r.tolist() for _, r in m.rows()], "last_update_seq": m.last}


def features_of(column: pa.Array) -> np.ndarray:
    """A batch's features as a matrix; they must have one length."""
    off = column.offsets.to_numpy()
    n = np.diff(off)
    if len(n) and (n != n[0]).any():
        raise ValueError("features must have the same length in every row of a stream")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)


@dataclass(frozen=True)
class Variant:
    """One training of a stream: its number, parameters, and the places of its features (None: all)."""

    id: int
    params: Params
    index: tuple[int, ...] | None = None


def run_kernels(batches: Iterator[pa.RecordBatch], variants: dict[int, Variant], spread: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """batches: stream_key, seq, features, sorted by key, seq and features; spread: a column variant comes first, and rows are
    sorted by it first. Gives variant, stream_key, label, model, transition."""
    kernels: list[tuple[Variant, Kernel, np.ndarray | None]] = []
    now: object = run_kernels  # no key equals it
    rows: list[tuple] = []

    def start(which: Iterable[Variant]) -> None:
        kernels[:] = [(v, Kernel(v.params), None if v.index is None else np.array(v.index)) for v in which]

    def end() -> None:
        for v, k, _ in kernels:
            rows.extend((v.id, now, x, None, None) for x in k.close())
            rows.extend((v.id, now, None, model_row(m), None) for m in k.models.values())
            rows.extend((v.id, now, None, None, e) for e in sorted((*e, n) for e, n in k.transitions.items() if n))
        kernels.clear()

    def flush() -> pa.RecordBatch:
        ids, keys, labels, models, moves = zip(*rows, strict=True)
        named = lambda names, xs: [None if x is None else dict(zip(names, x, strict=True)) for x in xs]
        cols = [ids, keys, named(("seq", "context_id", "score", "is_outlier"), labels), models, named(("from_id", "to_id", "n"), moves)]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    first = int(spread)
    for batch in batches:
        # Keys of one batch may differ in their number of features.
        column = batch.column(first + 2)
        flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        off, seq, key = off - off[0], batch.column(first + 1).to_pylist(), batch.column(first).to_pylist()
        which = batch.column(0).to_pylist() if spread else [None] * batch.num_rows
        for i in range(batch.num_rows):
            if not kernels or key[i] != now or which[i] is not None and which[i] != kernels[0][0].id:
                end()
                now = key[i]
                start(variants.values() if which[i] is None else [variants[which[i]]])
            x = flat[off[i] : off[i + 1]]
            for v, kernel, index in kernels:
                for label in kernel.offer(seq[i], x if index is None else x[index]):
                    rows.append((v.id, now, label, None, None))
            if len(rows) >= 5000:
                yield flush()
    end()
    if rows:
        yield flush()


def _host(obs: DataFrame, variants: list[Variant], name: str | None) -> Trained:
    """name: the column for a variant's number, None to leave it out."""
    spark = ship(obs.sparkSession)
    kind = obs.schema["stream_key"].dataType.simpleString()
    schema = f"variant int, stream_key {kind}, label struct<{LABELS.replace(' ', ':').replace(',:', ',')}>, model {MODEL}, transition {TRANSITION}"
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(spark.createDataFrame([], schema).schema)
    rows = obs.select("stream_key", "seq", "features")
    cores = spark.sparkContext.defaultParallelism
    # Fewer streams than cores: the variants of a stream are dealt to tasks of their own.
    spread = len(variants) > 1 and rows.select("stream_key").distinct().limit(cores).count() < cores
    keys = ["stream_key"]
    if spread:
        keys = ["variant", "stream_key"]
        rows = rows.select(F.explode(F.array(*(F.lit(v.id) for v in variants))).alias("variant"), "*")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "features")
    table = {v.id: v for v in variants}
    done = cut(rows.mapInArrow(lambda it: run_kernels(it, table, spread, shape), schema))
    shown = ["stream_key"] if name is None else [F.col("variant").alias(name), "stream_key"]
    part = lambda c: done.where(F.col(c).isNotNull()).select(*shown, f"{c}.*")
    return Trained(part("label"), part("model"), part("transition"))


def train(obs: DataFrame, params: Params) -> Trained:
    """One model collection for each stream_key."""
    return _host(obs, [Variant(0, params)], None)


def sweep(obs: DataFrame, params: list[Params]) -> Trained:
    """Every parameter set (param_id: its place in the list) over every stream, from one scan."""
    return _host(obs, [Variant(i, p) for i, p in enumerate(params)], "param_id")


def feature_groups(obs: DataFrame, groups: list[list[int]]) -> DataFrame:
    """A row for each observation and feature group, group_id from 0; features of the group by their place."""
    index = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    out = obs.select("stream_key", "seq", "features", F.posexplode(index).alias("group_id", "idx"))
    return out.select("group_id", "stream_key", "seq", F.transform("idx", lambda i: F.col("features")[i]).alias("features"))


def decompose(obs: DataFrame, groups: list[list[int]], params: Params) -> Trained:
    """A model collection for each feature group (group_id: its place in the list) of each stream, from one scan."""
    return _host(obs, [Variant(i, params, tuple(g)) for i, g in enumerate(groups)], "group_id")


def register_udtf(spark, params: Params, name: str = "train_contexts") -> None:
    """SQL: SELECT * FROM name(TABLE(t) PARTITION BY key ORDER BY seq, features), t with columns seq and features."""
    ship(spark)

    class TrainContexts:
        def __init__(self):
            self.kernel = Kernel(params)

        def eval(self, row):
            yield from self.kernel.offer(row["seq"], np.array(row["features"], float))

        def terminate(self):
            yield from self.kernel.close()

    spark.udtf.register(name, F.udtf(TrainContexts, returnType=LABELS))
