"""Training under Structured Streaming: a kernel for each key, kept in checkpointed state.

Labels come out when they are resolved: a buffered row waits for its buffer. A row that doesn't come after its key's last
one is put out as late, with a null context, never reordered; rows of one micro-batch go by seq, then features. End a key with a row whose `close` is true; what is buffered is labelled then.
Restarting from the checkpoint gives what an uninterrupted run gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from contextloom.operators.scoring import bounded
from contextloom.plans.kernel import Kernel, Params
from contextloom.runtime import ship

OUT = "stream_key bigint, seq bigint, context_id int, score double, is_outlier boolean, late boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def row_order(r) -> tuple:
    """By seq, then features; what ends a key (a row without features) after its rows of the same seq."""
    return int(r.seq), r.features is None, () if r.features is None else tuple(r.features)


class ContextProcessor(StatefulProcessor):
    """Models lie in a map, one entry each, so a row rewrites the models it changed and the small rest of the kernel."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "data binary")
        self.models = handle.getMapState("models", "model_id int", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kernel = Kernel(self.params)
        if self.head.exists():
            kernel = Kernel.load(self.head.get()[0])
            kernel.models = {k[0]: pickle.loads(v[0]) for k, v in self.models.iterator()}
        before = {i: m.version for i, m in kernel.models.items()}
        out = []
        for r in sorted(pd.concat(list(rows)).itertuples(), key=row_order):
            if r.close:
                out += kernel.close()
            else:
                out += kernel.offer(int(r.seq), np.array(r.features, float))
        out = [(*x, x[1] is None) for x in out]
        for i, m in kernel.models.items():
            if before.get(i) != m.version:
                self.models.updateValue((i,), (pickle.dumps(m),))
        for i in set(before) - set(kernel.models):
            self.models.removeKey((i,))
        kernel.models = {i: None for i in kernel.models}
        self.head.update((kernel.dump(),))
        frame = pd.DataFrame(out, columns=["seq", "context_id", "score", "is_outlier", "late"])
        frame.insert(0, "stream_key", key[0])
        yield frame.astype({"context_id": "Int32", "is_outlier": "boolean", "score": "float64"})

    def close(self) -> None:
        pass


def label_stream(rows: DataFrame, params: Params) -> DataFrame:
    """rows: stream_key bigint, seq bigint, features array<double>, close boolean. Needs the RocksDB state store (STATE_STORE)."""
    spark = ship(rows.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy("stream_key").transformWithStateInPandas(ContextProcessor(params), outputStructType=OUT, outputMode="append", timeMode="none")


CHAIN_OUT = "stream_key bigint, seq bigint, context_id int, anomaly double"


class CollectiveProcessor(StatefulProcessor):
    """The collective detector over a stream of labels: a key's state is its last context and its last window - 1 chances."""

    def __init__(self, chain: dict[tuple[int, int], float], window: int):
        self.chain, self.window = chain, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "context_id int, n bigint")
        self.chances = handle.getListState("chances", "p double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n = self.last.get() if self.last.exists() else (None, 0)
        held = [p[0] for p in self.chances.get()] if self.chances.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            c, n = int(r.context_id), n + 1
            held = [*held, 1.0 if last is None else self.chain.get((last, c), 0.0)][-self.window :]
            last = c
            out.append((int(key[0]), int(r.seq), c, float(np.mean(held)) if n >= self.window else 1.0))
        self.last.update((last, n))
        self.chances.put([(p,) for p in held[len(held) - min(len(held), self.window - 1) :]] or [(0.0,)])
        yield pd.DataFrame(out, columns=["stream_key", "seq", "context_id", "anomaly"]).astype({"context_id": "int32"})

    def close(self) -> None:
        pass


def collective_stream(labels: DataFrame, chain: DataFrame, window: int) -> DataFrame:
    """scoring.collective_anomaly() over a streaming frame of labels (stream_key bigint, seq, context_id), by a count window
    that lives from one micro-batch to the next. Rows of a key must come in order of seq from batch to batch; late labels
    (null contexts) are left out. chain: from_id, to_id, p, one row per pair of contexts seen."""
    spark = ship(labels.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    seen = {(r.from_id, r.to_id): r.p for r in bounded(chain.select("from_id", "to_id", "p"))}
    rows = labels.where("context_id is not null").select("stream_key", "seq", "context_id")
    return rows.groupBy("stream_key").transformWithStateInPandas(CollectiveProcessor(seen, window), outputStructType=CHAIN_OUT, outputMode="append", timeMode="none")
