"""High-velocity streams: rows are labelled by the models of the last batch, and the models learn between batches.

Each micro-batch reads the snapshot of version id - 1, labels its rows with models that stand still but for new contexts,
lets the models learn what they were given, and writes the snapshot of version id. A batch that runs again reads the same
snapshot and writes the same version, so results don't depend on retries; staleness is one trigger. finish() labels what is
left in buffers when the stream has ended. Late rows are put out with a null context.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.plans.kernel import Kernel, Params
from contextloom.runtime import ship
from contextloom.schema import LABELS
from contextloom.streaming.stateful import row_order

_STATE = "stream_key bigint, state binary"
_OUT = f"stream_key bigint, {LABELS}, state binary"


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


class OnlineTrainer:
    """folder: a shared folder for snapshots and labels."""

    def __init__(self, params: Params, folder: str):
        self.params, self.folder = replace(params, deferred=True), folder.rstrip("/")

    def snapshot(self, version: int) -> str:
        return f"{self.folder}/models/version={version}"

    def _state(self, like: DataFrame, version: int) -> DataFrame:
        """The models after batch `version`; none before batch 0. A version that is missing is an error, not an empty start."""
        spark = like.sparkSession
        if version < 0:
            return spark.createDataFrame([], _STATE)
        if not _exists(like, f"{self.snapshot(version)}/_SUCCESS"):
            raise RuntimeError(f"snapshot {version} is missing in {self.folder}: batches must follow each other from 0")
        return spark.read.schema(_STATE).parquet(self.snapshot(version))

    def _write(self, done: DataFrame, version: int) -> None:
        work = f"{self.folder}/work/version={version}"
        done.write.mode("overwrite").parquet(work)
        done = done.sparkSession.read.schema(_OUT).parquet(work)
        done.where("state is null").drop("state").write.mode("overwrite").parquet(f"{self.folder}/labels/version={version}")
        done.where("state is not null").select("stream_key", "state").write.mode("overwrite").parquet(self.snapshot(version))

    def process(self, batch: DataFrame, version: int) -> None:
        """For foreachBatch. batch: stream_key, seq, features. Versions follow each other from 0."""
        ship(batch.sparkSession)
        params, old = self.params, self._state(batch, version - 1)

        def advance(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            kernel = Kernel.load(state["state"].iloc[0]) if len(state) else Kernel(params)
            out = []
            for r in sorted(rows.itertuples(), key=row_order):
                out += kernel.offer(int(r.seq), np.array(r.features, float))
            kernel.refresh()
            return _frame(key[0], out, kernel)

        self._write(batch.select("stream_key", "seq", "features").groupBy("stream_key").cogroup(old.groupBy("stream_key")).applyInPandas(advance, _OUT), version)

    def finish(self, spark: SparkSession, version: int) -> None:
        """The end of the stream after the batches below `version`: labels of the rows still buffered, and the last models."""

        def last(key: tuple, state: pd.DataFrame) -> pd.DataFrame:
            kernel = Kernel.load(state["state"].iloc[0])
            out = kernel.close()
            kernel.refresh()
            return _frame(key[0], out, kernel)

        self._write(self._state(ship(spark).range(0), version - 1).groupBy("stream_key").applyInPandas(last, _OUT), version)

    def labels(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/labels")


def _frame(key: int, labels: list, kernel: Kernel) -> pd.DataFrame:
    """A key's labels and, in a row of its own, its state."""
    frame = pd.DataFrame([*labels, (None, None, None, None)], columns=["seq", "context_id", "score", "is_outlier"])
    frame.insert(0, "stream_key", key)
    frame["state"] = [None] * len(labels) + [kernel.dump()]
    return frame.astype({"seq": "Int64", "context_id": "Int32", "is_outlier": "boolean", "score": "float64"})


def replay(trainer: OnlineTrainer, obs: DataFrame, chunks: int, size: int) -> DataFrame:
    """A bounded table in batches of `size` seq numbers of each key, as a stream would bring it, and its end."""
    for v in range(chunks):
        trainer.process(obs.where((F.col("seq") >= v * size) & (F.col("seq") < (v + 1) * size)), v)
    trainer.finish(obs.sparkSession, chunks)
    return trainer.labels(obs.sparkSession)
