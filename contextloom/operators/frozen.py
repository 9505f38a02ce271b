"""The stream operators on models that no longer change, as windows, and the pieces of a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drift_runs(scored: DataFrame, threshold: float, key: list[str], seq: str = "seq") -> DataFrame:
    """key, run_start, run_end, length of each run of consecutive rows whose score is above the threshold."""
    w = Window.partitionBy(*key)
    flagged = scored.withColumn("__out", F.col("score") > threshold)
    island = F.row_number().over(w.orderBy(seq)) - F.row_number().over(Window.partitionBy(*key, "__out").orderBy(seq))
    runs = flagged.withColumn("__i", island).where("__out")
    return runs.groupBy(*key, "__i").agg(F.min(seq).alias("run_start"), F.max(seq).alias("run_end"), F.count("*").alias("length")).drop("__i")


def window_drift(scored: DataFrame, threshold: float, size: int, key: list[str], seq: str = "seq") -> DataFrame:
    """scored with n_out, the outliers among the last `size` rows, and detected: the window is full, its newest and oldest rows
    are outliers and more than half of it are."""
    w = Window.partitionBy(*key).orderBy(seq)
    flag = scored.withColumn("__out", (F.col("score") > threshold).cast("long"))
    n, oldest, k = F.sum("__out").over(w.rowsBetween(-(size - 1), 0)), F.lag("__out", size - 1).over(w), F.row_number().over(w)
    flag = flag.withColumns({"n_out": n, "__old": oldest, "__k": k})
    hit = (F.col("__k") >= size) & (F.col("__out") == 1) & (F.coalesce("__old", F.lit(0)) == 1) & (F.col("n_out") > size / 2)
    return flag.withColumn("detected", hit).drop("__out", "__old", "__k")


def retained_memory(labels: DataFrame, mem: int, key: list[str], seq: str = "seq") -> DataFrame:
    """The latest `mem` rows of each group, with age 1 for the latest."""
    return labels.withColumn("age", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq))).cast("long")).where(F.col("age") <= mem)


def interleave(a: DataFrame, b: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows of two memories in turn, the latest of each first: side (0 or 1) and place, from 1. Memories are bounded."""
    ranked = lambda df, s: df.withColumns({"side": F.lit(s), "__r": F.row_number().over(Window.orderBy(F.desc(seq)))})
    both = ranked(a, 0).unionByName(ranked(b, 1))
    return both.withColumn("place", F.row_number().over(Window.orderBy("__r", "side")).cast("long")).drop("__r")


def oldest_model(models: DataFrame) -> DataFrame:
    """model_id, last_update_seq of the model whose last update is the earliest; of equals the least id."""
    return models.agg(F.min(F.struct("last_update_seq", "model_id")).alias("b")).select(F.col("b.model_id").alias("model_id"), F.col("b.last_update_seq").alias("last_update_seq"))


def nearest_model(models: DataFrame, cols: list[str]) -> DataFrame:
    """model_id, near_id, distance: for each model the other one with the nearest centroid; of equals the least id. Models are
    few: at most model_limit."""
    other = models.select(F.col("model_id").alias("near_id"), *(F.col(c).alias(f"__{c}") for c in cols))
    d = F.sqrt(sum(((F.col(c) - F.col(f"__{c}")) ** 2 for c in cols), F.lit(0.0)))
    pairs = models.join(F.broadcast(other), F.col("model_id") != F.col("near_id")).select("model_id", F.struct(d.alias("distance"), "near_id").alias("b"))
    return pairs.groupBy("model_id").agg(F.min("b").alias("b")).select("model_id", F.col("b.near_id").alias("near_id"), F.col("b.distance").alias("distance"))
