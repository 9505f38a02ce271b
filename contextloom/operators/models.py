"""Fitting models to groups of rows, and what can be told of them without a decomposition."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.plans.kernel import Model, Params
from contextloom.plans.train import model_row
from contextloom.runtime import ship
from contextloom.schema import MODEL


def mean_cov(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """A row per group: n, mu_<i> and the sample covariances s_<i>_<j>, i <= j. Partial sums are combined before the shuffle."""
    pairs = combinations_with_replacement(range(len(cols)), 2)
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mu_{i}") for i, c in enumerate(cols)), *(F.covar_samp(cols[i], cols[j]).alias(f"s_{i}_{j}") for i, j in pairs))


def eigen2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Eigenvalues, larger first, of the symmetric matrix (a b; b d); below zero is rounding and becomes 0."""
    mid, off = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)
    return F.greatest(mid + off, F.lit(0.0)), F.greatest(mid - off, F.lit(0.0))


def component_count(values: DataFrame, by: str, value: str, p_var: float) -> DataFrame:
    """n_pcs per group: the first k whose share of the total reaches p_var; all of them where p_var is 1 or nothing varies."""
    w = Window.partitionBy(by)
    order = w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.select(by, F.row_number().over(w.orderBy(F.desc(value))).alias("k"), (F.sum(value).over(order) / F.sum(value).over(w)).alias("share"))
    first = F.min(F.when(F.col("share") >= p_var, F.col("k"))) if p_var < 1 else F.max("k")
    return ranked.groupBy(by).agg(F.coalesce(first, F.max("k")).cast("long").alias("n_pcs"))


def find_rank(values: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """rank per group: the fewest of the largest values that hold strictly more than `share` of the total; all of them where
    none do, as with a share of 1."""
    w = Window.partitionBy(by)
    order = w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.select(by, F.row_number().over(w.orderBy(F.desc(value))).alias("k"), (F.sum(value).over(order) / F.sum(value).over(w)).alias("held"))
    return ranked.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("held") > share, F.col("k"))), F.max("k")).cast("long").alias("rank"))


def fit(obs: DataFrame, by: str, p_var: float = 0.98, mem: int = 500) -> DataFrame:
    """A model per group from the latest `mem` rows: obs has `by`, seq, features. Ids are ranks of the groups' names."""
    ship(obs.sparkSession)
    kind = obs.schema[by].dataType.simpleString()
    ids = obs.select(by).distinct().withColumn("model_id", F.row_number().over(Window.orderBy(by)))  # groups are few
    latest = obs.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("age") <= mem).drop("age")
    p = Params(drift_threshold=0, drift_size=1, p_var=p_var, model_mem=mem)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        rows = [(int(s), np.array(x, float)) for s, x in zip(pdf["seq"], pdf["features"], strict=True)]
        m = model_row(Model(int(pdf["model_id"].iloc[0]), rows, rows[-1][0], p))
        return pd.DataFrame([{by: pdf[by].iloc[0], **m}])

    fields = MODEL[len("struct<") : -1].replace(":", " ")
    return latest.join(ids, by).groupBy(by).applyInPandas(one, f"`{by}` {kind}, {fields}")
