"""Preparing observations: order, splits, chunks, recoding, standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-14


def with_seq(df: DataFrame, key: list[str], order: list[str], name: str = "seq", first: int = 0) -> DataFrame:
    """Number the rows of each key in order. Give a key: without one all rows go to one task."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1 + first).cast("long"))


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each column, as mean_<c> and sd_<c>."""
    return df.agg(*(e for c in cols for e in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))))


def zscore(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Columns less their mean, over their sample deviation plus EPS. fit_on: rows that mean and deviation come from, all
    rows by default; give the training rows to keep a test set out of them."""
    m = F.broadcast(moments(df if fit_on is None else fit_on, cols))  # one row
    z = {n: (F.col(c) - F.col(f"mean_{c}")) / (F.col(f"sd_{c}") + EPS) for c, n in zip(cols, names or cols, strict=True)}
    return df.crossJoin(m).withColumns(z).drop(*(f"{a}_{c}" for a in ("mean", "sd") for c in cols))


def split(df: DataFrame, share: float, key: list[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(first rows, the rest) of each key by position: floor(share * rows) rows come first."""
    n = F.count("*").over(Window.partitionBy(*key))
    marked = df.withColumn("__n", F.floor(F.lit(share) * n))
    return marked.where(F.col(seq) < F.col("__n")).drop("__n"), marked.where(F.col(seq) >= F.col("__n")).drop("__n")


def prefix(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    return df.where(F.col(seq) < k)


def chunk(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """chunk_id of each row: one pass, no row lost between chunks."""
    return df.withColumn("chunk_id", F.floor(F.col(seq) / size).cast("long"))


def recode(label: str | Column, normal: str | int) -> Column:
    """0 for the normal label, 1 for any other."""
    return F.when((F.col(label) if isinstance(label, str) else label) == normal, 0).otherwise(1)


def sanitise(df: DataFrame, label: str, normal: str | int) -> DataFrame:
    """Only rows of the normal label."""
    return df.where(F.col(label) == normal)


def centred(features: Column, centroid: Column) -> Column:
    return F.zip_with(features, centroid, lambda a, b: a - b)


def norm(features: Column | str) -> Column:
    """Euclidean length of a row's features."""
    return F.sqrt(F.aggregate(F.transform(features, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def norms(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: n, total and mean of the rows' lengths."""
    return df.select(norm(features).alias("l")).agg(F.count("*").alias("n"), F.sum("l").alias("total"), F.avg("l").alias("mean"))
