"""Reading numeric tables, and keeping models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.plans.train import Trained


def csv_observations(spark: SparkSession, path: str, columns: list[str], order: str | None = None) -> DataFrame:
    """A CSV file with a header, all of whose named columns are numbers. order: a column that gives the rows' order; without
    one the order of the file counts, which asks for a single file that is not split."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    seq = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    feats = [c for c in columns if c != order]
    return df.select(F.lit(0).cast("long").alias("stream_key"), seq.alias("seq"), F.array(*feats).alias("features"))


def save(trained: Trained, path: str) -> None:
    """Labels, models and transitions as Parquet folders under path."""
    for name in ("labels", "models", "transitions"):
        getattr(trained, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Trained:
    return Trained(*(spark.read.parquet(f"{path}/{name}") for name in ("labels", "models", "transitions")))
