"""Shapes of the frames that operators take and give.

observations  stream_key, seq BIGINT, features ARRAY<DOUBLE>: seq is a total order within a key
labels        stream_key, seq, context_id INT, score DOUBLE, is_outlier BOOLEAN
models        stream_key, model_id INT, n_pcs INT, centroid, coeff, variances, memory, last_update_seq BIGINT
transitions   stream_key, from_id INT, to_id INT, n BIGINT
scores        seq, model_id, score
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "seq bigint, context_id int, score double, is_outlier boolean"
MODEL = "struct<model_id:int,n_pcs:int,centroid:array<double>,coeff:array<array<double>>,variances:array<double>,memory:array<array<double>>,last_update_seq:bigint>"
TRANSITION = "struct<from_id:int,to_id:int,n:bigint>"


def is_valid(features: str | Column = "features") -> Column:
    """Whether every feature is a finite number."""
    c = F.col(features) if isinstance(features, str) else features
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & ~bad


def observations(df: DataFrame, features: list[str], seq: str | Column, key: str | Column | None = None) -> DataFrame:
    """Columns of df as observations. Rows with a missing or non-finite feature are left out; see rejected()."""
    return _framed(df, features, seq, key).where(is_valid())


def rejected(df: DataFrame, features: list[str], seq: str | Column, key: str | Column | None = None) -> DataFrame:
    """The rows that observations() leaves out."""
    return _framed(df, features, seq, key).where(~is_valid())


def _framed(df: DataFrame, features: list[str], seq: str | Column, key: str | Column | None) -> DataFrame:
    k = F.lit(0).cast("long") if key is None else F.col(key) if isinstance(key, str) else key
    s = F.col(seq) if isinstance(seq, str) else seq
    return df.select(k.alias("stream_key"), s.cast("long").alias("seq"), F.array(*(F.col(c).cast("double") for c in features)).alias("features"))
