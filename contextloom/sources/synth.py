"""A seeded stream of true concepts: each has its own scale and offset, and lasts a number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def concepts(n: int, features: int, scale: float, offset: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r = np.random.default_rng(seed)
    return [(r.random(features) * scale, r.random(features) * offset) for _ in range(n)]


def stream(spark: SparkSession, durations: list[int], *, concept_scale: float = 1.0, offset_scale: float = 3.0, n_concepts: int = 3, n_features: int = 5, seed: int = 1, streams: int = 1) -> DataFrame:
    """stream_key, seq, features, truth. Spell i lasts durations[i] rows of concept i modulo n_concepts. Rows are made where
    they are used: a row's numbers depend on seed, stream and seq alone."""
    made = concepts(n_concepts, n_features, concept_scale, offset_scale, seed)
    ends = np.cumsum(durations)
    m = int(ends[-1])
    spell = F.lit(len(durations) - 1)
    for i in range(len(durations) - 2, -1, -1):
        spell = F.when(F.col("seq") < int(ends[i]), F.lit(i)).otherwise(spell)
    rows = spark.range(m * streams).select((F.col("id") / m).cast("long").alias("stream_key"), (F.col("id") % m).alias("seq")).withColumn("truth", (spell % n_concepts).cast("int"))

    # Arrays and functions over them keep the expression small, however many features there are.
    table = lambda part: F.element_at(F.array(*(F.array(*(F.lit(float(x)) for x in c[part])) for c in made)), F.col("truth") + 1)
    rows = rows.withColumns({"__scale": table(0), "__offset": table(1)})

    def number(j: Column) -> Column:
        # Box-Muller from two hashes of the row.
        u = [(F.pmod(F.xxhash64(F.lit(seed), "stream_key", "seq", j, F.lit(k)), F.lit(2**52)) + F.lit(0.5)) / float(2**52) for k in (0, 1)]
        z = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.lit(np.pi) * u[1])
        return z * F.element_at("__scale", j + 1) + F.element_at("__offset", j + 1)

    features = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), number)
    return rows.select("stream_key", "seq", features.alias("features"), "truth")
