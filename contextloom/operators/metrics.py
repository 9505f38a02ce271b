"""Agreement of two labellings, and ranking quality of an anomaly score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.runtime import cut


def contingency(df: DataFrame, u: str, v: str, key: list[str] | None = None) -> DataFrame:
    """key, u, v, n: rows with each pair of labels. Labels may be of any type."""
    return df.groupBy(*(key or []), F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").alias("n"))


def _pairs(c: Column | str) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return c * (c - 1) / 2


def _sums(table: DataFrame, key: list[str]) -> DataFrame:
    """One row (per key): n, pairs in the same cell, in the same u, in the same v."""
    side = lambda k: table.groupBy(*key, k).agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(_pairs("m")).alias(f"p{k}"))
    cells = table.groupBy(*key).agg(F.sum("n").cast("double").alias("n"), F.sum(_pairs("n")).alias("p"))
    if key:
        return cells.join(side("u"), key).join(side("v"), key)
    return cells.crossJoin(F.broadcast(side("u"))).crossJoin(F.broadcast(side("v")))  # a row each


def rand_indices(table: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, adjusted, rand, mirkin, hubert from a contingency table (one per key). adjusted is 0 where it is undefined."""
    total = _pairs("n")
    agree = total + 2 * F.col("p") - F.col("pu") - F.col("pv")
    chance = F.col("pu") * F.col("pv") / total
    top, bottom = F.col("p") - chance, (F.col("pu") + F.col("pv")) / 2 - chance
    adjusted = F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)
    rand = agree / total
    return _sums(table, key or []).select(*(key or []), adjusted.alias("adjusted"), rand.alias("rand"), (1 - rand).alias("mirkin"), (2 * rand - 1).alias("hubert"))


def adjusted_rand(table: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, ari from a contingency table (one per key) by pair counts: NaN where it is undefined."""
    chance = F.col("pu") * F.col("pv") / _pairs("n")
    bottom = (F.col("pu") + F.col("pv")) / 2 - chance
    return _sums(table, key or []).select(*(key or []), F.when(bottom == 0, F.lit(float("nan"))).otherwise((F.col("p") - chance) / bottom).alias("ari"))


def auc(df: DataFrame, score: str, truth: str, range_rows: int = 1_000_000) -> DataFrame:
    """auc: the chance that a row with truth 1 outranks one with truth 0, ties counting half, in the direction that gives more.

    Equal scores are counted first and that table is written once. Running sums go over the distinct scores in ranges of
    their order, whose bounds are fixed numbers, so no task gets them all and no plan or retry moves a score."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    by = cut(rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n")))
    parts = min(512, 1 + by.count() // range_rows)
    bounds = by.approxQuantile("s", [k / parts for k in range(1, parts)], 0.001) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda b: b < F.col("s")))
    ranged = by.withColumns({"part": part, "neg": F.col("n") - F.col("pos")})
    ends = ranged.groupBy("part").agg(F.sum("neg").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0))).join(F.broadcast(ends.select("part", "before")), "part")
    won = F.sum(F.col("pos") * (F.col("before") + F.col("below") + F.col("neg") / 2))
    raw = (won / (F.sum("pos").cast("double") * F.sum("neg"))).alias("raw")
    return inside.agg(raw).select(F.greatest("raw", 1 - F.col("raw")).alias("auc"))


def cluster_sizes(labels: DataFrame, label: str = "context_id") -> DataFrame:
    """Rows assigned to each context."""
    return labels.groupBy(label).agg(F.count("*").alias("n"))
