"""Transitions between contexts: counts, Markov chain, rarity, next context, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(labels: DataFrame, key: list[str], seq: str = "seq", label: str = "context_id", first: bool = True) -> DataFrame:
    """key, from_id, to_id, n of consecutive rows. first: the first row of a key counts once on its own context's diagonal, so
    that n adds up to the rows."""
    w = Window.partitionBy(*key).orderBy(seq)
    before = F.lag(label).over(w)
    pairs = labels.select(*key, (F.coalesce(before, F.col(label)) if first else before).alias("from_id"), F.col(label).alias("to_id"))
    return pairs.where(F.col("from_id").isNotNull()).groupBy(*key, "from_id", "to_id").agg(F.count("*").alias("n"))


def pooled(transitions: DataFrame) -> DataFrame:
    """Counts of all keys together."""
    return transitions.groupBy("from_id", "to_id").agg(F.sum("n").alias("n"))


def markov(transitions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """p: each count over the counts that leave its context. A context that is never left has no rows."""
    return transitions.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*(key or []), "from_id")))


def rarity(transitions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, to_id, rarity: the share of all transitions (of the key) that lead to a context."""
    key = key or []
    total = transitions.groupBy(*key).agg(F.sum("n").alias("total"))
    to = transitions.groupBy(*key, "to_id").agg(F.sum("n").alias("n"))
    both = to.join(total, key) if key else to.crossJoin(F.broadcast(total))  # one row
    return both.select(*key, "to_id", (F.col("n") / F.col("total")).alias("rarity"))


def next_context(chain: DataFrame) -> DataFrame:
    """from_id, next_id, p: the likeliest next context, of equally likely ones the least id."""
    return chain.groupBy("from_id").agg(F.max(F.struct("p", (-F.col("to_id")).alias("minus"))).alias("b")).select("from_id", (-F.col("b.minus")).alias("next_id"), F.col("b.p").alias("p"))


def out_degree(transitions: DataFrame) -> DataFrame:
    """from_id, degree: transitions that leave a context. Sort it for the degree plot."""
    return transitions.groupBy("from_id").agg(F.sum("n").alias("degree"))


def degree_histogram(degrees: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """bin (1 to bins; 0 and bins + 1 lie outside) and how many contexts fall into it."""
    return degrees.groupBy(F.width_bucket(F.col("degree").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
