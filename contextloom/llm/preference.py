"""Preference formatting: a chosen and a rejected conversation to one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; what follows in each is a
completion. A completion's mask lists the spans to learn from: what the assistant says, with the mark that ends a turn.
All of it is DataFrame operations: running lengths by a window over a conversation's turns, then array functions.

Turns are ordered by turn, then role, then text. A null role is "unknown", a null text is empty. A pair with only one
side has an empty other side. Sides that are equal have empty completions. Repeated turns are turns. Turns without a pair id
belong to no pair and are left out: `unpaired` gives them. An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def _mask(turns: Column, start: Column) -> Column:
    """Spans of the assistant's turns in a completion that begins at `start` of the rendered conversation."""
    said = F.filter(turns, lambda t: t.role == "assistant")
    return F.array_join(F.transform(said, lambda t: F.concat_ws(":", (t.end - F.length(t.text) - len(CLOSE) - start).cast("string"), (t.end - 1 - start).cast("string"))), ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side ("chosen" or "rejected"), turn, role, text. Returns pair_id, n_prefix, prompt, chosen, rejected,
    chosen_mask, rejected_mask; a mask is "start:end" code points of its completion, ends exclusive, joined by commas."""
    t = turns.where("pair_id is not null").select("pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("said", render(F.col("role"), F.col("text")))
    # One shuffle by pair_id serves the window and the groups.
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.repartition("pair_id").withColumns({"end": F.sum(F.length("said")).over(order), "k": F.count("*").over(order)})
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("k", "role", "text", "said", "end"))))
    both = t.groupBy("pair_id").agg(side("chosen").alias("a"), side("rejected").alias("b"))
    equal = F.zip_with(F.col("a"), F.col("b"), lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")
    both = both.withColumn("n", n)
    start = F.coalesce(F.try_element_at("a", F.greatest("n", F.lit(1))).end, F.lit(0))
    both = both.withColumn("start", F.when(F.col("n") > 0, start).otherwise(F.lit(0)))
    said = lambda x: F.array_join(F.transform(x, lambda v: v.said), "")
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix"), said(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), said(rest("a")).alias("chosen"), said(rest("b")).alias("rejected"),
        _mask(rest("a"), F.col("start")).alias("chosen_mask"), _mask(rest("b"), F.col("start")).alias("rejected_mask"),
    )


def unpaired(turns: DataFrame, key: str = "pair_id") -> DataFrame:
    """The turns that are left out."""
    return turns.where(F.col(key).isNull())


def swapped(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences. Chosen is each conversation as it is; rejected is the same with its last
    answer replaced by the last answer of the neighbour whose conv_id differs in the lowest bit (empty if it has none)."""
    c = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    donor = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("last.text").alias("other"))
    marked = c.join(last.join(donor, "conv_id", "left").select("conv_id", F.col("last.turn").alias("at"), F.coalesce("other", F.lit("")).alias("other")), "conv_id", "left")
    swap = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("at")), F.col("other")).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), swap.alias("text"))))
    return marked.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(swapped(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP8_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS at FROM c WHERE role = 'assistant' GROUP BY conv_id),
lt AS (SELECT l.conv_id, l.at, max(c.text) AS text FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.at AND c.role = 'assistant' GROUP BY 1, 2),
t AS (SELECT c.conv_id AS pair_id, side, c.turn, c.role,
             CASE WHEN side = 'rejected' AND c.role = 'assistant' AND c.turn = lt.at THEN coalesce(d.text, '') ELSE c.text END AS text
      FROM c CROSS JOIN (VALUES ('chosen'), ('rejected')) s(side) LEFT JOIN lt ON lt.conv_id = c.conv_id LEFT JOIN lt d ON d.conv_id = xor(c.conv_id, 1)),
r AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS k FROM t),
e AS (SELECT *, sum(length(said)) OVER (PARTITION BY pair_id, side ORDER BY k) AS fin FROM r),
p AS (SELECT a.pair_id, coalesce(min(CASE WHEN b.k IS NULL OR a.role <> b.role OR a.text <> b.text THEN a.k END) - 1, max(a.k)) AS n
      FROM e a LEFT JOIN e b ON b.pair_id = a.pair_id AND b.k = a.k AND b.side = 'rejected' WHERE a.side = 'chosen' GROUP BY a.pair_id),
s AS (SELECT p.pair_id, p.n, coalesce(max(e.fin) FILTER (WHERE e.k <= p.n AND e.side = 'chosen'), 0) AS start FROM p JOIN e USING (pair_id) GROUP BY p.pair_id, p.n)
SELECT s.pair_id, CAST(s.n AS BIGINT) AS n_prefix,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE side = 'chosen' AND k <= n), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE side = 'chosen' AND k > n), '') AS chosen,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE side = 'rejected' AND k > n), '') AS rejected,
       coalesce(string_agg((fin - length(text) - 11 - start)::BIGINT || ':' || (fin - 1 - start)::BIGINT, ',' ORDER BY k) FILTER (WHERE side = 'chosen' AND k > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((fin - length(text) - 11 - start)::BIGINT || ':' || (fin - 1 - start)::BIGINT, ',' ORDER BY k) FILTER (WHERE side = 'rejected' AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM s JOIN e USING (pair_id) GROUP BY s.pair_id, s.n
"""
