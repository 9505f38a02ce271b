"""Mixing sources to target weights by Pfair scheduling (Baruah et al. 1996).

A source's documents, in a pseudo-random but fixed order, are cut into units, four to a block of `block_rows`. The target after
t slots of a unit each is the fluid share: every source that has rows left gets slots in proportion to its weight. After any
number of slots a source is within less than one block of its target, whatever the size of the table.

The slots are cut into frames of `frame_slots`, and at the end of each, and wherever a source runs out, every source's target is
rounded up or down so that the sum is right (the next due first). Within a frame the k-th of a source's c units is released
at slot floor((k - 1) / w) and due at slot ceil(k / w), w being c over the frame's slots, and in each slot the released unit
with the earliest deadline goes next. Rounding adds less than one unit to the less than one of the schedule. Weights are
exact: the floating-point numbers given, as whole numbers of one common unit.

Frames are scheduled in parallel, a task holds one at a time, and the schedule stays a table (a row a unit) that the rows
are joined with. No number of sources is too large: more than `group_sources` are dealt to groups, which share the slots as
sources do, and share theirs among their members in the same way; a member is then within less than four units. The
share of a member that runs out goes to its group. A source may hold any share of the rows: rows are ranked in hash ranges
of a source, whose counts are added up. Rows that repeat one id, if they are at least a thousandth of all, are ranked by
the task that read them.

A source that weights name with 0, or don't name, has no slot before all others have run out; such sources then follow each other by
the square root of their counts, as all do without weights. Weights below 0 and those that aren't numbers are errors. Null
sources form a stream of their own. Rows that repeat an id stay next to each other, in any order, unless they are
very many. Null ids are spread like different ids. An empty table gives an empty result. Extra columns, but for maps, are kept by `interleave`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextloom.runtime import cut, ship

BLOCK_ROWS = 16
UNITS = 4
FRAME_SLOTS = 1 << 18
GROUP_SOURCES = 1000
_NULL = "\x00null"


def slots(weights: list[int]) -> list[list[int]]:
    """The slots of each source in a frame of sum(weights) slots, by earliest deadline among released units."""
    period = sum(weights)
    waiting = [(0, i, 1) for i, w in enumerate(weights) if w]  # release, source, unit
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, unit
    out: list[list[int]] = [[] for _ in weights]
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * period // weights[i]), i, k))
        _, i, k = heapq.heappop(ready)
        out[i].append(t)
        if k < weights[i]:
            heapq.heappush(waiting, (k * period // weights[i], i, k + 1))
    return out


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in the exact proportions of positive weights."""
    ratios = [Fraction(w) for w in weights]
    unit = math.lcm(*(r.denominator for r in ratios))
    parts = [int(r * unit) for r in ratios]
    common = math.gcd(*parts)
    return [p // common for p in parts]


def frames(units: list[int], weights: list[int], frame_slots: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(first slot, slots, [(source, first unit, units)]) of each frame, until every unit has its slot."""
    given = [0] * len(units)
    # Sources run out in the order of their units over their weight.
    order = sorted((i for i, n in enumerate(units) if n), key=lambda i: (Fraction(units[i], weights[i]), i))
    gone, used, live = 0, 0, sum(weights[i] for i in order)  # sources that ran out, their units, the weight of the others
    start, total = 0, sum(units)
    while start < total:
        # The end: a full frame, or the slot in which the next source runs out.
        i = order[gone]
        end = min(start + frame_slots, max(start + 1, used + -(-live * units[i] // weights[i])), total)
        while True:
            while gone < len(order) and used * weights[order[gone]] + live * units[order[gone]] <= end * weights[order[gone]]:
                used, live, gone = used + units[order[gone]], live - weights[order[gone]], gone + 1
            low = {j: min(units[j], weights[j] * (end - used) // live) for j in order[gone:]} if live else {}
            missing = end - used - sum(low.values())
            must = [j for j in low if given[j] > low[j]]
            if len(must) <= missing:
                break
            end += 1  # what was rounded up before is not taken back
        due = sorted((j for j in low if given[j] <= low[j] < units[j]), key=lambda j: (Fraction(low[j] + 1, weights[j]), j))
        for j in (*must, *due[: missing - len(must)]):
            low[j] += 1
        part = []
        for j in order:
            to = low.get(j, units[j])
            if to > given[j]:
                part.append((j, given[j], to - given[j]))
                given[j] = to
        yield start, end - start, part
        start = end


def _schedule(children: DataFrame, frame_slots: int) -> DataFrame:
    """children: node, child, n (units), w (weight above 0). node, child, k (unit of the child), slot (of the node)."""

    def grouped(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
        """The runs of equal keys, each whole."""
        held: list[pd.DataFrame] = []
        for p in parts:
            for _, g in p.groupby(key, sort=False):
                if held and tuple(held[0][key].iloc[0]) != tuple(g[key].iloc[0]):
                    yield pd.concat(held)
                    held = []
                held.append(g)
        if held:
            yield pd.concat(held)

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(parts, ["node"]):
            names, node = g["child"].tolist(), g["node"].iloc[0]
            for start, size, part in frames(g["n"].tolist(), whole(g["w"].tolist()), frame_slots):
                yield pd.DataFrame([(node, start, size, names[i], a, c) for i, a, c in part], columns=["node", "start", "size", "child", "first", "n"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(parts, ["node", "start"]):
            node, start = g["node"].iloc[0], int(g["start"].iloc[0])
            for child, first, at in zip(g["child"], g["first"], slots(g["n"].tolist()), strict=True):
                yield pd.DataFrame({"node": node, "child": child, "k": range(first, first + len(at)), "slot": [start + t for t in at]})

    parts = cut(children.repartition("node").sortWithinPartitions("node", "child").mapInPandas(plan, "node string, start long, size long, child string, first long, n long"))
    return parts.repartition("node", "start").sortWithinPartitions("node", "start", "child").mapInPandas(run, "node string, child string, k long, slot long")


def plan(counts: DataFrame, weights: dict[str, float] | None, *, unit_rows: int, group_sources: int = GROUP_SOURCES, frame_slots: int = FRAME_SLOTS) -> DataFrame:
    """counts: stream, n (rows). stream, k (unit of the stream), slot: every unit's slot."""
    spark = counts.sparkSession
    if bad := [s for s, w in (weights or {}).items() if not (isinstance(w, (int, float)) and math.isfinite(w) and w >= 0)]:
        raise ValueError(f"weights must be finite numbers from 0 on: {', '.join(map(str, bad))}")
    root = F.sqrt("n")
    named = counts.withColumns({"target": root, "tier": F.lit(0)})
    if weights is not None:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "stream string, given double")
        some = F.coalesce("given", F.lit(0.0)) > 0
        named = counts.join(F.broadcast(given), "stream", "left").withColumns({"target": F.when(some, F.col("given")).otherwise(root), "tier": F.when(some, 0).otherwise(1)})
    units = F.ceil(F.col("n") / unit_rows).cast("long")
    leaves = named.select("tier", "stream", units.alias("n"), F.col("target").alias("w"))
    size = leaves.groupBy("tier").agg(F.count("*").alias("s"), F.sum("n").alias("all"))
    groups = F.when(F.col("s") <= group_sources, 1).otherwise(F.ceil(F.col("s") / F.greatest(F.lit(group_sources), F.sqrt("s"))))
    first = F.coalesce(F.sum("all").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # two rows at most
    size = cut(size.select("tier", groups.cast("long").alias("g"), first.alias("first")))
    leaves = cut(leaves.join(F.broadcast(size), "tier").withColumn("node", F.concat_ws("/", "tier", F.pmod(F.xxhash64("stream"), F.col("g")))))
    lower = _schedule(leaves.select("node", F.col("stream").alias("child"), "n", "w"), frame_slots)
    top = leaves.groupBy("tier", F.col("node").alias("child")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.first("first").alias("first"))
    if size.where("g > 1").limit(1).count():
        upper = _schedule(top.select(F.col("tier").cast("string").alias("node"), "child", "n", "w"), frame_slots)
        lower = lower.select("child", "k", "node", F.col("slot").alias("at")).join(upper.select(F.col("child").alias("node"), F.col("k").alias("at"), "slot"), ["node", "at"])
    offset = F.broadcast(size.select(F.col("tier").cast("string").alias("tier"), "first"))  # two rows at most
    return lower.withColumn("tier", F.substring_index("node", "/", 1)).join(offset, "tier").select(F.col("child").alias("stream"), "k", (F.col("slot") + F.col("first")).alias("slot"))


def _placed(docs: DataFrame, keep: dict[str, Column], h: Column, source_col: str, weights: dict[str, float] | None, block_rows: int, **more) -> DataFrame:
    """keep, stream, block (of the source), slot, position. h: the hash that orders the rows of a source; equal ones are told
    apart by the task that read them, so the rows are written first."""
    ship(docs.sparkSession)
    unit = max(1, block_rows // UNITS)
    stream = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))
    rows = cut(docs.select(*(c.alias(n) for n, c in keep.items()), stream.alias("stream"), h.alias("h"), F.spark_partition_id().alias("task")))
    total = rows.count()
    bits = max(8, (total // 20_000).bit_length())
    hot = rows.groupBy("stream", "h").agg(F.count("*").alias("k")).where(F.col("k") >= max(1000, total / 1000)).select("stream", "h", F.lit(True).alias("hot"))  # a thousand at most
    ranged = rows.join(F.broadcast(cut(hot)), ["stream", "h"], "left").withColumns({"range": F.shiftrightunsigned("h", 64 - bits), "task": F.when(F.col("hot"), F.col("task")).otherwise(-1), "again": F.when(F.col("hot"), F.col("h")).otherwise(0)}).drop("hot")
    part = ["range", "again", "task"]
    before = ranged.groupBy("stream", *part).agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.partitionBy("stream").orderBy(*part)) - F.col("k")).drop("k")
    ranked = ranged.withColumn("r", F.row_number().over(Window.partitionBy("stream", *part).orderBy("h")) - 1)
    ranked = ranked.join(before, ["stream", *part]).withColumn("rank", F.col("before") + F.col("r")).withColumn("k", F.floor(F.col("rank") / unit))
    found = ranked.join(plan(cut(rows.groupBy("stream").agg(F.count("*").alias("n"))), weights, unit_rows=unit, **more), ["stream", "k"])
    return found.select(*keep, "stream", F.floor(F.col("k") / UNITS).alias("block"), "slot", (F.col("slot") * unit + F.col("rank") % unit).cast("long").alias("position"))


def positions(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, **more) -> DataFrame:
    """id, source, block (of the source), slot, position: unique, rising in mixed order. more: group_sources, frame_slots."""
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00"), F.monotonically_increasing_id())))
    return _placed(docs, {id_col: F.col(id_col), source_col: F.col(source_col)}, h, source_col, weights, block_rows, **more).select(id_col, source_col, "block", "slot", "position")


def interleave(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, **more) -> DataFrame:
    """All documents with all their columns, range-partitioned and sorted in mixed order.

    A row is known by 128 bits of hash of all its columns. Rows equal in all columns are dealt to their places as copies of
    one of them, so however many there are, no task gets all."""
    name = ["__ctx_1", "__ctx_2"]
    key = dict(zip(name, (F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)), strict=True))
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00"), key["__ctx_1"])))
    at = cut(_placed(docs, key, h, source_col, weights, block_rows, **more).select(*name, F.col("position").alias("__ctx_at")))
    rows = docs.withColumns(key)
    twice = cut(at.groupBy(*name).agg(F.count("*").alias("__ctx_n")).where("__ctx_n > 1").drop("__ctx_n"))
    if not twice.limit(1).count():
        mixed = rows.join(at, name)
    else:
        spread = 64
        one = rows.join(twice, name, "left_semi").groupBy(*name).agg(F.first(F.struct(*docs.columns)).alias("row"))
        one = one.withColumn("__ctx_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        places = at.join(twice, name, "left_semi").withColumn("__ctx_s", F.pmod(F.xxhash64("__ctx_at"), F.lit(spread)).cast("int"))
        copies = places.join(one, [*name, "__ctx_s"]).select("row.*", "__ctx_at")
        mixed = rows.join(twice, name, "left_anti").join(at, name).select(*docs.columns, "__ctx_at").unionByName(copies)
    return mixed.repartitionByRange(F.col("__ctx_at")).sortWithinPartitions("__ctx_at").select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
