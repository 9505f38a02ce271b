import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextloom.llm import mixing


def fluid(units, weights):
    """Targets after each slot: every source that has units left gets slots by its weight, in exact fractions."""
    left, got, out, t = [Fraction(n) for n in units], [Fraction(0)] * len(units), [], Fraction(0)
    want = iter(range(1, sum(units) + 1))
    t_next = next(want, None)
    while t_next is not None:
        live = [i for i, x in enumerate(left) if x > 0]
        all_ = sum(weights[i] for i in live)
        step = min(*(left[i] * all_ / weights[i] for i in live), Fraction(t_next) - t) if live else 0
        for i in live:
            got[i] += step * weights[i] / all_
            left[i] -= step * weights[i] / all_
        t += step
        if t == t_next:
            out.append(list(got))
            t_next = next(want, None)
    return out


def slot_by_slot(weights):
    """Earliest deadline first, one slot after the other."""
    q, done, out = sum(weights), [0] * len(weights), []
    for t in range(q):
        ready = [(-(-(done[i] + 1) * q // w), i) for i, w in enumerate(weights) if done[i] < w and done[i] * q // w <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
        assert all(abs(done[j] - (t + 1) * Fraction(w, q)) < 1 for j, w in enumerate(weights))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6).filter(any))
def test_slots_equal_the_slot_by_slot_schedule(weights):
    got = {t: i for i, at in enumerate(mixing.slots(weights)) for t in at}
    assert [got[t] for t in range(sum(weights))] == slot_by_slot(weights)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=6), st.integers(1, 50))
def test_frames_hold_every_unit_once_and_keep_to_the_fluid_targets(sources, size):
    units, weights = [n for n, _ in sources], [w for _, w in sources]
    order, given_, at = [], [0] * len(units), 0
    for start, n, part in mixing.frames(units, weights, size):
        assert start == at and sum(c for _, _, c in part) == n
        at += n
        place = {t: part[x][0] for x, ts in enumerate(mixing.slots([c for _, _, c in part])) for t in ts}
        order += [place[t] for t in range(n)]
        for i, first, c in part:
            assert first == given_[i]
            given_[i] += c
    assert given_ == units and len(order) == sum(units)
    done = [0] * len(units)
    for i, target in zip(order, fluid(units, weights), strict=True):
        done[i] += 1
        assert all(abs(d - y) < 2 for d, y in zip(done, target, strict=True))


def deviations(rows, counts, targets, block_rows):
    """The largest distance, in blocks, of a source from its fluid target, after every unit."""
    unit = block_rows // mixing.UNITS
    names = sorted(counts)
    units = [-(-counts[s] // unit) for s in names]
    order = {r.slot: names.index(r.source) for r in rows}
    done, worst = [0] * len(names), 0
    for t, target in enumerate(fluid(units, mixing.whole([targets[s] for s in names]))):
        done[order[t]] += 1
        worst = max(worst, *(abs(d - y) for d, y in zip(done, target, strict=True)))
    return worst / mixing.UNITS


@pytest.mark.parametrize("target", [{"a": 0.0004, "b": 0.3, "c": 0.6996}, None])
def test_less_than_a_block_from_the_exact_targets(spark, target):
    counts = {"a": 5, "b": 1500, "c": 2499}
    df = spark.range(4004).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, "a").when(F.col("id") < 1505, "b").otherwise("c").alias("source"))
    for slots in (100, mixing.FRAME_SLOTS):
        rows = mixing.positions(df, weights=target, block_rows=8, frame_slots=slots).collect()
        assert len(rows) == 4004 == len({r.position for r in rows}) == len({r.doc_id for r in rows})
        assert deviations(rows, counts, target or {s: n**0.5 for s, n in counts.items()}, 8) < 1


def test_one_large_target_among_very_many_sources(spark):
    """A source of half of the weight and 300 of the other half, in groups of 20: every one keeps to its own target."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "s").otherwise(F.concat(F.lit("t"), (F.col("id") % 300).cast("string"))).alias("source"))
    counts = Counter(r.source for r in df.collect())
    w = {s: 300.0 if s == "s" else 1.0 for s in counts}
    flat = mixing.positions(df, weights=w, block_rows=8).collect()
    assert deviations(flat, counts, w, 8) < 1
    rows = mixing.positions(df, weights=w, block_rows=8, group_sources=20).collect()
    assert len(rows) == 3000 == len({r.position for r in rows}) and {r.doc_id for r in rows} == set(range(3000))
    half = [r.source for r in sorted(rows, key=lambda r: r.position)][:1200]
    seen = Counter(half)
    assert abs(seen["s"] - 600) < 8 and max(abs(seen[s] - 2) for s in w if s != "s") < 8


def test_zero_and_unnamed_sources_come_last_and_bad_weights_are_errors(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    order = [r.source for r in mixing.positions(df, weights={"s0": 1, "s1": 0.0, "s2": 3.0}).orderBy("position").collect()]
    assert set(order[:200]) == {"s0", "s2"} and set(order[200:]) == {"s1", "s3"} and len(order) == 400
    for w in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="weights"):
            mixing.positions(df, weights={"s0": w})


def test_a_hot_source_a_hot_id_and_null_ids(spark):
    i = F.col("id")
    df = spark.range(6000).select(F.when(i % 3 == 1, F.lit(7)).when(i % 3 == 2, F.lit(None)).otherwise(i).cast("long").alias("doc_id"), F.when(i % 4 > 0, "hot").otherwise("s").alias("source"), (i % 2).alias("x")).repartition(5)
    p = mixing.positions(df, block_rows=4)
    assert p.count() == 6000 == p.select("position").distinct().count()
    assert Counter((r.doc_id, r.source) for r in p.collect()) == Counter((r.doc_id, r.source) for r in df.collect())
    out = mixing.interleave(df)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("weights", [None, {"s0": 3.0}])
def test_messy_rows_keep_all_columns(messy, messy_rows, nothing, weights):
    out = mixing.interleave(messy, weights=weights)
    assert out.columns == messy.columns
    assert Counter(map(str, (tuple(r) for r in out.collect()))) == Counter(map(str, (tuple(r) for r in messy_rows)))
    assert mixing.interleave(nothing).count() == 0 and mixing.positions(nothing).count() == 0


def test_rows_come_in_mixed_order(documents):
    at = {r.doc_id: r.position for r in mixing.positions(documents).collect()}
    got = [at[r.doc_id] for r in mixing.interleave(documents).select("doc_id").collect()]
    assert got == sorted(got)


def test_shares_of_more_slots_than_a_driver_could_walk():
    """Frames alone, over a thousand million units: the rounded targets are within a unit of the exact ones."""
    units, weights = [10**9, 7 * 10**8, 3], mixing.whole([0.6180339887498949, 0.25, 1e-9])
    r, seen = random.Random(1), 0
    for start, n, part in mixing.frames(units, weights, 1 << 24):
        end = start + n
        if r.random() < 0.2 and end * weights[0] < units[0] * sum(weights):
            for i, first, c in part:
                assert abs(first + c - Fraction(end * weights[i], sum(weights))) < 1
            seen += 1
    assert seen > 5
