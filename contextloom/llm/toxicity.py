"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and their first four and five bytes, hashed. The model is
w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms present: the pair part learns that two terms together, such as an
insult and a group's name, weigh more than both alone, which additive weights miss.

Terms enter the model in two ways. Every term's count by label is taken over the training rows, and the `n_terms` terms that
alone tell the labels apart best enter. Then every pair is tested that has one of the `n_frequent` terms whose presence
varies most (whatever their labels): both terms enter if rows with both have a share of toxic labels outside of what the
two terms allow, alone or added, by more than `evidence` standard deviations. So a term that matters only together with
another one enters too. All other terms weigh nothing.

The score is calibrated on rows held back from the fit, toxic rows weighing more by the square root of the labels' ratio:
toxic rows are few, and missing one costs more than a clean row close to the line.

Fitted on at most `max_train` labelled rows (those with the least hash of doc_id; a bound on the driver's memory), scored
on every row in one pass without a shuffle. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no terms and get the score of the intercept. Rows that repeat get equal scores. Without rows of
both labels every score is the share of toxic labels (0 without labels). Labels that are null are left out; of several
labels of a document the largest counts. Other columns are left alone; `score` replaces one of the name it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm import textkernel as K
from contextloom.runtime import cut, ship

DIMS = 1 << 20
MAX_TRAIN = 20_000
N_TERMS = 1024
N_FREQUENT = 2048
EVIDENCE = 6.5
FACTORS = 8


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, dimension) pairs, by row."""
    w = K.words(data, off, prefixes=(4, 5))
    long4, long5 = w.end - w.start > 4, w.end - w.start > 5
    row = np.concatenate([w.doc, w.doc[long4], w.doc[long5]])
    h = np.concatenate([w.hash, w.prefix[4][long4], w.prefix[5][long5]])
    both = np.unique(row.astype(np.int64) * DIMS + (h >> np.uint64(40)).astype(np.int64) % DIMS)
    return both // DIMS, both % DIMS


@dataclass
class Machine:
    """dims: the terms in the model; slope, shift: calibration of the raw sum."""

    dims: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        t = np.full(DIMS, -1, np.int32)
        t[self.dims] = np.arange(len(self.dims))
        return t

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Sums for rows given as (row, term) pairs."""
        out = np.full(rows, self.w0) + np.bincount(row, self.w[term], rows)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, dims: np.ndarray, *, factors: int = FACTORS, epochs: int = 25, rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss. A tenth of the rows is held back to calibrate the sum."""
    rng = np.random.default_rng(seed)
    k, n = len(dims), len(y)
    m = Machine(dims, float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))), np.zeros(k), rng.normal(0, 0.02, (k, factors)))
    x = np.zeros((n, k), np.uint8)
    for i, r in enumerate(rows):
        x[i, r] = 1
    back = np.arange(n) % 10 == 9 if n >= 200 else np.zeros(n, bool)
    at = np.flatnonzero(~back)
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, factors), 1e-8)
    for _ in range(epochs):
        for b in np.array_split(rng.permutation(at), max(1, len(at) // 128)):
            xb = x[b].astype(np.float64)
            xv = xb @ m.v
            s = m.w0 + xb @ m.w + 0.5 * (xv**2 - xb @ m.v**2).sum(1)
            e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[b]) / len(b)
            d0, dw = e.sum(), xb.T @ e + l2 * m.w
            dv = xb.T @ (e[:, None] * xv) - (xb.T @ e)[:, None] * m.v + l2 * m.v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            m.w0 -= rate * d0 / np.sqrt(g0)
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
    if 0 < y[back].sum() < back.sum():
        s = np.array([m.raw(np.zeros(len(r), np.int64), r, 1)[0] for r in (rows[i] for i in np.flatnonzero(back))])
        m.slope, m.shift = platt(s, y[back], balance=0.5)
    return m


def interacting(rows: list[np.ndarray], y: np.ndarray, known: np.ndarray, evidence: float) -> np.ndarray:
    """Which terms are in a pair that tells more than its terms do. rows: terms of each row; known: terms that are in the
    model anyway, whose pairs with each other needn't be tested."""
    n, rare = len(known), y == (1 if y.mean() <= 0.5 else 0)
    share, both, hit = rare.mean(), np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)  # rows with both terms, those of them with the rarer label
    for start in range(0, len(rows), 1024):
        x = np.zeros((min(1024, len(rows) - start), n), np.float32)
        for i, r in enumerate(rows[start : start + 1024]):
            x[i, r] = 1
        both += x.T @ x
        x = x[rare[start : start + 1024]]
        hit += x.T @ x
    alone = np.diag(hit) / np.maximum(np.diag(both), 1) - share
    out = np.zeros(n, bool)
    for a in np.flatnonzero(~known):
        more, added = hit[a] - both[a] * share, alone[a] + alone
        low, high = (f.reduce([np.zeros(n), np.full(n, alone[a]), alone, added]) for f in (np.minimum, np.maximum))
        room = both[a] * share * (1 - share)
        beyond = np.abs(more - np.clip(more, both[a] * low, both[a] * high)) / np.sqrt(np.maximum(room, 1e-9))
        pair = (room >= 2) & (beyond > evidence)
        pair[a] = False
        out |= pair
        out[a] |= pair.any()
    return out


def platt(s: np.ndarray, y: np.ndarray, balance: float = 0.0) -> tuple[float, float]:
    """Slope and shift of a logistic curve through raw sums, with smoothed targets; Newton steps. balance: the power of the
    ratio of the labels' counts by which the rarer label weighs more (0: as counted, 1: both alike)."""
    p, n = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    u = np.where(y == 1, (n / max(p, 1)) ** balance, 1.0)
    a = np.array([1.0, 0.0])
    x = np.stack([s, np.ones(len(s))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (u * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (u * (q - t)) + 1e-3 * (a - [1.0, 0.0]))
        a = a - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text divides by five. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, n_terms: int = N_TERMS, n_frequent: int = N_FREQUENT, evidence: float = EVIDENCE) -> Machine:
    """The machine of the labelled rows that aren't held out. n_terms + n_frequent is below 32,768."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__ctx_y"))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(max_train)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, off in K.blocks(batch.column(1)):
                row, dim = terms(data, off)
                ptr = np.searchsorted(row, np.arange(stop - start + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(ptr), pa.array(dim.astype(np.int32)))], names=["y", "dims"])

    rows = cut(docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select("__ctx_y", text_col).mapInArrow(features, "y int, dims array<int>"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, DIMS), np.int64)
        for batch in batches:
            y, d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            n = np.diff(d.offsets.to_numpy())
            v = d.flatten().to_numpy()
            for k in (0, 1):
                c[k] += np.bincount(v[np.repeat(y, n) == k], minlength=DIMS)
        d = np.flatnonzero(c.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(c[0, d]), pa.array(c[1, d])], names=["dim", "n0", "n1"])

    all0, all1 = rows.agg(F.coalesce(F.sum(1 - F.col("y")), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not all0 or not all1:
        share = all1 / max(1, all0 + all1)
        return Machine(np.zeros(0, np.int64), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    share = (F.col("n0") + F.col("n1")) / F.lit(all0 + all1)
    spread = share * (F.lit(1.0) - share)
    z = F.abs(F.col("n1") / F.lit(all1) - F.col("n0") / F.lit(all0)) / F.sqrt(spread + F.lit(1e-9))
    seen = cut(rows.mapInArrow(counts, "dim int, n0 long, n1 long").groupBy("dim").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= 3))
    alone, often = (np.array([r[0] for r in seen.orderBy(by.desc(), "dim").limit(n).select("dim").collect()], np.int64) for by, n in ((z, n_terms), (spread, n_frequent)))
    dims = np.union1d(alone, often)
    table = np.full(DIMS, -1, np.int32)
    table[dims] = np.arange(len(dims))
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(1)
            t = sent.value[d.flatten().to_numpy()]
            row = np.repeat(np.arange(len(d)), np.diff(d.offsets.to_numpy()))[t >= 0]
            ptr = 2 * np.searchsorted(row, np.arange(len(d) + 1)).astype(np.int32)
            small = pa.py_buffer(t[t >= 0].astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(ptr.tobytes()), small])], names=["y", "t"])

    got = sorted((r.t, r.y) for r in rows.mapInArrow(project, "y int, t binary").collect())
    x, y = [np.frombuffer(t, np.int16) for t, _ in got], np.array([y for _, y in got], np.float64)
    known = np.isin(dims, alone)
    keep = known | interacting(x, y, known, evidence)
    place = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
    return fit([place[t][keep[t]] for t in x], y, dims[keep])


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1, higher where toxic is likelier."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(machine)
    docs = docs.drop(name)
    place, schema = docs.columns.index(text_col), docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = m.table()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for start, stop, data, off in K.blocks(batch.column(place)):
                row, dim = terms(data, off)
                t = table[dim]
                out[start:stop] = m.score(m.raw(row[t >= 0], t[t >= 0], stop - start))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every document."""
    m = train(docs, labels, id_col=id_col, text_col=text_col, **more)
    return score(docs.select(id_col, text_col), m, text_col=text_col).select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **more) -> DataFrame:
    """The documents that aren't predicted toxic, all their columns as they were."""
    m = train(docs, labels, text_col=text_col, **more)
    return score(docs, m, text_col=text_col, name="__ctx_score").where(F.col("__ctx_score") < 0.5).select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
