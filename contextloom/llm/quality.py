"""Quality: co-training of two views (Blum and Mitchell 1998).

The content view sees the words: hashed terms, lengths, repetition. The metadata view sees the page: language, source,
length, layout and the shares of kinds of characters. Each view has a logistic model, fitted first on labelled rows. In each
round one pass over the whole table lets each view label all rows that it is sure of, and these labels are what the other
view learns from in that round: the tasks add up the gradients of its loss on them, by label, and it takes a step on the
mean loss of its labelled rows and `weight` times that of the rows given to it, labels weighing as among the labelled rows. Both views are calibrated on labelled rows kept back for it, and a last logistic curve through
the sum of their calibrated log odds gives the score of every document, in one pass without a shuffle.

The labelled rows are at most `max_labelled`, those with the least hash of the id: a bound on the driver's memory. All other
rows take part in the rounds, however many; only sums over them reach the driver. Rows whose crc32 of the id divides by five are
never learnt from.

Null and empty texts have no words: their features are zeros. Null lang and source are values of their own. Without rows
of both labels every score is the share of good labels (0.5 without labels). Of several labels of a document the largest
counts. Rows that repeat get equal scores. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm import textkernel as K
from contextloom.llm.toxicity import held_out, platt
from contextloom.runtime import cut, ship

MAX_LABELLED = 6_000
ROUNDS = 3
SURE = 0.95
WEIGHT = 0.2
L2 = 1e-2
_TERMS = 512
_LANG, _SOURCE = 16, 32
_U = np.uint64


def _share(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return (c[off[1:]] - c[off[:-1]]) / np.maximum(off[1:] - off[:-1], 1)


def content(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    w = K.words(data, off)
    rows = len(off) - 1
    n = np.maximum(K.word_count(w), 1)
    cell = w.doc * _TERMS + (w.hash >> _U(33)).astype(np.int64) % _TERMS
    bag = np.bincount(cell, minlength=rows * _TERMS).reshape(rows, _TERMS) / n[:, None]
    first = np.unique(w.hash ^ K.mix(w.doc.astype(_U) + _U(1)), return_index=True)[1]  # one of each word of each text
    kinds = np.bincount(w.doc[first], minlength=rows) / n
    again = np.zeros(len(w.hash), bool)
    if len(again) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    size = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, size, rows) / n
    spread = np.sqrt(np.maximum(np.bincount(w.doc, size**2, rows) / n - mean**2, 0))
    return np.concatenate([bag * 10, np.stack([np.log1p(K.word_count(w)), kinds, np.bincount(w.doc, again, rows) / n, mean / 5, spread / 5], 1)], 1)


def metadata(data: np.ndarray, off: np.ndarray, lang: list, source: list) -> np.ndarray:
    rows = len(off) - 1
    hot = np.zeros((rows, _LANG + _SOURCE))
    for i, (a, b) in enumerate(zip(lang, source, strict=True)):
        hot[i, zlib.crc32(str(a).encode()) % _LANG] = 1
        hot[i, _LANG + zlib.crc32(str(b).encode()) % _SOURCE] = 1
    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    marks = (data < 128) & ~upper & ~lower & ~digit & (data > 32)
    same = np.zeros(len(data), bool)
    if len(data) > 1:
        same[1:] = marks[1:] & (data[1:] == data[:-1])
    parts = [np.log1p(np.diff(off)), *(10 * _share(m, off) for m in (upper, digit, marks, same, data == 10, data == 33, data == 124, data >= 128, data == 32))]
    return np.concatenate([hot, np.stack(parts, 1)], 1)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


    def rows(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and a one."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def gradient(self, z: np.ndarray, y: np.ndarray | float) -> np.ndarray:
        """Sum over rows of the gradient of the loss."""
        return z.T @ (1 / (1 + np.exp(-np.clip(z[:, :-1] @ self.w + self.b, -30, 30))) - y)

    def stepped(self, x: np.ndarray, y: np.ndarray, given: np.ndarray, weight: float) -> Logistic:
        """After a step on the labelled rows and `given`, the weighted mean gradient on other rows, with the largest curvature
        that the loss can have on such rows: the loss falls however sure the model is."""
        z = self.rows(x)
        p = 1 / (1 + np.exp(-np.clip(z[:, :-1] @ self.w + self.b, -30, 30)))
        curve = (1 + weight) / 4 * (z.T @ z) / len(z) + np.diag(np.append(np.full(len(self.w), L2), 1e-6))
        step = np.linalg.solve(curve, z.T @ (p - y) / len(z) + given + np.append(L2 * self.w, 0))
        return Logistic(self.mean, self.scale, self.w - step[:-1], self.b - float(step[-1]))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 300) -> Logistic:
    """Accelerated gradient steps on standardised features."""
    m = Logistic(x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1]), 0.0)
    z = m.rows(x)
    top = np.ones(z.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        top = z.T @ (z @ (top / np.linalg.norm(top)))
    step = 3.6 / (np.linalg.norm(top) / len(z) + 4 * l2)
    w = v = np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y) / len(y) + l2 * np.append(v[:-1], 0)
        new = v - step * g
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    m.w, m.b = w[:-1], float(w[-1])
    return m


@dataclass
class Views:
    content: Logistic | None
    meta: Logistic | None
    slope: float
    shift: float

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        curve = lambda s: 1 / (1 + np.exp(-s))
        if self.content is None:
            flat = np.full(len(a), curve(self.shift))
            return flat, flat, flat
        p, q = self.content.odds(a), self.meta.odds(b)
        return curve(p), curve(q), curve(np.clip(self.slope * (p + q) + self.shift, -30, 30))


def sums(models: list[Logistic], x: tuple[np.ndarray, np.ndarray], sure: float) -> list[tuple[np.ndarray, int]]:
    """What rows without labels give in a round: for each view and label, the gradients' sum over the rows to which the other
    view is sure to give that label, and their number."""
    out = []
    for j in (0, 1):
        p = 1 / (1 + np.exp(-models[1 - j].odds(x[1 - j])))
        for label, conf in ((0.0, 1 - p), (1.0, p)):
            pick = conf >= sure
            out.append((models[j].gradient(models[j].rows(x[j][pick]), label), int(pick.sum())))
    return out


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, gather: Callable[[list[Logistic]], list[tuple[np.ndarray, int]]], rounds: int = ROUNDS, weight: float = WEIGHT) -> Views:
    """x: the two views of labelled rows; gather: sums() over all other rows. A quarter of the labelled rows is kept back to
    calibrate."""
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Views(None, None, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    back = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[back])) < 2 or len(np.unique(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    held = back if back.any() else ~back
    models, share = [logistic(v[~back], y[~back]) for v in x], y[~back].mean()
    for k in range(rounds + 1):
        for m, v in zip(models, x, strict=True):
            m.slope, m.shift = platt(m.raw(v[held]), y[held])
        if k == rounds:
            break
        got = gather(models)
        given = [sum((weight * part * g / n for part, (g, n) in zip((1 - share, share), got[2 * j : 2 * j + 2], strict=True) if n), np.zeros(len(models[j].w) + 1)) for j in (0, 1)]
        models = [m.stepped(v[~back], y[~back], g, weight) for m, v, g in zip(models, x, given, strict=True)]
    both = models[0].odds(x[0][held]) + models[1].odds(x[1][held])
    return Views(*models, *platt(both, y[held]))


_WIDE = _TERMS + 5
_META = _LANG + _SOURCE + 10


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """batch: any, text, lang, source, ..."""
    lang, source = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for start, stop, data, off in K.blocks(batch.column(1)):
        yield start, stop, content(data, off), metadata(data, off, lang[start:stop], source[start:stop])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, sure: float = SURE, weight: float = WEIGHT) -> Views:
    spark = ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = cut(known.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    rows = _named(docs, id_col, text_col, lang_col, source_col)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, a, b in _features(batch):
                x = [np.concatenate([p, q]).astype(np.float32).tobytes() for p, q in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(x, pa.binary())], names=["y", "x"])

    got = rows.join(F.broadcast(picked), "id").select("y", "text", "lang", "source").mapInArrow(labelled, "y int, x binary").collect()
    got.sort(key=lambda r: (r.y, zlib.crc32(r.x), r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(len(got), _WIDE + _META)
    mix = np.random.default_rng(3).permutation(len(got))
    x, y = x[mix], np.array([r.y for r in got], float)[mix]
    free = rows.where(~held_out("id")).join(F.broadcast(picked.select("id")), "id", "left_anti")

    def gather(models: list[Logistic]) -> list[tuple[np.ndarray, int]]:
        sent = spark.sparkContext.broadcast(models)
        size = [len(m.w) + 2 for m in models for _ in (0, 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(size))
            for batch in batches:
                for _, _, a, b in _features(batch):
                    total += np.concatenate([np.append(g, n) for g, n in sums(sent.value, (a, b), sure)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        flat = np.zeros(sum(size))
        for r in free.select("id", "text", "lang", "source").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r.i] = r.v
        return [(part[:-1], int(round(part[-1]))) for part in np.split(flat, np.cumsum(size)[:-1])]

    return co_train((x[:, :_WIDE], x[:, _WIDE:]), y, gather, rounds, weight)


def score(docs: DataFrame, views: Views, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, score_content, score_metadata, score."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(views)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows))
            for start, stop, a, b in _features(batch):
                out[:, start:stop] = sent.value.score(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o) for o in out)], names=["id", "score_content", "score_metadata", "score"])

    return _named(docs, id_col, text_col, lang_col, source_col).mapInArrow(run, f"id {kind}, score_content double, score_metadata double, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **more) -> DataFrame:
    """id, held_out, the scores of both views and together, predicted (1: good) of every document."""
    columns = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    found = score(docs, train(docs, labels, **columns, **more), **columns)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score_content", "score_metadata", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
