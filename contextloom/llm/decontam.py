"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task cuts its documents into shards of a few MB and sorts the shard's suffixes (word sequences, each to the end of its
text or to the first word that no test item has). Every test suffix is binary-searched in that array; the two neighbours
of the place found hold its longest verbatim match, at whatever length, and say where it lies. What the operators give
follows from these matches: a window occurs if the longest match of a test suffix that it begins covers it, and its
occurrences are the interval of the array around the place found. A suffix can only begin an occurrence if its first three
words (fewer for very short items) begin some window, so the other suffixes are left out of the array, and test suffixes
whose first three words begin none of the shard's are not searched in it: filters without loss from three words on.

The documents are read once and not shuffled. The test items are sent out in groups of at most `block_words` words, one
pass over the rows for each group, so what a task holds is bounded whatever the size of the benchmark.

Nulls and texts without words have no words, no windows and no hits. Rows that repeat are reported each for itself.
Items without an id count for hits, not for the list of items. Other columns of the documents pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm import textkernel as K
from contextloom.runtime import ship

WINDOW = 10
#: Words of test items in one pass, bytes of text in one shard, bytes of the keys that a step of sorting holds.
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 2 << 20
SORT_BYTES = 32 << 20
_LEAD = 3
_HITS, _ITEMS, _WORDS = "__ctx_hits", "__ctx_items", "__ctx_words"


class Items:
    """A group of test items: vocabulary, suffixes, windows, and which items a window belongs to."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        w = K.words(*K.utf8(pa.array([t for _, t in rows], pa.string())))
        self.names = sorted({i for i, _ in rows if i is not None})
        at = {x: k for k, x in enumerate(self.names)}
        self.item = np.array([at.get(i, -1) for i, _ in rows], np.int64)[w.doc] if len(w.doc) else np.zeros(0, np.int64)
        self.vocab = np.unique(w.hash)
        self.rank = (np.searchsorted(self.vocab, w.hash) + 1).astype(np.uint32)
        self.stop = w.ptr[1:][w.doc] if len(w.doc) else np.zeros(0, np.int64)
        first = w.ptr[:-1][w.doc] if len(w.doc) else np.zeros(0, np.int64)
        at_ = np.arange(len(self.rank))
        self.row, self.pos = w.doc, at_ - first
        starts = np.flatnonzero((at_ + window <= self.stop) | (at_ == first))
        length = np.minimum(self.stop[starts] - starts, window)
        flat = keys(self.rank, starts, starts + length, window)
        self.win, first_of, inv = np.unique(flat, return_index=True, return_inverse=True)
        self.win_at = starts[first_of]  # a test suffix that begins with the window
        self.win_len = np.zeros(len(self.win), np.int64)
        self.win_len[inv] = length
        pairs = np.unique(np.stack([inv, self.item[starts]], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 1] >= 0]
        self.win_ptr, self.win_item = np.searchsorted(pairs[:, 0], np.arange(len(self.win) + 1)), pairs[:, 1]
        lead = np.minimum(length, _LEAD)
        self.leads = {k: np.unique(grams(self.rank, starts[lead == k], k)) for k in range(1, _LEAD + 1) if (lead == k).any()}
        self.lo, self.hi = padded(self.win, self.win_len, window)
        rest = self.stop - at_
        self.tails = np.flatnonzero(rest < _LEAD)
        self.long = np.flatnonzero(rest >= _LEAD)
        self.gram = grams(self.rank, self.long, _LEAD)


def keys(rank: np.ndarray, at: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes as byte strings whose order is that of the word sequences: big-endian ranks, zeros past the end."""
    out = np.zeros((len(at), depth), ">u4")
    for j in range(depth):
        inside = at + j < stop
        out[inside, j] = rank[at[inside] + j]
    return out.view(f"S{4 * depth}").ravel()


def padded(win: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest key of `window` words that begins with each window."""
    raw = np.zeros((len(win), 4 * window), np.uint8) if not len(win) else np.frombuffer(win.tobytes(), np.uint8).reshape(len(win), 4 * window)
    inside = np.arange(4 * window)[None, :] < 4 * length[:, None]
    return tuple(np.where(inside, raw, np.uint8(fill)).view(f"S{4 * window}").ravel() for fill in (0, 255))


def suffix_order(rank: np.ndarray, at: np.ndarray, stop: np.ndarray, width: int = 16, room: int = SORT_BYTES) -> np.ndarray:
    """The order of the suffixes that begin at `at` and end before `stop`, by all their words; equal ones by place.

    Sorted by their first words, then those that agree by the next, and so on until all differ or have ended; steps grow
    as long as their keys fit in `room` bytes."""
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)  # group: the first slot of those that agree so far
    slots, depth = np.arange(len(at)), 0
    while len(slots):
        width = max(1, min(width, room // (4 * len(slots))))
        who = order[slots]
        _, key = np.unique(keys(rank, at[who] + depth, stop[who], width), return_inverse=True)
        by = np.lexsort((key, group[slots]))
        order[slots], key = who[by], key[by]
        new = np.ones(len(slots), bool)
        new[1:] = (group[slots][1:] != group[slots][:-1]) | (key[1:] != key[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(slots)))
        group[slots] = np.repeat(slots[new], size)
        depth += width
        who = order[slots]
        slots = slots[(np.repeat(size, size) > 1) & (at[who] + depth <= stop[who])]
        width *= 2
    return order


def grams(rank: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k ranks from each place."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = K.mix(acc + rank[at + j].astype(np.uint64) + np.uint64(1))
    return acc


def isin_sorted(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    p = np.searchsorted(of, x)
    return of[np.minimum(p, len(of) - 1)] == x


class Shard:
    """The suffix array of the documents in one block of text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, items: Items):
        self.words = w = K.words(data, off)
        n = len(w.hash)
        rank = np.zeros(n + _LEAD, np.uint32)
        if len(items.vocab) and n:
            p = np.minimum(np.searchsorted(items.vocab, w.hash), len(items.vocab) - 1)
            rank[:n] = np.where(items.vocab[p] == w.hash, p + 1, 0)
        self.rank, stop = rank, w.ptr[1:][w.doc]
        strange = np.append(np.flatnonzero(rank[:n] == 0), n)
        stop = np.minimum(stop, strange[np.searchsorted(strange, np.arange(n))])  # of each suffix
        keep, found = np.zeros(n, bool), np.zeros(0, np.uint64)
        for k, of in items.leads.items():
            at = np.flatnonzero(np.arange(n) + k <= stop)
            g = grams(rank, at, k)
            ok = isin_sorted(g, of)
            keep[at[ok]] = True
            found = np.unique(g[ok]) if k == _LEAD else found
        self.leads = found
        at = np.flatnonzero(keep)
        self.at = at[suffix_order(rank, at, stop[at])]
        self.stop = stop[self.at]

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the length of its longest match here, and a place of it (-1 if none): found by binary search
        of the suffix in the array. Matches of fewer than three words may be missed."""
        t, m = len(items.rank), len(self.at)
        best, place = np.zeros(t, np.int64), np.full(t, -1, np.int64)
        if not m or not t:
            return best, place
        who = np.concatenate([items.tails, items.long[isin_sorted(items.gram, self.leads)] if len(self.leads) else items.long])
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), m)
        left, right = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)  # words shared with the neighbours
        while len(act := np.flatnonzero(lo < hi)):
            mid = (lo[act] + hi[act]) // 2
            k = np.minimum(left[act], right[act])
            a, a_stop, b, b_stop = self.at[mid] + k, self.stop[mid], who[act] + k, items.stop[who[act]]
            live = np.arange(len(act))
            while len(live):
                live = live[(a[live] < a_stop[live]) & (b[live] < b_stop[live])]
                live = live[self.rank[a[live]] == items.rank[b[live]]]
                a[live] += 1
                b[live] += 1
            k = b - who[act]
            ends, more = b == b_stop, a < a_stop
            less = ~ends & ~more
            both = np.flatnonzero(~ends & more)
            less[both] = self.rank[a[both]] < items.rank[b[both]]
            lo[act[less]], left[act[less]] = mid[less] + 1, k[less]
            hi[act[~less]], right[act[~less]] = mid[~less], k[~less]
        best[who] = np.maximum(left, right)
        near = np.where(left >= right, lo - 1, hi)
        ok = best[who] > 0
        place[who[ok]] = self.at[near[ok]]
        return best, place

    def occurrences(self, items: Items, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of the windows that the longest matches of test suffixes cover."""
        win = np.flatnonzero(best[items.win_at] >= items.win_len)
        key = keys(self.rank, self.at, self.stop, items.window) if len(win) else np.zeros(0, f"S{4 * items.window}")
        lo, hi = np.searchsorted(key, items.lo[win], "left"), np.searchsorted(key, items.hi[win], "right")
        n = hi - lo
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return self.at[k], np.repeat(win, n)


def _groups(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in groups whose size is checked: by the hash of the id where they are too many for one."""
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    n = b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] // 2 + 1  # words are at most half of the characters
    parts = max(1, -(-n // (3 * block_words)))
    for k in range(parts):
        rows = [tuple(r) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()]
        yield rows


def _pass(docs: DataFrame, text_col: str, items: Items) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    schema = docs.schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            hits, found, count = cols[_HITS].to_pylist(), cols[_ITEMS].to_pylist(), np.zeros(batch.num_rows, np.int64)
            for start, stop, data, off in K.blocks(batch.column(place), SHARD_BYTES):
                shard = Shard(data, off, items)
                w = shard.words
                count[start:stop] = K.word_count(w)
                at, win = shard.occurrences(items, shard.longest(items)[0])
                if not len(at):
                    continue
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + items.win_len[win], -1)
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                for d in np.unique(w.doc[hit]):
                    mine = hit[np.searchsorted(hit, w.ptr[d]) : np.searchsorted(hit, w.ptr[d + 1])] - w.ptr[d]
                    hits[start + d] = np.union1d(np.array(hits[start + d], np.int64), mine).tolist()
                n = items.win_ptr[win + 1] - items.win_ptr[win]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.win_ptr[win], n)
                for d, i in np.unique(np.stack([np.repeat(w.doc[at], n), items.win_item[k]], 1), axis=0):
                    found[start + d] = sorted({*found[start + d], items.names[i]})
            cols |= {_HITS: pa.array(hits, pa.list_(pa.int32())), _ITEMS: pa.array(found, pa.list_(pa.string())), _WORDS: pa.array(count)}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with __ctx_words (long), __ctx_hits (positions of hit words) and __ctx_items (ids found, as strings)."""
    ship(docs.sparkSession)
    out = docs.withColumns({_WORDS: F.lit(0).cast("long"), _HITS: F.array().cast("array<int>"), _ITEMS: F.array().cast("array<string>")})
    for rows in _groups(benchmark, item_col, item_text_col, block_words):
        out = _pass(out, text_col, Items(rows, window))
    return out


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    found = scan(docs.select(id_col, text_col), benchmark, text_col=text_col, **more)
    hit = F.size(_HITS).cast("long")
    return found.select(
        id_col, F.col(_WORDS).alias("n_words"), hit.alias("n_hit"), F.size(_ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(_ITEMS, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.array_join(_ITEMS, ",").alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **more) -> DataFrame:
    """The documents without a hit, all their columns as they were."""
    return scan(docs, benchmark, text_col=text_col, **more).where(F.size(_HITS) == 0).select(*docs.columns)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every test suffix and shard the longest verbatim match of at least `least` words (three or more), one that no
    longer match of the same shard holds: item_id (string), item_pos, doc_id, doc_pos, length; positions count words."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for rows in _groups(benchmark, item_col, item_text_col, block_words):
        sent = docs.sparkSession.sparkContext.broadcast((Items(rows), [i for i, _ in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, names = sent.value
            for batch in batches:
                for start, _, data, off in K.blocks(batch.column(1), SHARD_BYTES):
                    shard = Shard(data, off, items)
                    n, at = shard.longest(items)
                    inner = np.zeros(len(n), bool)
                    inner[1:] = (n[:-1] == n[1:] + 1) & (at[:-1] + 1 == at[1:]) & (items.row[1:] == items.row[:-1])
                    k = np.flatnonzero((n >= least) & ~inner)
                    d = shard.words.doc[at[k]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[r] for r in items.row[k]], pa.string()), pa.array(items.pos[k]), batch.column(0).take(pa.array(d + start)), pa.array(at[k] - shard.words.ptr[d]), pa.array(n[k])],
                        names=["item_id", "item_pos", "doc_id", "doc_pos", "length"],
                    )

        part = docs.select(id_col, text_col).mapInArrow(run, f"item_id string, item_pos long, doc_id {kind}, doc_pos long, length long")
        out = part if out is None else out.unionByName(part)
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Column names as the contract has them.
OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(ws[p : p + 9], ' ') AS win, least(len(ws), 10) AS k
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
dp AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
occ AS (SELECT dp.doc_id, dp.p, x.k, iw.item_id FROM dp CROSS JOIN (SELECT DISTINCT k FROM iw) x
        JOIN iw ON iw.k = x.k AND iw.win = array_to_string(dp.ws[dp.p : dp.p + x.k - 1], ' ') WHERE dp.p + x.k - 1 <= len(dp.ws)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM occ GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(array_to_string(ids, ','), '') AS item_ids
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
