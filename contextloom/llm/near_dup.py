"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH-Lite; Satuluri and Parthasarathy 2012).

1. One pass over the texts: each document's set of five-word shingles gives a 128-bit class key (documents with the same
   set form a class, whose representative is its smallest doc_id) and band hashes of its MinHash values.
2. Representatives that share a band are candidates. Each band bucket becomes a star around its smallest member, and
   connected components of the stars bring candidates together: never all pairs of a bucket.
3. A component goes to one task. There MinHash values are compared `step` at a time; a pair whose posterior chance of
   reaching the threshold falls below `tolerance` is dropped, the others are verified exactly on the shingle sets. The task
   returns per representative its number of links and one edge of a spanning forest, so its output is linear in its input.
4. A component of more than a block's rows or bytes may be a chain of unlike texts. Its members are banded again, by longer
   bands, which unlike texts hardly ever share, and the components of these take its place.
5. What is still larger is a dense group. Each member is compared with the group's least id. Members whose distance from it
   is at most half of the distance that a link allows are all linked with each other, by the triangle inequality of the
   Jaccard distance: this core is counted, not compared. Only pairs with a member outside the core are compared, in cells
   of two blocks. Work and traffic grow linearly with the core, and with the square only of the members outside it.
6. Components of the verified edges are the groups of near copies.

The bands are chosen so that a pair at the threshold is missed with a chance of at most `miss`.

A class of a third of all rows is one row after step 1 (min and count, aggregated before the shuffle). The rows of such a
class are given their representative by a broadcast of the classes that hold at least a thousandth of all rows: a thousand
entries at most. Large components get their sizes in the same way. Blocks of texts and partitions of cells are of bounded
rows and bytes, counted before they are dealt.

Defined results: texts of fewer than five words, but not none, have one shingle of all their words. Null counts as empty;
texts without words are of one class only if their bytes are equal, and have no links. Rows without an id keep a null class. Rows
that repeat a doc_id are all returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm import textkernel as K
from contextloom.llm.graph import components
from contextloom.runtime import cut, ship

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-6
TOLERANCE = 1e-7
BAND_ROWS = 6
#: MinHash values in a band of the second banding, for members of large components.
LONG_BAND_ROWS = 12
STEP = 32
#: Rows and bytes of one block of a large component; bytes of text in one partition of cells.
BLOCK_ROWS = 512
BLOCK_BYTES = 8 << 20
CELL_BYTES = 64 << 20
_U = np.uint64


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows))) if threshold < 1 else 1


@lru_cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def signature(unique: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of a set of 64-bit hashes."""
    a = _multipliers(n)
    best = np.full(n, np.iinfo(np.uint64).max, _U)
    wide = max(64, 300_000 // n)
    for i in range(0, len(unique), wide):
        np.minimum(best, np.multiply.outer(unique[i : i + wide], a).min(0), out=best)
    return (K.mix(best) >> _U(32)).astype(np.uint32)


def document_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    h, doc = K.shingles(K.words(data, off), SHINGLE)
    ptr = np.searchsorted(doc, np.arange(len(off)))
    return [np.unique(h[ptr[i] : ptr[i + 1]]) for i in range(len(off) - 1)]


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values among n with which a pair may still reach the threshold: posterior of a uniform prior."""
    grid = (np.arange(4000) + 0.5) / 4000
    for m in range(n + 1):
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(log - log.max())
        if p[grid >= threshold].sum() / p.sum() >= tolerance:
            return m
    return n


def class_keys(sets: list[np.ndarray], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128 bits for each text: of its shingle set, or of its bytes where it has no words."""
    key = np.zeros((len(sets), 2), _U)
    for i, s in enumerate(sets):
        if len(s):
            key[i] = K.mix(s + _U(1)).sum(dtype=_U) ^ _U(len(s)), K.mix(s ^ _U(0x5BD1E995A5A5A5A5)).sum(dtype=_U)
        else:
            raw = data[off[i] : off[i + 1]].astype(_U)
            key[i] = K.mix((raw + _U(1)) * K.mix(np.arange(len(raw)).astype(_U) + _U(3))).sum(dtype=_U), _U(2**64 - 1 - len(raw))
    return key


def _sketch(docs: DataFrame, id_col: str, text_col: str, n_bands: int, rows: int = BAND_ROWS) -> DataFrame:
    """id, c1, c2 (class key), bands (none for texts without words)."""
    n_hash = n_bands * rows
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _multipliers(n_hash + n_bands)
        for batch in batches:
            for start, stop, data, off in K.blocks(batch.column(1)):
                sets = document_sets(data, off)
                key = class_keys(sets, data, off)
                sig = np.stack([signature(s, n_hash) for s in sets])
                full = np.array([len(s) > 0 for s in sets], bool)
                band = K.mix((sig.reshape(-1, n_bands, rows).astype(_U) * lanes[:n_hash].reshape(n_bands, rows)).sum(2, dtype=_U) + lanes[n_hash:])
                ptr = np.concatenate([[0], np.cumsum(full * n_bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ptr), pa.array(band[full].ravel().view(np.int64)))],
                    names=["id", "c1", "c2", "bands"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, c1 long, c2 long, bands array<long>")


class Cell:
    """The candidates of one component, or of two blocks of one (left and right; within: equal blocks)."""

    def __init__(self, ids: np.ndarray, side: np.ndarray, texts: pa.Array, threshold: float, tolerance: float, n_hash: int, within: bool):
        self.ids, self.side, self.t, self.tol, self.n_hash, self.within = ids, side, threshold, tolerance, n_hash, within
        self.sets: list[np.ndarray] = []
        for _, _, data, off in K.blocks(texts):
            self.sets += document_sets(data, off)
        self.size = np.array([len(s) for s in self.sets], np.int64)

    def survivors(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the comparison of MinHash values doesn't drop."""
        sig = np.stack([signature(s, self.n_hash) for s in self.sets])
        two = not self.within
        left, right = (np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)) if two else (np.arange(len(sig)), np.arange(len(sig)))
        a, b = [], []
        head = np.ascontiguousarray(sig[:, : STEP])
        for k, i in enumerate(left):
            j = right if two else right[k + 1 :]
            lo, hi = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
            j = j[lo >= self.t * hi - 1e-9]
            if not len(j):
                continue
            same = (head[j] == head[i]).sum(1)
            ok = same >= least_matches(STEP, self.t, self.tol)
            j, same = j[ok], same[ok]
            for n in range(STEP, self.n_hash - STEP + 1, STEP):
                if not len(j):
                    break
                same = same + (sig[j, n : n + STEP] == sig[i, n : n + STEP]).sum(1)
                ok = same >= least_matches(n + STEP, self.t, self.tol)
                j, same = j[ok], same[ok]
            a.append(np.full(len(j), i))
            b.append(j)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.survivors()
        if not len(a):
            return a, b
        common = self.counted(a, b) if len(a) > 4 * len(self.sets) else np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
        ok = common >= self.t * (self.size[a] + self.size[b] - common) - 1e-9
        return a[ok], b[ok]

    def counted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of many pairs: products of 0/1 matrices, a range of shingles at a time. A shingle of
        one set only is in no intersection."""
        flat = np.concatenate(self.sets)
        row = np.repeat(np.arange(len(self.sets)), self.size)
        u, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n > 1
        col = (np.cumsum(shared) - 1)[inv]
        row, col = row[shared[inv]], col[shared[inv]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        rows_a, ia = np.unique(a, return_inverse=True)
        rows_b, ib = np.unique(b, return_inverse=True)
        out = np.zeros((len(rows_a), len(rows_b)), np.float32)
        wide = 1024
        for c in range(0, int(shared.sum()), wide):
            lo, hi = np.searchsorted(col, [c, c + wide])
            x = np.zeros((len(self.sets), wide), np.float32)
            x[row[lo:hi], col[lo:hi] - c] = 1
            out += x[rows_a] @ x[rows_b].T
        return np.rint(out[ia, ib]).astype(np.int64)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Per member its number of links here and the least id of its tree."""
        a, b = self.links()
        n = np.bincount(a, minlength=len(self.ids)) + np.bincount(b, minlength=len(self.ids))
        root = self.ids.copy()
        while len(a):  # least ids spread along the links
            m = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, m)
            np.minimum.at(new, b, m)
            if (new == root).all():
                break
            root = new
        return n, root


def _verify(members: DataFrame, threshold: float, tolerance: float, n_hash: int) -> DataFrame:
    """members: comp, i, j, side, id, text, sorted by cell. Returns id, n, root."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        side, within = t.column("side").to_numpy(), t.column("i")[0] == t.column("j")[0]
        if t.num_rows < 2 or not within and side.min() == side.max():  # of two blocks one is empty: the other has a cell of its own
            return None
        ids = t.column("id").to_numpy()
        n, root = Cell(ids, side, t.column("text").combine_chunks(), threshold, tolerance, n_hash, within).result()
        ok = n > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(n[ok]), pa.array(root[ok])], names=["id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), batch.num_rows]
            for s, e in zip(at[:-1], at[1:], strict=True):
                if s == e:
                    continue
                now = tuple(key[s])
                if last is not None and now != last and held:
                    if (out := flush(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(s, e - s))
                last = now
        if held and (out := flush(held)) is not None:
            yield out

    return members.mapInArrow(run, "id long, n long, root long")


def _stars(banded: DataFrame) -> DataFrame:
    """banded: node, band. Edges (a, b) from the members of each band bucket to its least one."""
    crowded = cut(banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("k")).where("least < most"))
    pairs = crowded.where("k = 2").select(F.col("most").alias("a"), F.col("least").alias("b"))
    rest = banded.join(crowded.where("k > 2").select("band", "least"), "band").where("node != least")
    return pairs.unionByName(rest.select(F.col("node").alias("a"), F.col("least").alias("b")))


def _blocks(texts: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """comp, g: how many blocks of bounded rows and bytes the texts of a component fill."""
    size = texts.groupBy("comp").agg(F.count("*").alias("k"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("k") / block_rows), F.ceil(F.col("bytes") / block_bytes), F.lit(1))
    return cut(size.select("comp", blocks.cast("int").alias("g")))


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with a table of large components (comp, g, ...). Those that hold at least a thousandth of all blocks, a
    thousand at most, are joined by broadcast, so no task gets all rows of one of them."""
    hot = F.greatest(F.lit((groups.agg(F.sum("g")).first()[0] or 0) / 1000), F.lit(2))
    largest = F.broadcast(groups.where(F.col("g") >= hot))
    return rows.join(largest, "comp").unionByName(rows.join(F.broadcast(groups.where(F.col("g") >= hot).select("comp")), "comp", "left_anti").join(groups.where(F.col("g") < hot), "comp"))


def _core(members: DataFrame, threshold: float) -> DataFrame:
    """members: comp, g, id, text of dense groups. id, near: whether the text's distance from that of the group's least id is
    at most half of what a link allows. Members are dealt in blocks, each with a copy of the least one's text."""
    part = F.pmod(F.xxhash64("id"), F.col("g")).cast("int")
    rest = members.where("id != comp").select("comp", part.alias("part"), F.lit(1).alias("place"), "id", "text")
    heads = members.where("id = comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"), F.lit(0).alias("place"), "id", "text")
    least = (1 + threshold) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            place, ids, near = batch.column(2).to_numpy(), batch.column(3), np.zeros(batch.num_rows, bool)
            for start, stop, data, off in K.blocks(batch.column(4)):
                for i, s in enumerate(document_sets(data, off), start):
                    if not place[i]:
                        head, near[i] = s, True
                    else:
                        n = len(np.intersect1d(s, head, assume_unique=True))
                        near[i] = n >= least * (len(s) + len(head) - n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near)], names=["id", "near"])

    dealt = rest.unionByName(heads)
    return dealt.repartition(_parts(dealt), "comp", "part").sortWithinPartitions("comp", "part", "place").mapInArrow(run, "id long, near boolean").distinct()


def _parts(cells: DataFrame) -> int:
    """Partitions for texts that are dealt: of bounded bytes, and no fewer than the session's."""
    size = cells.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // CELL_BYTES)


def _dense(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """members: comp, g, id, text. (cells, found): block pairs to compare, and the links (id, n, root) within the cores."""
    near = cut(_core(members, threshold))
    marked = cut(members.join(near, "id"))
    # Blocks of the members outside the core come first, and there are h of them; a cell has one of them.
    outside = F.avg((~F.col("near")).cast("int")) * F.first("g")
    groups = cut(marked.groupBy("comp").agg(F.first("g").alias("g"), F.sum(F.col("near").cast("long")).alias("n"), F.ceil(outside).cast("int").alias("h")))
    found = _with_group(marked.where("near").select("id", "comp"), groups).where("n > 1").select("id", (F.col("n") - 1).alias("n"), F.col("comp").alias("root"))
    b = F.pmod(F.xxhash64("id"), F.when(F.col("near"), F.col("g")).otherwise(F.col("h"))).cast("int") + F.when(F.col("near"), F.col("h")).otherwise(0)
    meets = F.when(F.col("near"), F.col("h") - 1).otherwise(F.col("h") + F.col("g") - 1)
    dealt = _with_group(marked.drop("g"), groups.drop("n")).where("h > 0").withColumn("b", b).withColumn("x", F.explode(F.sequence(F.lit(0), meets)))
    cells = dealt.select("comp", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), (F.col("b") > F.col("x")).cast("int").alias("side"), "id", "text")
    return cells, found


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, class_id (smallest id with the same shingle set), class_size, n_links (classes whose
    similarity with its own reaches the threshold), group_id (smallest id connected through links), and the internal key
    c1, c2 of its class. Ids are integers."""
    ship(docs.sparkSession)
    n_bands = bands_for(threshold, BAND_ROWS, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(_sketch(docs, "id", "text", n_bands))
    classes = cut(sketch.where(F.col("id").isNotNull()).groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands")))
    # The same id may repeat with different texts: then the class key stands in for it.
    shared = classes.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() > 0
    node = F.xxhash64("c1", "c2") if shared else F.col("rep")
    classes = classes.withColumn("node", node)
    banded = classes.select("node", F.explode("bands").alias("band"))
    comp = components(_stars(banded))
    again = shared or sketch.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 and id is not null").limit(1).count() > 0
    who = comp.join(classes.select("node", F.col("rep").alias("id"), "c1", "c2"), "node")
    if again:  # an id doesn't name a text: take the class key of each row too
        texts = with_key(docs).join(who, ["id", "c1", "c2"]).dropDuplicates(["node"])
    else:
        texts = docs.join(who.drop("c1", "c2"), "id")
    texts = cut(texts.select(F.col("node").alias("id"), F.col("root").alias("comp"), "text"))
    single = lambda t: t.select("comp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "id", "text")
    size = _blocks(texts, block_rows, block_bytes)
    cells, sure = single(texts), None
    if size.where("g > 1").limit(1).count():
        sized = cut(_with_group(texts, size))
        cells, large = single(sized.where("g = 1")), sized.where("g > 1").drop("comp", "g")
        again = _sketch(large, "id", "text", bands_for(threshold, LONG_BAND_ROWS, miss), LONG_BAND_ROWS)
        parts = components(_stars(cut(again.select(F.col("id").alias("node"), F.explode("bands").alias("band")))))
        large = cut(large.join(parts.select(F.col("node").alias("id"), F.col("root").alias("comp")), "id"))
        large = cut(_with_group(large, _blocks(large, block_rows, block_bytes)))
        pairs, sure = _dense(large.where("g > 1"), threshold)
        cells = cells.unionByName(single(large.where("g = 1")))
        cells = cells.unionByName(pairs)
    cells = cells.select("comp", "i", "j", "side", "id", "text").repartition(_parts(cells), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = _verify(cells, threshold, tolerance, n_bands * BAND_ROWS)
    found = cut(found if sure is None else found.unionByName(sure))
    groups = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    count = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n_links"))
    full = classes.select("node", "rep", "size", "c1", "c2").join(count, "node", "left").join(groups, "node", "left")
    if shared:
        least = full.where("root is not null").groupBy("root").agg(F.min(F.struct("rep", "node")).alias("least"))
        full = full.join(least, "root", "left").withColumns({"root": F.col("least.rep"), "first": F.col("least.node")})
    else:
        full = full.withColumn("first", F.col("root"))
    full = full.withColumn("stays", F.coalesce(F.col("first") == F.col("node"), F.lit(True)))
    full = cut(full.select("c1", "c2", F.col("rep").alias("class_id"), F.col("size").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("group_id"), "stays"))
    ids = sketch.select("id", "c1", "c2")
    hot = full.where(F.col("class_size") >= F.greatest(F.lit(ids.count() / 1000), F.lit(2)))  # a thousand classes at most
    mark = F.broadcast(hot.select("c1", "c2").withColumn("hot", F.lit(True)))
    marked = ids.join(mark, ["c1", "c2"], "left")
    known = F.col("id").isNotNull()
    fast = marked.where(F.col("hot") & known).drop("hot").join(F.broadcast(hot), ["c1", "c2"])
    slow = marked.where(F.col("hot").isNull() & known).drop("hot").join(full, ["c1", "c2"])
    lone = ids.where(~known).select("c1", "c2", "id", *(F.lit(None).cast("long").alias(c) for c in ("class_id", "class_size", "n_links", "group_id")), F.lit(True).alias("stays"))
    stays = F.coalesce(F.col("stays") & (F.col("id") == F.col("class_id")), F.lit(True))
    return fast.unionByName(slow).unionByName(lone).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", "group_id", stays.alias("stays"), "c1", "c2")


def with_key(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the class key (c1, c2) of their text, in place of columns of these names."""
    docs = docs.drop("c1", "c2")
    schema = docs.select("*", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2")).schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros((batch.num_rows, 2), _U)
            for start, stop, data, off in K.blocks(batch.column(place)):
                key[start:stop] = class_keys(document_sets(data, off), data, off)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The documents, all their columns, of which one of each group of near copies stays: the one whose id is its
    group_id. Rows without an id stay. Of rows equal in id and words one stays."""
    found = cut(join(docs, id_col=id_col, text_col=text_col, **more))
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("k")).where("k > 1").limit(1).count() > 0
    if not again:
        return docs.join(found.where(~F.col("stays")).select(id_col), id_col, "left_anti").select(*docs.columns)
    none = docs.where(F.col(id_col).isNull())
    left = found.where("stays").select(F.col(id_col).alias("__ctx_id"), F.col("c1").alias("__ctx_1"), F.col("c2").alias("__ctx_2")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("__ctx_id"), F.col(text_col).cast("string").alias("text"))
    kept = with_key(keyed.where("__ctx_id is not null")).withColumnsRenamed({"c1": "__ctx_1", "c2": "__ctx_2"}).dropDuplicates(["__ctx_id", "__ctx_1", "__ctx_2"])
    return kept.join(left, ["__ctx_id", "__ctx_1", "__ctx_2"], "left_semi").select("row.*").unionByName(none)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("c1", "c2")


#: The same rows by comparing all representatives that share a shingle. Ids must differ, as those of the table do.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
k AS (SELECT doc_id, 'shingles ' || sha256(string_agg(g, chr(10) ORDER BY g)) AS key FROM sh GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER same AS class_id, count(*) OVER same AS class_size FROM w LEFT JOIN k USING (doc_id) WINDOW same AS (PARTITION BY coalesce(key, 'bytes ' || t))),
rep AS (SELECT doc_id AS id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM sh JOIN c USING (doc_id) WHERE doc_id = class_id),
link AS (SELECT x.id AS a, y.id AS b FROM rep x JOIN rep y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
reach(id, least) AS (SELECT DISTINCT a, a FROM link UNION SELECT link.b, reach.least FROM reach JOIN link ON link.a = reach.id WHERE reach.least < link.b),
grp AS (SELECT id, min(least) AS least FROM reach GROUP BY id),
cnt AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, CAST(class_size AS BIGINT) AS class_size, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links, coalesce(grp.least, class_id) AS group_id,
       doc_id = coalesce(grp.least, class_id) AS stays
FROM c LEFT JOIN cnt ON cnt.id = class_id LEFT JOIN grp ON grp.id = class_id
"""
