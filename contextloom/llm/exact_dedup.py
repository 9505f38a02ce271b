"""Exact dedup with a cuckoo-filter index of live digests.

Texts are equal when identical after each run of ASCII white space is one space. Their SHA-256 digests are taken in the
JVM. A cuckoo index (Fan et al. 2014) holds four slots a bucket: a slot's 16-bit fingerprint answers most look-ups, a hit
is verified against the digest stored in the same slot, a full index is doubled and filled again from the stored digests,
and a digest can be deleted. Each task first folds its own rows into an index, so that a group of copies leaves a task as
one row however large it is, and puts it out whenever it is full; the folded rows are dealt by digest to shards whose number
follows the rows, and each shard's index holds its digests for good.

Rows learn their group from the index by a join on the digest. Groups of at least a thousandth of all rows, a thousand at
most, are joined by broadcast, so no task gets a large group.

Null counts as the empty text. Rows without an id are never the smallest; they are kept only if no row of the group has an id.
All rows that repeat the smallest id of a group carry kept; `drop_copies` leaves one row of them. An empty table gives an
empty result. Extra columns are kept by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.runtime import cut, ship

SLOTS = 4
#: Most digests in the index of a task that folds its own rows, and the digests that a shard is laid out for.
FOLD_DIGESTS = 200_000
SHARD_DIGESTS = 500_000
_KICKS = 200
_INDEX = "digest binary, keep_id long, group_size long"


class CuckooIndex:
    """Live digests, each with the smallest id and the number of rows that carry it."""

    def __init__(self, buckets: int = 1 << 10):
        self.n = 1 << max(1, (buckets - 1).bit_length())
        self.live = 0
        self._clear()

    def _clear(self) -> None:
        self.prints: list[list[int]] = [[] for _ in range(self.n)]
        self.content: list[list[list]] = [[] for _ in range(self.n)]  # [digest, keep_id, size], slot by slot as prints

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(digest[:2], "big") or 1
        i = int.from_bytes(digest[2:10], "big") & (self.n - 1)
        return f, i, self._other(i, f)

    def _other(self, i: int, f: int) -> int:
        return i ^ ((f * 0x5BD1E995 >> 7) & (self.n - 1))

    def get(self, digest: bytes) -> list | None:
        f, i, j = self._places(digest)
        for b in (i, j):
            if f in self.prints[b]:
                for entry in self.content[b]:
                    if entry[0] == digest:
                        return entry
        return None

    def __contains__(self, digest: bytes) -> bool:
        return self.get(digest) is not None

    def add(self, digest: bytes, keep_id: int | None, size: int = 1) -> None:
        entry = self.get(digest)
        if entry is not None:
            if keep_id is not None and (entry[1] is None or keep_id < entry[1]):
                entry[1] = keep_id
            entry[2] += size
            return
        self.live += 1
        self._place([digest, keep_id, size])

    def _place(self, entry: list) -> None:
        f, i, j = self._places(entry[0])
        for b in (i, j):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(f)
                self.content[b].append(entry)
                return
        b = j
        for kick in range(_KICKS):
            k = (kick + f) % SLOTS
            self.prints[b][k], f = f, self.prints[b][k]
            self.content[b][k], entry = entry, self.content[b][k]
            b = self._other(b, f)
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(f)
                self.content[b].append(entry)
                return
        held = [*self.entries(), entry]
        self.n *= 2
        self._clear()
        for e in held:
            self._place(e)

    def delete(self, digest: bytes) -> bool:
        f, i, j = self._places(digest)
        for b in (i, j):
            for k, entry in enumerate(self.content[b]):
                if entry[0] == digest:
                    del self.content[b][k], self.prints[b][k]
                    self.live -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for b in self.content:
            yield from b

    def batches(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for e in self.entries():
            out.append(e)
            if len(out) == rows:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(entries: list[list]) -> pa.RecordBatch:
    d, k, n = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["digest", "keep_id", "group_size"])


def _fold(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, group_size) to one row a digest. A size of 0 retires the digest as it was before. An index of
    `most` digests is put out and begun anew, so a digest may have several rows, for a later fold to join."""
    index = CuckooIndex()
    for batch in batches:
        n = batch.column(2).to_numpy()
        for d, k, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), n.tolist(), strict=True):
            if size:
                index.add(d, k, size)
            else:
                index.delete(d)
        if most is not None and index.live >= most:
            yield from index.batches()
            index = CuckooIndex()
    yield from index.batches()


def digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+", " ").cast("binary"), 256))


def _parts(rows: DataFrame) -> int:
    """Shards of a bounded number of digests, whatever the size of the table, and no fewer than the session's partitions."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // SHARD_DIGESTS)


def index(digests: DataFrame) -> DataFrame:
    """digests (id long, digest binary) to the live index: digest, keep_id, group_size."""
    ship(digests.sparkSession)
    rows = digests.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return rows.mapInArrow(lambda it: _fold(it, FOLD_DIGESTS), _INDEX).repartition(_parts(rows), "digest").mapInArrow(_fold, _INDEX)


def update(live: DataFrame, added: DataFrame, retired: DataFrame) -> DataFrame:
    """The index after digests of `retired` (digest) are deleted and rows of `added` (id, digest) inserted, in this order."""
    step = lambda df, k: df.select("digest", "keep_id", "group_size", F.lit(k).alias("step"))
    gone = retired.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
    rows = step(live, 0).unionByName(step(gone, 1)).unionByName(step(index(added), 2))
    return rows.repartition(_parts(rows), "digest").sortWithinPartitions("step").drop("step").mapInArrow(_fold, _INDEX)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    ids = cut(docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col).cast("string")).alias("digest")))
    live = cut(index(ids))
    hot = live.where(F.col("group_size") >= F.greatest(F.lit(ids.count() / 1000), F.lit(2)))  # a thousand groups at most
    marked = ids.join(F.broadcast(hot), "digest", "left")
    fast = marked.where(F.col("group_size").isNotNull())
    slow = marked.where(F.col("group_size").isNull()).select("id", "digest").join(live, "digest")
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return fast.unionByName(slow).select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all their columns; of rows equal in id and text one stays."""
    found = cut(groups(docs, id_col=id_col, text_col=text_col))
    lost = found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__ctx_id"), F.col("text_sha256").alias("__ctx_sha")).distinct()
    twice = found.groupBy(id_col).agg(F.count("*").alias("k")).where("k > 1").limit(1).count() > 0
    if not twice and not found.where(F.col(id_col).isNull()).limit(1).count():
        return docs.join(lost, F.col(id_col) == F.col("__ctx_id"), "left_anti").select(*docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("__ctx_id"), F.lower(F.hex(digest(F.col(text_col).cast("string")))).alias("__ctx_sha")).dropDuplicates(["__ctx_id", "__ctx_sha"])
    named = found.where(F.col(id_col).isNotNull()).select(F.col("text_sha256").alias("__ctx_sha")).distinct()
    known = rows.where(F.col("__ctx_id").isNotNull()).join(lost, ["__ctx_id", "__ctx_sha"], "left_anti").select("row.*")
    return known.unionByName(rows.where(F.col("__ctx_id").isNull()).join(named, "__ctx_sha", "left_anti").select("row.*"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""
