"""Token-ID output: texts to token ids, best-fit-decreasing packed into rows of a fixed length.

Each task tokenizes its rows and packs them in windows of at most `window_tokens` tokens (one longer text is a window of
its own, taken in pieces), so memory is bounded and the order of the input is kept from window to window. Within a window
texts longer than a row are split, without loss, into full rows and a remainder; pieces are placed longest first, each in
the open row with the least room that still holds it. A segment tree over the amounts of room finds that row.

A packed row has: pack_id; n_tokens; input_ids (seq_len little-endian ids, 2 bytes each if the vocabulary allows, else 4;
zeros after n_tokens); position_ids (seq_len 4-byte numbers that begin again at 0 with each segment); cu_seqlens (where
segments begin, and n_tokens); doc_ids and doc_offsets (each segment's document, and the number of the document's tokens
before it). `unpack` restores every document's ids.

Null counts as empty; a text without tokens is in no row. Rows that repeat are packed each for itself. A null id is
carried as null. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm import textkernel as K
from contextloom.runtime import ship

SEQ_LEN = 2048
WINDOW_TOKENS = 2_000_000
#: Encoded pieces that a worker remembers, also between tasks.
CACHE = 100_000
_U = np.uint64


def default_tokenizer() -> str:
    """The installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            t[c] = 1 if k == "L" else 2
    # White_Space of Unicode
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        t[c] = 3
    return t


def pieces(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern that public BPE vocabularies use begin, in concatenated code points:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    n = len(cp)
    c = _classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[n] = True
    cut = edge.copy()
    cut[1:n] |= c[1:] != c[:-1]
    space = c == 3
    # A run of white space before other text gives its last character up, and that joins the text if it is a blank.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
    cut[last] = True
    cut[last[cp[last] == 0x20] + 1] = False
    # Contractions, where an apostrophe begins a piece of its own.
    q = np.flatnonzero((cp[:-1] == 0x27) & cut[: n - 1] & cut[1:n] & ~edge[1:n])
    if len(q):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        end = np.concatenate([np.flatnonzero(edge), [n]])
        stop = end[np.searchsorted(end, q, side="right")]
        one = np.isin(pad[q + 1], [ord(x) for x in "stmd"])
        a, b = pad[q + 1], pad[q + 2]
        two = (q + 2 < stop) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        cut[q[one | two] + 1] = False
        cut[q[one] + 2] = True
        cut[q[two] + 3] = True
    return np.flatnonzero(cut[:n])


class RankTokenizer:
    """A vocabulary of byte ranks (.tiktoken). Pieces are found on whole blocks of text and each distinct one is encoded
    once; of those encoded, up to `cache` are remembered."""

    def __init__(self, path: str, cache: int = CACHE):
        import tiktoken
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size, self.limit, self.seen = max(ranks.values()) + 1, cache, {}

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of concatenated UTF-8 texts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        text = data.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        at = pieces(cp, chars)
        end = np.append(at[1:], len(cp))
        h = np.empty(len(at), _U)
        i = 0
        while i < len(at):
            j = max(int(np.searchsorted(end, at[i] + K._SEGMENT, side="right")), i + 1)
            a, b = int(at[i]), int(end[j - 1])
            n = b - a
            pw, inv = (K._POW, K._INV) if n <= K._SEGMENT else (K._powers(K._BASE, n + 1), K._powers(pow(K._BASE, -1, 2**64), n + 1))
            s = np.zeros(n + 1, _U)
            np.cumsum(K.mix(cp[a:b].astype(_U) + _U(7)) * pw[:n], dtype=_U, out=s[1:])
            h[i:j] = (s[end[i:j] - a] - s[at[i:j] - a]) * inv[at[i:j] - a]
            i = j
        inv, u = pd.factorize(h)
        first = np.empty(len(u), np.int64)
        first[inv[::-1]] = np.arange(len(h) - 1, -1, -1)
        if len(self.seen) > self.limit:
            self.seen = {}
        seen, bpe, out = self.seen, self.bpe, []
        for x, k in zip(u.tolist(), first.tolist(), strict=True):
            ids = seen.get(x)
            if ids is None:
                ids = seen[x] = tuple(bpe.encode_ordinary(text[at[k] : end[k]]))
            out.append(ids)
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        n = size[inv]
        ptr = np.concatenate([[0], np.cumsum(n)])
        k = np.arange(ptr[-1]) - np.repeat(ptr[:-1], n) + np.repeat(begin[inv], n)
        return flat[k], ptr[np.searchsorted(at, chars)]


class PlainTokenizer:
    """A vocabulary file of the other two libraries, encoded text by text."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.run = p.get_piece_size(), lambda x: p.encode(x, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            self.size, self.run = t.get_vocab_size(), lambda x: [e.ids for e in t.encode_batch(x, add_special_tokens=False)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.run([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)])
        return np.fromiter((x for y in ids for x in y), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> RankTokenizer | PlainTokenizer:
    return RankTokenizer(path) if path.endswith(".tiktoken") else PlainTokenizer(path)


class Room:
    """A segment tree over the amounts of room 0..n: how many open rows have each, and the least that is at least x."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the tightest fit, which is taken out."""
        i = least + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.tree[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, seq_len: int) -> list[list[int]]:
    """Rows of piece numbers; every size is from 1 to seq_len."""
    room, rows = Room(seq_len), []
    for p in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[p])
        found = room.take(n)
        if found is None:
            rows.append([p])
            left, row = seq_len - n, len(rows) - 1
        else:
            left, row = found[0] - n, found[1]
            rows[row].append(p)
        if left:
            room.add(left, row)
    return rows


SCHEMA = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<long>"


def _rows(docs: list, ids: list[np.ndarray], seq_len: int, width: type, first: int, kind: pa.DataType) -> pa.RecordBatch:
    doc, start, size = [], [], []
    for d, x in enumerate(ids):
        for s in range(0, len(x), seq_len):
            doc.append(d)
            start.append(s)
            size.append(min(seq_len, len(x) - s))
    rows = best_fit_decreasing(np.array(size, np.int64), seq_len)
    out: dict[str, list] = {k: [] for k in ("n", "ids", "pos", "cu", "doc", "off")}
    for row in rows:
        x, p, cu = np.zeros(seq_len, width), np.zeros(seq_len, np.int32), [0]
        for k in row:
            n = size[k]
            x[cu[-1] : cu[-1] + n] = ids[doc[k]][start[k] : start[k] + n]
            p[cu[-1] : cu[-1] + n] = np.arange(n)
            cu.append(cu[-1] + n)
        for k, v in zip(out, (cu[-1], x.tobytes(), p.tobytes(), cu, [docs[doc[k]] for k in row], [start[k] for k in row]), strict=True):
            out[k].append(v)
    types = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(kind), pa.list_(pa.int64()))
    names = ["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets"]
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(rows)), pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=names)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Packed rows of the documents. tokenizer_path: a vocabulary file that the driver can read; executors get a copy."""
    ship(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    docs.sparkSession.sparkContext.addFile(path)
    file = os.path.basename(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(SparkFiles.get(file))
        width = np.dtype("<u2") if t.size <= 1 << 16 else np.dtype("<u4")
        # Low 40 bits count the rows of one task.
        next_id, names, held, n, of = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, [], [], 0, None
        for batch in batches:
            of = batch.column(0).type
            for start, stop, data, off in K.blocks(batch.column(1)):
                ids, ptr = t.encode(data, off)
                for i, name in enumerate(batch.column(0).slice(start, stop - start).to_pylist()):
                    if ptr[i] == ptr[i + 1]:
                        continue
                    names.append(name)
                    held.append(ids[ptr[i] : ptr[i + 1]].astype(width))
                    n += int(ptr[i + 1] - ptr[i])
                    if n >= window_tokens:
                        yield (out := _rows(names, held, seq_len, width, next_id, of))
                        next_id, names, held, n = next_id + out.num_rows, [], [], 0
        if held:
            yield _rows(names, held, seq_len, width, next_id, of)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA.format(kind=kind))


def write(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, whose binary columns are the id and position matrices."""
    packed.write.parquet(path)


def unpack(row, width: str = "<u2") -> list[tuple[object, int, np.ndarray]]:
    """(document, offset, ids) of each segment of a packed row."""
    ids, cu = np.frombuffer(row["input_ids"], width), row["cu_seqlens"]
    return [(d, o, ids[a:b]) for d, o, a, b in zip(row["doc_ids"], row["doc_offsets"], cu[:-1], cu[1:], strict=True)]


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
