"""Byte-level BPE encoding and decoding by ranks (operator 9).

A piece's bytes are the leaves of a segment tree.  A leaf that still starts a
token holds the rank of the pair it makes with the next live token; each inner
node holds the smaller of its children, the left one on ties, so the root is
the leftmost pair of least rank.  A merge changes three leaves (the pair's, its
left neighbour's and the swallowed one's) and the path from each to the root.

``merge`` works on one piece, ``merge_many`` on a matrix of short pieces, one
tree a row, with the same steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._shared import slices
from .pieces import Encoder, ragged

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NONE = np.iinfo(np.int64).max
MATRIX = 64  # pieces of at most so many bytes go through the matrix


class Ranks:
    """A vocabulary of byte strings with their ranks, and the pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            rows = (line.split() for line in f if line.strip())
            self.of = {base64.b64decode(a): int(b) for a, b in rows}
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.of.items():
            for k in range(1, len(token)):
                a, b = self.of.get(token[:k]), self.of.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.byte = np.array([self.of[bytes([i])] for i in range(256)], dtype=np.int64)
        self.size = max(self.of.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.of.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        whole = A.byte_hash(self.bytes, self.starts, self.starts + self.lengths)
        self.whole_rank = np.argsort(whole)
        self.whole = whole[self.whole_rank]
        self._table()

    def _table(self) -> None:
        """Open addressing: the pair's slot or one of those after it."""
        self.bits = max(8, int(np.ceil(np.log2(max(len(self.pairs), 1) * 4))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        ranks = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(keys))
        slot = self._slot(keys)
        while len(keys):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[free]
            placed = self.slots[slot] == keys
            self.ranks[slot[placed]] = ranks[placed]
            keys, ranks, slot = keys[~placed], ranks[~placed], (slot[~placed] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(A.U) * A.U(0x9E3779B97F4A7C15)) >> A.U(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two do not merge; b < 0 has no pair."""
        keys = a << 32 | b
        slot = self._slot(keys)
        found = self.slots[slot]
        out = np.where((found == keys) & (b >= 0), self.ranks[slot], NONE)
        left = np.flatnonzero((found != keys) & (found >= 0) & (b >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            found = self.slots[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def merge(piece: bytes, r: Ranks) -> list[int]:
    """Ids of one piece of any length."""
    n = len(piece)
    leaves = 1 << max(0, n - 1).bit_length()
    token = [int(r.byte[b]) for b in piece]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    none = (1 << 60, 0)
    tree = [none] * (2 * leaves)

    def pair(i: int) -> tuple[int, int]:
        k = after[i]
        rank = r.pairs.get((token[i], token[k])) if k >= 0 else None
        return none if rank is None else (rank, i)

    def put(i: int, value: tuple[int, int]) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    for i in range(n):
        tree[leaves + i] = pair(i)
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while n > 1 and tree[1] is not none:
        rank, i = tree[1]
        k = after[i]
        token[i], after[i], token[k] = rank, after[k], -1
        if after[k] >= 0:
            before[after[k]] = i
        put(k, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [t for t in token if t >= 0]


def merge_many(matrix: np.ndarray, lengths: np.ndarray, r: Ranks) -> np.ndarray:
    """Ids of many pieces: a row of bytes each, the number of columns a power of two.

    Returns a matrix of ids with -1 where no token starts.
    """
    n, leaves = matrix.shape
    column = np.arange(leaves)
    live = column < lengths[:, None]
    token = np.where(live, r.byte[matrix], -1)
    after = np.where(column + 1 < lengths[:, None], column + 1, -1)
    before = np.broadcast_to(column - 1, (n, leaves)).copy()
    tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)

    def pair(row: np.ndarray, i: np.ndarray) -> np.ndarray:
        k = after[row, i]
        rank = r.rank(token[row, i], np.where(k < 0, -1, token[row, k]))
        return np.where(rank == NONE, NONE, rank * leaves + i)

    row, i = np.nonzero(live)
    tree[row, leaves + i] = pair(row, i)
    level = leaves
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        i = i + leaves
        tree[row, i] = value
        while i.size and i[0] > 1:
            i = i >> 1
            tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])

    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        best = tree[row, 1]
        i = best & (leaves - 1)
        k = after[row, i]
        then = after[row, k]
        token[row, i], token[row, k], after[row, i] = best // leaves, -1, then
        has = then >= 0
        before[row[has], then[has]] = i[has]
        put(row, k, np.full(len(row), NONE))
        put(row, i, pair(row, i))
        left = before[row, i]
        has = left >= 0
        put(row[has], left[has], pair(row[has], left[has]))
        row = row[tree[row, 1] != NONE]
    return token


def encode_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and counts of the pieces data[start:end].

    A piece that is itself in the vocabulary is one id.
    """
    lengths = end - start
    keys = A.byte_hash(data, start, end)
    spot = np.minimum(np.searchsorted(r.whole, keys), len(r.whole) - 1)
    token = r.whole_rank[spot]
    single = (r.whole[spot] == keys) & (r.lengths[token] == lengths)
    own = np.flatnonzero(single)
    single[own] = A.same_spans(data, start[own], r.starts[token[own]], lengths[own], r.bytes)
    counts = np.ones(len(start), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(single), r.whole_rank[spot[single]])]
    for k in np.flatnonzero(~single & (lengths > MATRIX)).tolist():
        ids = np.array(merge(data[start[k] : end[k]].tobytes(), r))
        counts[k] = len(ids)
        parts.append((np.array([k]), ids))
    size = 2
    while size <= MATRIX:
        members = np.flatnonzero(~single & (lengths <= size) & ((lengths > size // 2) | (size == 2)))
        if len(members):
            column = np.arange(size)
            matrix = data[np.minimum(start[members, None] + column, len(data) - 1)]
            token = merge_many(matrix, lengths[members], r)
            counts[members] = (token >= 0).sum(axis=1)
            parts.append((members, token[token >= 0]))
        size *= 2
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.int64)
    for members, ids in parts:
        out[ragged(place[members], counts[members])] = ids
    return out, counts


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary, with its cache of pieces."""
    r = ranks(path)
    return Encoder(lambda data, start, end: encode_pieces(data, start, end, r))


def decode(ids: np.ndarray, r: Ranks) -> np.ndarray:
    """Bytes of a sequence of ids."""
    return r.bytes[ragged(r.starts[ids], r.lengths[ids])]


def _arrays(path: str, digest: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, r = encoder(path), ranks(path)
        for batch in slices(batches, "text"):
            ids, at = encode(batch.column("text"))
            raw, counts = ids.astype("<u4").tobytes(), np.diff(at)
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            places = at.tolist()
            chunks = [raw[4 * a : 4 * b] for a, b in zip(places[:-1], places[1:], strict=True)]
            if digest:
                back = decode(ids, r).tobytes()
                to = np.concatenate([[0], np.cumsum(r.lengths[ids])])[at].tolist()
                more = [
                    pa.array([hashlib.sha256(c).hexdigest() for c in chunks]),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:], strict=True)]),
                ]
                names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                more, names = [pa.array(chunks, pa.binary())], [*names, "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(counts), *more], names=names)

    return fn


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every text.

    Ids are those of ordinary text: strings of special tokens have no special
    meaning.  Null and empty texts have no ids.  Rows are answered one by one,
    so null or repeated doc_ids and further columns change nothing; an empty
    table gives no row.
    """
    return docs.select("doc_id", "text").mapInArrow(_arrays(path, False), "doc_id long, n_tokens long, ids binary")


def decode_ids(frame: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with ``ids`` as ``encode`` returns them; null ids give a null text, an empty table no row."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for batch in slices(batches, "ids"):
            texts = [None if x is None else decode(np.frombuffer(x, "<u4").astype(np.int64), r).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    raw = frame.select("doc_id", "ids").mapInArrow(fn, "doc_id long, bytes binary")
    return raw.select("doc_id", F.decode("bytes", F.lit("UTF-8")).alias("text"))


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the sha256 of each text's ids and of its decoded bytes.

    Null and empty texts have no ids, and the digests are those of no bytes.
    Rows are answered one by one, so null or repeated doc_ids change nothing;
    other columns are not read, and an empty table gives no row.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_arrays(path, True), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents of the table, encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
