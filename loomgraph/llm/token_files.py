"""Token-ID files of patched frame-of-reference blocks (operator 6).

A segment is a byte string that holds the ids of some whole documents:

    magic  u32, number of ids u32, number of blocks u32,
    start of each block u32 (from the first block's byte),
    blocks, one after another.

A block holds 128 ids (the last may hold fewer and is filled up with its
minimum): minimum u32, width u8, number of exceptions u8, the low ``width``
bits of the 128 differences from the minimum in ``4 * width`` 32-bit words,
then the exceptions: their positions u8 and their differences u32.  The width
is that of the 90th percentile of the block's differences; wider differences
are exceptions.  All numbers are little-endian.

Segments are rows of a table that Spark writes and reads (part, first, doc_id,
lengths, segment), so any store that Spark reaches can hold them.  ``part``
follows the order of doc_id, ``first`` counts the ids before the segment in its
part, and one small table of ids per part gives every document's place.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._shared import Tables, slices
from .pieces import Encoder, ragged

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MAGIC = 0x31524650
BLOCK, LANES = 128, 4
PERCENTILE = 90
END = 2
#: A segment is closed after the document with which it reaches so many ids.
SEGMENT = 1 << 18
#: Pieces that one call of the library takes as lines.
LINES = 128


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each value below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values of ``width`` bits as rows of 4 * width words."""
    n = len(low)
    lanes = low.reshape(n, BLOCK // LANES, LANES)
    out = np.zeros((n, width, LANES), dtype=np.uint64)
    for k in range(BLOCK // LANES if width else 0):
        word, shift = divmod(k * width, 32)
        value = lanes[:, k] << np.uint64(shift)
        out[:, word] |= value & np.uint64(0xFFFFFFFF)
        if shift + width > 32:
            out[:, word + 1] |= value >> np.uint64(32)
    return out.astype("<u4").reshape(n, width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    lanes = words.reshape(n, width, LANES).astype(np.uint64)
    out = np.zeros((n, BLOCK // LANES, LANES), dtype=np.uint64)
    for k in range(BLOCK // LANES if width else 0):
        word, shift = divmod(k * width, 32)
        value = lanes[:, word] >> np.uint64(shift)
        if shift + width > 32:
            value |= lanes[:, word + 1] << np.uint64(32 - shift)
        out[:, k] = value & np.uint64((1 << width) - 1)
    return out.reshape(n, BLOCK)


def encode_segment(ids: np.ndarray) -> bytes:
    """The segment that holds ``ids`` (below 2**32)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    rows = np.zeros(blocks * BLOCK, dtype=np.uint64)
    rows[:n] = ids
    if n % BLOCK:
        rows[n:] = rows[(blocks - 1) * BLOCK : n].min()
    rows = rows.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    width = _bits(np.percentile(rows, PERCENTILE, axis=1, method="lower")) if blocks else np.zeros(0, np.int64)
    odd = _bits(rows) > width[:, None]
    count = odd.sum(axis=1)
    size = 6 + 4 * LANES * width + 5 * count
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), dtype=np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        """Rows of bytes at the given places."""
        body[at[:, None] + np.arange(values.shape[1])] = values

    if blocks:
        put(start, least.astype("<u4").view(np.uint8).reshape(-1, 4))
        body[start + 4], body[start + 5] = width, count
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            if w:
                packed = np.ascontiguousarray(_pack(rows[own] & np.uint64((1 << w) - 1), w))
                put(start[own] + 6, packed.view(np.uint8).reshape(len(own), -1))
        block, position = np.nonzero(odd)
        nth = np.arange(len(block)) - (np.cumsum(count) - count)[block]
        tail = start[block] + 6 + 4 * LANES * width[block]
        body[tail + nth] = position
        if len(block):
            put(tail + count[block] + 4 * nth, rows[block, position].astype("<u4").view(np.uint8).reshape(-1, 4))
    return struct.pack("<III", MAGIC, n, blocks) + start.astype("<u4").tobytes() + body.tobytes()


def decode_segment(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (all of them if not given)."""
    magic, n, blocks = struct.unpack_from("<III", segment)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    last = blocks if last is None else min(last, blocks)
    start = np.frombuffer(segment, "<u4", blocks, 12).astype(np.int64)[first:last]
    body = np.frombuffer(segment, np.uint8, offset=12 + 4 * blocks)
    take = lambda at, k: body[at[:, None] + np.arange(k)]
    rows = np.zeros((len(start), BLOCK), dtype=np.uint64)
    if len(start):
        least = np.ascontiguousarray(take(start, 4)).view("<u4")[:, 0].astype(np.uint64)
        width, count = body[start + 4].astype(np.int64), body[start + 5].astype(np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            if w:
                rows[own] = _unpack(np.ascontiguousarray(take(start[own] + 6, 4 * LANES * w)).view("<u4"), w)
        block = np.repeat(np.arange(len(start)), count)
        if len(block):
            tail = start + 6 + 4 * LANES * width
            position = body[ragged(tail, count)]
            nth = np.arange(len(block)) - (np.cumsum(count) - count)[block]
            rows[block, position] = np.ascontiguousarray(take(tail[block] + count[block] + 4 * nth, 4)).view("<u4")[:, 0]
        rows += least[:, None]
    return rows.reshape(-1)[: max(0, min(n - first * BLOCK, len(start) * BLOCK))].astype(np.int64)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """Distinct pieces go to the library once; its pre-tokenizer leaves a piece whole.

    Pieces that are no white space go as lines, many to a call: a line break is a
    piece of its own before and after them, and its id tells them apart again.
    """
    t = _tokenizer(path)
    ids_of = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    flat = lambda lists, n: np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=n)
    end = ids_of(["\n"])[0]

    def singly(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = ids_of(pieces)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return flat(ids, int(counts.sum())), counts

    def as_lines(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = ids_of(["\n".join([*pieces[i : i + LINES], ""]) for i in range(0, len(pieces), LINES)])
        ids = flat(lists, sum(map(len, lists)))
        ends = np.flatnonzero(ids == end[0])
        if len(end) != 1 or len(ends) != len(pieces):
            return singly(pieces)
        return ids[ids != end[0]], np.diff(ends, prepend=-1) - 1

    def encode(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        line = np.array([not x[-1].isspace() for x in pieces], dtype=bool)
        counts, parts = np.zeros(len(pieces), dtype=np.int64), []
        for own, how in ((np.flatnonzero(line), as_lines), (np.flatnonzero(~line), singly)):
            if len(own):
                ids, counts[own] = how([pieces[i] for i in own.tolist()])
                parts.append((own, ids))
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.int64)
        for own, ids in parts:
            out[ragged(at[own], counts[own])] = ids
        return out, counts

    return Encoder(encode)


@lru_cache(maxsize=2)
def _by_pieces(path: str) -> tuple[bool, list[str]]:
    """Whether texts may be encoded piece by piece, and strings that forbid it."""
    import json

    t = json.loads(_tokenizer(path).to_str())
    pre = t.get("pre_tokenizer") or {}
    plain = not t.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(plain), [a["content"] for a in t.get("added_tokens") or []]


def encode_texts(column: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column as the library gives them, and each text's offsets."""
    plain, added = _by_pieces(path)
    n = len(column)
    whole = np.full(n, not plain)
    for a in added if plain else []:
        whole |= pc.fill_null(pc.match_substring(column, a), False).to_numpy(zero_copy_only=False).astype(bool)
    if not whole.any():
        return _encoder(path)(column)
    own, at = _encoder(path)(pa.array([None if w else x for w, x in zip(whole.tolist(), column.to_pylist(), strict=True)], pa.string()))
    parts = [own[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for i in np.flatnonzero(whole).tolist():
        parts[i] = np.array(_tokenizer(path).encode(column[i].as_py() or "", add_special_tokens=False).ids, dtype=np.int32)
    return np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _write(path: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = [[part], [first], [docs], [np.concatenate(lengths).tolist()], [encode_segment(flat)]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "first", "doc_id", "lengths", "segment"]
            )

        for batch in slices(batches, "text", 1 << 20):
            own, at = encode_texts(batch.column("text"), path)
            own = np.insert(own, at[1:], END)
            docs += batch.column("doc_id").to_pylist()
            lengths.append(np.diff(at) + 1)
            ids.append(own)
            held += len(own)
            if held >= SEGMENT:
                yield close()
                first, held = first + held, 0
                docs, lengths, ids = [], [], []
        if docs:
            yield close()

    return fn


def write(docs: DataFrame, folder: str, path: str = VOCABULARY) -> None:
    """Encode all texts in ascending doc_id order and write them to ``folder``.

    Each text's ids are followed by the end id.  Null texts are empty; null
    doc_ids come first; rows of one doc_id are ordered by a hash of the text.
    Other columns are not read, whatever their names, and an empty table gives
    files without a document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # ranges of both, so that rows without a doc_id, or with one in common, are spread as well
    docs = docs.withColumn("version", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version").drop("version")
    schema = "part int, first long, doc_id array<long>, lengths array<long>, segment binary"
    ordered.mapInArrow(_write(path), schema).write.parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, docs, lengths, segment in zip(*(batch.column(c) for c in ("part", "first", "doc_id", "lengths", "segment")), strict=True):
            ids = decode_segment(segment.as_buffer().to_pybytes()).astype("<u4").tobytes()
            counts = np.array(lengths.as_py(), dtype=np.int64)
            end = np.cumsum(counts)
            places = zip((end - counts).tolist(), end.tolist(), strict=True)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs.as_py(), pa.int64()), pa.array(np.full(n, part.as_py(), np.int32)),
                    pa.array(first.as_py() + end - counts), pa.array(counts),
                    pa.array([ids[4 * a : 4 * b] for a, b in places], pa.binary()),
                ],
                names=["doc_id", "part", "start", "n_tokens", "ids"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def read(spark, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their crc32) of every document of ``folder``."""
    files = spark.read.schema("part int, first long, doc_id array<long>, lengths array<long>, segment binary").parquet(folder)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = files.select("part", (F.col("first") + total).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote, whatever the number of documents
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    last = "ids_crc32" if digest else "ids"
    rows = files.mapInArrow(_digest if digest else _read, f"doc_id long, part int, start long, n_tokens long, {last} {'long' if digest else 'binary'}")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", last)


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents of the table, written to token files and read back."""
    folder = Tables(spark, "token-files").root
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read(spark, folder, digest=True)
