"""Sharding by vector bin packing (operator 10).

Documents with equal texts are a group, and a group is a vector: its bytes,
tokens and rows as shares of all.  Packing goes largest first, every group into
the shard where the dot product of its vector with the residual capacity is
highest.

A group is placed whole unless it holds more of all bytes, tokens or rows than a
shard should; only then is it cut, by a hash of doc_id, into the fewest pieces
that fit.  There are fewer such groups than three times the shards.

Whatever holds more than 1/4096 of all bytes, tokens or rows, at most 3 * 4096
groups and pieces, is packed first, once, over all, largest first.  The others
are dealt by their hash to buckets, whose number follows the number of rows and
not that of the tasks.  Each bucket is packed on its own, into capacities that
divide what it holds as the residual capacities of the shards stand to each
other; so what the large groups left uneven is filled up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Tables, lookup, word_count

SHARDS = 8
#: A group or piece above this part of all is packed over all.
LONG = 4096
#: Groups of a bucket, at most and at least, and buckets of a small table.
FULL, LEAST, FEW = 4096, 1024, 256
#: Rows of a shard are numbered within so many buckets, then across them.
BUCKETS = 4096
#: What is left after the largest groups evens out bytes, the quantity of the law.
WEIGHTS = (4.0, 1.0, 1.0)


def pack(vectors: np.ndarray, total: np.ndarray, parts: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each row of ``vectors``, by the dot product with residual capacity, and the parts of ``total`` that are left.

    ``parts`` has a row for each shard and a column for each quantity.
    """
    weights = np.asarray(WEIGHTS) * (total > 0)
    v = vectors / np.where(total > 0, total, 1) * weights
    names = np.roll(np.arange(len(parts)), turn)
    left = (parts * weights)[names]
    out = np.zeros(len(v), dtype=np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable").tolist():
        s = int((left @ v[i]).argmax())
        left[s] -= v[i]
        out[i] = names[s]
    rest = np.empty_like(left)
    rest[names] = left
    return out, np.where(weights > 0, rest / np.where(weights > 0, weights, 1), parts)


def _pack_bucket(parts: np.ndarray):
    def fn(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(_ITEM, ignore_index=True)
        vectors = items[_SIZES].to_numpy(dtype=float)
        return items[_ITEM].assign(shard=pack(vectors, vectors.sum(axis=0), parts, int(items["group"].iloc[0] % len(parts)))[0])

    return fn


_ITEM, _SIZES = ["k1", "k2", "piece"], ["bytes", "tokens", "rows"]
_PACKED = "k1 long, k2 long, piece int, shard int"


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Sizes of shards are near equal (law ``bytes``); tokens and rows are balanced
    with them.  A null text has size 1 and is a group of its own kind; empty
    texts, null or repeated doc_ids and repeated rows are placed like any other,
    and an empty table gives no row.  ``slot`` numbers a shard's rows from 0
    without gaps.  Rows with equal texts share a shard unless they are more than
    a shard's part of all.  Further columns are not read, whatever their names.
    """
    tables = Tables(docs.sparkSession, "sharding")
    raw = F.col("text").cast("binary")
    rows = tables.cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"),
            word_count(F.col("text")).alias("tokens"),
            F.xxhash64("text").alias("k1"),
            F.xxhash64(F.lit(1), "text", F.octet_length(raw)).alias("k2"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        total = {"bytes": 1, "tokens": 1, "rows": 1}
    share = F.greatest(*[F.col(c) / float(max(total[c] or 0, 1)) for c in ("bytes", "tokens", "rows")])
    large = rows.groupBy("k1", "k2").agg(*sums).withColumn("pieces", F.ceil(share * shards)).filter("pieces > 1").select("k1", "k2", "pieces")
    rows = rows.join(F.broadcast(large), ["k1", "k2"], "left")
    rows = rows.withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), "pieces")).otherwise(0).cast("int"))
    items = tables.cut(rows.groupBy(*_ITEM).agg(*sums).withColumn("long", share > 1 / LONG), "items")
    # at most 3 * LONG rows
    long = items.filter("long").select(*_ITEM, *_SIZES).toPandas().sort_values(_ITEM, ignore_index=True)
    sizes = np.array([float(total[c] or 0) for c in _SIZES])
    where, left = pack(long[_SIZES].to_numpy(dtype=float), sizes, np.full((shards, len(_SIZES)), 1 / shards))
    left = np.maximum(left, 0)
    left = np.where(left.sum(axis=0) > 0, left / np.where(left.sum(axis=0) > 0, left.sum(axis=0), 1), 1 / shards)
    buckets = max(1, -(-total["rows"] // FULL), min(FEW, total["rows"] // LEAST))
    dealt = items.filter("not long").withColumn("group", F.pmod(F.xxhash64(*_ITEM, F.lit(5)), F.lit(buckets)).cast("int"))
    packed = dealt.groupBy("group").applyInPandas(_pack_bucket(left), _PACKED)
    first = list(zip(*(long[c].tolist() for c in _ITEM), where.tolist(), strict=True))
    packed = tables.cut(packed.union(docs.sparkSession.createDataFrame(first, _PACKED)), "packed")
    # a group of copies may hold a shard's part of all rows
    numbered = rows.withColumn("row_", F.monotonically_increasing_id())
    placed = lookup(numbered, packed, ["k1", "k2", "piece"], "row_", tables)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(BUCKETS)).cast("int"))
    placed = tables.cut(placed.select("doc_id", "size", "text_crc32", "shard", "bucket", "k1"), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * BUCKETS rows
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "k1", "text_crc32")
    numbered = placed.withColumn("own", F.row_number().over(within) - 1).join(F.broadcast(base), ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents of the table in eight shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
