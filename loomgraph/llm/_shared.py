"""What the corpus operators share: bounded broadcasts, salted joins, components, block pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Tables, shared_dir

__all__ = ["Tables", "block_pairs", "boxed", "components", "crc32_text", "lookup", "salted", "shared_dir", "slices", "small", "unboxed", "word_count"]

#: A side of at most this many rows of numbers, 8 MB for each column, is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 500_000
#: A key with more rows than this is spread over several tasks.
HOT = 2000
#: Words of a text, as the contracts define them: bytes other than blanks.
WORD = r"[^\x20\x09-\x0D]+"


def crc32_text(column: Column) -> Column:
    """Unsigned crc32 of a value's text."""
    return F.crc32(column.cast("string").cast("binary"))


def word_count(column: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def small(table: DataFrame) -> DataFrame:
    """A written table of numbers, with a hint to broadcast it if it has few enough rows.

    Only tables whose columns all have a fixed width may be given, so that the
    bound on rows is one on bytes.
    """
    wide = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    if wide:
        raise ValueError(f"no bound is known for the bytes of {', '.join(wide)}")
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def hot_keys(rows: DataFrame, keys: list[str], tables: Tables) -> DataFrame:
    """(keys, parts_): keys with more than HOT rows and the number of parts to spread them over.

    Rows are counted before they are shuffled, and there is at most one such
    key for every HOT rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > HOT)
    return tables.cut(counts.select(*keys, F.ceil(F.col("n_") / HOT).cast("int").alias("parts_")), "hot")


def salted(rows: DataFrame, table: DataFrame, keys: list[str], by: str, tables: Tables, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with a table of unique keys; rows of a hot key are dealt to many tasks by a hash of ``by``.

    A table that says how many rows a key has (``n_``) saves counting them.
    """
    if "n_" in table.columns:
        hot = table.filter(F.col("n_") > HOT).select(*keys, F.ceil(F.col("n_") / HOT).cast("int").alias("parts_"))
        hot = tables.cut(hot, "hot")
    else:
        hot = hot_keys(rows, keys, tables)
    if hot.isEmpty():
        return rows.join(table, keys, how)
    parts = F.coalesce(F.col("parts_"), F.lit(1))
    left = rows.join(small(hot), keys, "left").withColumn("salt_", F.pmod(F.xxhash64(by, F.lit(11)), parts).cast("int")).drop("parts_")
    right = table.join(small(hot), keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts_")
    return left.join(right, [*keys, "salt_"], how).drop("salt_")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], by: str, tables: Tables, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with a written table of numbers and unique keys: broadcast if it is small, else salted by ``by``."""
    hinted = small(table)
    return rows.join(hinted, keys, how) if hinted is not table else salted(rows, table, keys, by, tables, how)


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v only, and no v is itself a u."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.join(small(edges.select(F.col("u").alias("v"))), "v", "left_semi").isEmpty()


def components(edges: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars.

    Returns (node, component) for every node of an edge; component is the
    smallest node that can be reached.  Each round is two aggregations and two
    joins on the node, and the number of rounds grows with the logarithm of the
    longest chain; it ends when every edge points at the centre of a star.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    cur = tables.cut(edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")

    def to_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(least), "u") if few else salted(rows, least, ["u"], "v", tables)

    while not _stars(cur):
        few = cur.count() <= BROADCAST_ROWS // 2
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_")).select("u", F.least("u", "m").alias("m"), "n_")
        large = to_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_"))
        near = to_least(large, least)
        tables.drop(cur)
        cur = tables.cut(
            near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct(),
            "star",
        )
        tables.drop(large)
    ends = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)


def block_pairs(
    rows: DataFrame,
    key: str,
    ident: str,
    prepare: Callable[[pa.Table], object],
    compare: Callable[[object, np.ndarray, np.ndarray | None], tuple[np.ndarray, ...]],
    schema: str,
    counts: DataFrame,
    block: int = 1000,
) -> DataFrame:
    """Apply ``compare`` to all pairs of rows that share ``key``, block against block.

    A key with more than ``block`` rows is dealt by a hash of ``ident`` to
    blocks; each pair of blocks is a group of its own, so a key that holds a
    third of all rows becomes many equal tasks and no group outgrows two blocks.
    Smaller keys share groups of about one block, by a hash of the key, so
    that a group's rows are prepared once for all keys that hold them.

    ``prepare`` reads a group's rows; ``compare(prepared, i, None)`` compares
    the rows at ``i`` with each other, ``compare(prepared, i, j)`` with those at
    ``j``; it returns the columns of ``schema``.  ``counts`` is the written
    table (key, n_) of the keys that are asked for and how many rows each has;
    ``rows`` holds the rows of these keys, with n_.
    """
    total = counts.filter(F.col("n_") <= block).agg(F.sum("n_")).first()[0] or 0
    shared = max(1, -(-total // block))
    n = F.col("n_")
    dealt = rows.withColumn("nb_", F.ceil(n / block).cast("int"))
    dealt = dealt.withColumn("own_", F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.col("nb_")).cast("int"))
    dealt = dealt.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("nb_") - 1)))
    dealt = dealt.withColumn("i_", F.least("own_", "other_")).withColumn("j_", F.greatest("own_", "other_"))
    # a group of small keys is named by a number from 0, a key of several blocks by -1 and itself
    dealt = dealt.withColumn("of_", F.when(n <= block, F.pmod(F.xxhash64(key, F.lit(13)), F.lit(shared))).otherwise(-1).cast("long"))
    dealt = dealt.withColumn("key_", F.when(n > block, F.col(key)))
    names = [f.split()[0] for f in schema.split(",")]

    def group(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        prepared = prepare(t)
        i, j = t.column("i_")[0].as_py(), t.column("j_")[0].as_py()
        if i != j:
            own = t.column("own_").to_numpy()
            found = [compare(prepared, np.flatnonzero(own == i), np.flatnonzero(own == j))]
        elif t.column("of_")[0].as_py() < 0:
            found = [compare(prepared, np.arange(len(t)), None)]
        else:
            keys = t.column(key).to_numpy()
            order = np.argsort(keys, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)
            found = [compare(prepared, r, None) for r in runs if len(r) > 1]
        empty = [np.zeros(0, np.int64)]
        return pa.table({c: np.concatenate(empty + [f[k] for f in found]) for k, c in enumerate(names)})

    return dealt.drop("n_", "nb_", "other_").groupBy("of_", "key_", "i_", "j_").applyInArrow(group, schema)


def boxed(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and all other columns in one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in kept]
    return docs.select(*kept, (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias("box_"))


def unboxed(rows: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """The columns that ``boxed`` took, in their order."""
    return rows.select(*[F.col(c) if c in kept else F.col("box_").getField(c).alias(c) for c in columns])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has about ``most`` bytes of text in each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
