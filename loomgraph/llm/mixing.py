"""Mixing sources to target weights (operator 2).

Sizes are summed per source; the targets follow from the sums by water filling
over one row a source; each document then gets floor(rate) copies and one more
if a hash of its doc_id, read as a number in [0, 1), lies below the fraction.
Only DataFrame functions are used, and only the sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from ._shared import Tables, word_count

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Bytes of all names of sources up to which they are sent to the tasks, and parts of a source beyond.
NAME_BYTES, SPREAD = 16 << 20, 64


def _draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the seed and the doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source from (source, source_size), one row a source.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size
    and the rest is shared again by weight.  That settles where the sources,
    ordered by the share at which they are full, stop filling: level is then
    what is left for each unit of weight.  Empty sources have target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    fills = F.col("level") <= F.col("cap") / F.col("weight")
    rows = rows.withColumn("level", F.max(F.when(fills, F.col("level"))).over(whole))
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _join_sources(docs: DataFrame, share: DataFrame) -> DataFrame:
    """``docs`` with the row of its source; sources that are few and of short names are sent to the tasks.

    Beyond that bound the rows of a source are dealt to SPREAD parts, so a
    source that holds a third of all rows is not one task.
    """
    named = share.agg(F.count("*").alias("n"), F.sum(F.octet_length("source_")).alias("bytes")).first()
    same = F.col("source").eqNullSafe(F.col("source_"))
    if named["n"] <= _shared.BROADCAST_ROWS and (named["bytes"] or 0) <= NAME_BYTES:
        return docs.join(F.broadcast(share), same)
    left = docs.withColumn("part_", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"))
    right = share.withColumn("part_of_", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.join(right, same & (F.col("part_") == F.col("part_of_"))).drop("part_", "part_of_")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies added.

    Null texts have size 0; a null source is a source of its own; a null doc_id
    draws as one value of its own and repeated rows draw alike.  Names that
    clash with the added columns are replaced.  An empty table gives no row.
    """
    added = ["size", "source_size", "target", "copies"]
    docs = docs.drop(*added).withColumn("size", word_count(F.col("text")))
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = Tables(docs.sparkSession, "mix").cut(targets(sums, weights, most).withColumnRenamed("source", "source_"), "targets")
    out = _join_sources(docs, share).drop("source_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(_draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long"))


def repeat(docs: DataFrame) -> DataFrame:
    """Each document of a mixed table as often as ``copies`` says, in its own columns."""
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return docs.filter("copies > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_")).select(*names)


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents of the table with the words that the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((SUM(source_size) OVER ())::DOUBLE
    - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), m AS (
  SELECT *, LEAST(cap, MAX(CASE WHEN level <= cap / weight THEN level END) OVER () * weight) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, m.source_size, m.target,
    CASE WHEN m.source_size > 0 THEN m.target / m.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
