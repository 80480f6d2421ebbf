"""Embedding near-dedup on a pivot-permutation index (operator 3).

Reference points (pivots) are vectors of the table itself, the ones with the
smallest hashes, without those that have a cosine of 0.8 or more with an earlier
one, so that a group of near copies supplies one pivot and not most of them.
Their number follows the square root of the table, between 32 and 1024, so what
goes out with the tasks is bounded.

A vector whose cosine with its nearest pivot, its home, is at least 0.8 is close,
any other is open.  Links of close vectors are found exactly: a vector linked to
one at home at a pivot is, by the triangle inequality of angles, within
acos(0.8) + acos(0.93) of that pivot, and every vector is posted to all pivots
within that angle (a close one only up to its own home in number, so that a pair
meets once).  Blocks of the vectors at home are compared with each other and
with the blocks of the others, whatever the order of the pivots.

An open vector is described by its 8 nearest pivots in order and posted to the
inverted list of each of them, within its label, with its description.  A list
is compared block against block: pairs that share at least 3 pivots are
candidates, each in the list of the first pivot that they share only, and are
verified by their cosine.  Only links between two open vectors can be missed.

Vectors with the same label and components are one row in the index, with their
number.  Blocks return, for each vector, the number of vectors linked and one
edge to the smallest vector of its linked part, so what is emitted grows with
the vectors and not with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, block_pairs, components, lookup

COSINE = 0.93
NEAREST, SHARED = 8, 3
FEWEST, MOST = 32, 1024
#: Cosine of a close vector with its home, and of the widest angle at which a linked one can be from there.
HOME = 0.8
VISIT = math.cos(math.acos(HOME) + math.acos(COSINE)) - 1e-9
#: Pivots are thinned out of so many times their number.
POOL = 4
BLOCK = 500


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column (all of one length in a batch) as unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = flat.value_lengths().to_numpy()
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat.flatten().to_numpy()
    scale = np.abs(out).max(axis=1, keepdims=True) if width else 1
    out = out / scale
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def _thin(points: np.ndarray) -> np.ndarray:
    """Rows that have a cosine under HOME with every earlier row that is kept."""
    kept = np.zeros((0, points.shape[1]))
    for x in points:
        if (kept @ x < HOME).all():
            kept = np.vstack([kept, x])
    return kept


def _describe(pivots: np.ndarray):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("e"))
            width = max(x.shape[1], pivots.shape[1])
            x, p = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, pivots))
            cosine = x @ p.T
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.reshape(-1)))
            home = np.where(cosine[np.arange(len(x)), order[:, 0]] >= HOME, order[:, 0], -1).astype(np.int32)
            visit = (cosine >= VISIT) & ((home < 0)[:, None] | (np.arange(len(p)) <= home[:, None]))
            ends = np.concatenate([[0], visit.sum(axis=1).cumsum()]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(visit)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(home), visits], names=[*batch.schema.names, "near", "home", "visits"])

    return fn


def _read(t: pa.Table):
    """Columns of a group's rows, their nearest pivots and their vectors."""
    near = t.column("near").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    return *(t.column(c).to_numpy() for c in ("vec_id", "copies", "pivot")), near, _unit(t.column("e"))


def _compare(prepared, one: np.ndarray, two: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Numbers of links and one edge for each vector of one or two blocks of a list."""
    ids, copies, pivots, near, unit = prepared
    pivot, cut = pivots[one[0]], len(one)
    both = one if two is None else np.concatenate([one, two])
    near, unit, n = near[both], unit[both], len(both)
    names, spot = np.unique(near, return_inverse=True)
    member = np.zeros((n, len(names)), dtype=np.float32)
    member[np.arange(n)[:, None], spot.reshape(near.shape)] = 1
    before = member * (names < pivot)
    linked = np.zeros((n, n), dtype=bool)
    for i in range(0, n, 256):
        part = slice(i, i + 256)
        # enough shared pivots, and this list's is the first of them
        ask = (member[part] @ member.T >= SHARED) & (before[part] @ before.T < 0.5)
        linked[part] = ask & (unit[part] @ unit.T >= COSINE)
    if two is not None:
        linked[:cut, :cut] = linked[cut:, cut:] = False
    np.fill_diagonal(linked, False)
    found = _answer(ids[both], copies[both], linked | linked.T)
    return tuple(found.column(c).to_numpy() for c in found.column_names)


def _around(rows: pa.Table, others: pa.Table | None) -> pa.Table:
    """Numbers of links and one edge for each vector of a block at home and of another block, or of one block."""
    both = [rows] if others is None else [rows, others]
    units = [_unit(t.column("e")) for t in both]
    width = max(x.shape[1] for x in units)
    ids, copies = (np.concatenate([t.column(c).to_numpy() for t in both]) for c in ("vec_id", "copies"))
    unit = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in units])
    cut, linked = len(rows), np.zeros((len(ids), len(ids)), dtype=bool)
    if others is None:
        linked[:] = unit @ unit.T >= COSINE
        linked &= linked.T
        np.fill_diagonal(linked, False)
    else:
        linked[:cut, cut:] = unit[:cut] @ unit[cut:].T >= COSINE
        linked[cut:, :cut] = linked[:cut, cut:].T
    return _answer(ids, copies, linked)


def _at_home(posted: DataFrame, tables: Tables) -> DataFrame:
    """Compare the vectors at home at each pivot with each other and with those that visit it.

    Both are dealt to blocks, first those at home; each pair of blocks of which
    one is at home is a group, so no group outgrows two blocks and visitors are
    not compared with each other.
    """
    key = ["list"]
    posted = posted.withColumn("own_home_", F.col("home") == F.col("pivot")).withColumn("list", F.xxhash64("label", "pivot")).drop("label", "pivot")
    counts = posted.groupBy(*key).agg(F.count_if("own_home_").alias("h_"), F.count_if(~F.col("own_home_")).alias("v_"))
    counts = tables.cut(counts.filter("h_ > 0 and h_ + v_ > 1"), "homes")
    dealt = lookup(posted, counts, key, "vec_id", tables)
    dealt = dealt.withColumn("hb_", F.ceil(F.col("h_") / BLOCK).cast("int")).withColumn("vb_", F.ceil(F.col("v_") / BLOCK).cast("int"))
    spread = F.xxhash64("vec_id", F.lit(7))
    own = F.when(F.col("own_home_"), F.pmod(spread, F.col("hb_"))).otherwise(F.col("hb_") + F.pmod(spread, F.greatest("vb_", F.lit(1))))
    most = F.when(F.col("own_home_"), F.col("hb_") + F.col("vb_")).otherwise(F.col("hb_"))
    dealt = dealt.withColumn("own_", own.cast("int")).withColumn("other_", F.explode(F.sequence(F.lit(0), most - 1)))
    dealt = dealt.withColumn("i_", F.least("own_", "other_")).withColumn("j_", F.greatest("own_", "other_"))

    def group(t: pa.Table) -> pa.Table:
        i, j = t.column("i_")[0].as_py(), t.column("j_")[0].as_py()
        if i == j:
            return _around(t, None)
        own = t.column("own_")
        rows, others = t.filter(pc.equal(own, i)), t.filter(pc.equal(own, j))
        return _around(rows, others) if len(rows) and len(others) else _NONE

    return dealt.select(*key, "vec_id", "copies", "e", "own_", "i_", "j_").groupBy(*key, "i_", "j_").applyInArrow(group, _FOUND)


_FOUND = "vec_id long, links long, root long"
_NONE = pa.table({c: pa.array([], pa.int64()) for c in ("vec_id", "links", "root")})


def _answer(ids: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> pa.Table:
    """Number of links and the smallest vector of the linked part of each vector that has links."""
    links = linked @ copies.astype(np.float64)
    root, most = ids.copy(), np.iinfo(np.int64).max
    has = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(has, has)]
    label = ids[has]
    while len(has):
        lower = np.minimum(label, np.where(linked, label[None, :], most).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    root[has] = label
    keep = links > 0
    return pa.table({"vec_id": ids[keep].astype(np.int64), "links": links[keep].astype(np.int64), "root": root[keep].astype(np.int64)})


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Vectors are compared if their labels are equal and not null.  A vector that
    is null, zero or holds null or non-finite components, or whose vec_id is
    null, links with nothing; vectors of different lengths are compared as if
    the shorter one ended in zeros.  Rows that repeat a vec_id with the same
    vector count as further vectors.  An empty table gives no row.
    """
    tables = Tables(vectors.sparkSession, "vector-dedup")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & sound)
    classes = tables.cut(usable.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    many = min(MOST, max(FEWEST, math.isqrt(n)))
    points = classes.orderBy(F.xxhash64("rep", "label"), "rep").limit(POOL * many).select("e").toArrow().column("e")
    pivots = _thin(_unit(points))[:many] if len(points) else np.zeros((0, 0))
    described = classes.select("label", F.col("rep").alias("vec_id"), "copies", "e").mapInArrow(
        _describe(pivots), f"label {dict(classes.dtypes)['label']}, vec_id long, copies long, e array<double>, near array<int>, home int, visits array<int>"
    )
    described = tables.cut(described, "described")
    posted = described.filter("home < 0").drop("home", "visits").withColumn("pivot", F.explode("near")).withColumn("list", F.xxhash64("label", "pivot"))
    counts = tables.cut(posted.groupBy("list").agg(F.count("*").alias("n_")).filter("n_ > 1"), "lists")
    between_open = block_pairs(lookup(posted, counts, ["list"], "vec_id", tables), "list", "vec_id", _read, _compare, _FOUND, counts, block=BLOCK)
    found = tables.cut(between_open.union(_at_home(described.drop("near").withColumn("pivot", F.explode("visits")), tables)), "found")
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), tables)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    by_class = described.select("vec_id", "copies").join(links, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    by_class = by_class.select(
        F.col("vec_id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    member = usable.join(classes.select("label", "e", "rep"), ["label", "e"]).select("vec_id", "rep").join(by_class, "rep")
    member = member.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(member, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3(spark, sf_dir: str) -> DataFrame:
    """All vectors of the table with their links and components."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (
  SELECT a, MIN(b) AS low FROM reach GROUP BY a
), n AS (
  SELECT a, COUNT(*) AS n FROM l GROUP BY a
)
SELECT vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, LEAST(vec_id, COALESCE(c.low, vec_id)) AS component_id,
  vec_id = LEAST(vec_id, COALESCE(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
