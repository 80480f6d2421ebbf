"""Exact top-k search on an impact-ordered index (operator 1).

A vector is a document whose terms are its dimensions: component x becomes the
integer floor(64 * x), the impact of the vector on that dimension.  Impacts are
quantised by magnitude to 8 levels with about equal numbers of postings.  Rows
are dealt to blocks, and the index of a block is built once and written to the
shared folder: for each level and dimension the list of the block's rows whose
impact has that level, with the impacts (a posting segment), segments in order
of descending level, and for some levels the length of what is left of each
vector below it.

A batch of queries walks the segments of a block, largest impacts first, and
adds impact times query component to the accumulators of the rows listed;
dimensions in which no query of the batch has a component are skipped.  At each
of these places every score is known up to the length of the query times what is
left of the vector.  A query's k-th best lower bound is its threshold, and
processing stops as soon as the rows whose upper bound reaches it are few; these
possible members are rescored exactly.  If that never happens the last segment
leaves exact scores.  No row is left out without that proof.

On vectors whose components are all of about one size (unit vectors of 64
components, say) the bounds prove little before nearly all segments are
processed; the index then does the work of a full product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Tables

SCALE, K, EVERY = 64, 20, 20
#: Queries and rows of a group; a row's place in its block must fit 16 bits.
QUERY_BLOCK, BLOCK = 8192, 8192
BATCH = 64
LEVELS = 8
#: Levels after which the bounds are tried.
STOPS = (6, 7, 8)
#: What a sum of n products in single precision may be off, as a share of the lengths of both vectors: n + 8 times this,
#: twice the bound for n roundings, those of both factors and of the product.
ROUND = 2.0**-23
#: Rescoring starts when this share of a block's rows is still possible.
FEW = 0.05
PROBE = 8
#: Vectors, segments (level from the highest, dimension, end of its list), lists of rows, their impacts, and rests of a block.
_INDEX = "j int, width int, vec_id binary, vectors binary, segments binary, lists binary, impacts binary, rests binary"


def _matrix(t: pa.Table) -> np.ndarray:
    """Rows of integers; what a shorter vector lacks is 0."""
    flat = t.column("q").combine_chunks()
    lengths = flat.value_lengths().to_numpy()
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat.flatten().to_numpy()
    return out


def _build(t: pa.Table) -> pa.Table:
    """The index of a block, as one row."""
    ids, x = t.column("vec_id").to_numpy(), _matrix(t)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    row, dim = np.nonzero(x)
    impact = x[row, dim]
    size = np.abs(impact)
    edges = np.sort(size)[(np.arange(1, LEVELS) * len(size)) // LEVELS] if len(size) else np.zeros(LEVELS - 1)
    level = LEVELS - 1 - np.searchsorted(edges, size, side="right")  # 0 is the highest
    by = np.lexsort((row, dim, level))
    row, dim, impact, level = row[by], dim[by], impact[by], level[by]
    last = np.flatnonzero(np.concatenate([(dim[1:] != dim[:-1]) | (level[1:] != level[:-1]), [True]])) if len(row) else np.zeros(0, int)
    rests = []
    for stop in STOPS:
        left = np.zeros(len(ids))
        np.add.at(left, row[level >= stop], impact[level >= stop] ** 2)
        rests.append(np.sqrt(left) + (x.shape[1] + 8) * ROUND * np.sqrt((x**2).sum(axis=1)))
    cells = [ids.astype("<i8"), x.astype("<f8"), np.stack([level[last], dim[last], last + 1]).astype("<i8"), row.astype("<u2"), impact.astype("<f4"), np.array(rests, "<f8")]
    names = ("vec_id", "vectors", "segments", "lists", "impacts", "rests")
    return pa.table(
        {"j": pa.array([t.column("j")[0].as_py()], pa.int32()), "width": pa.array([x.shape[1]], pa.int32())}
        | {name: pa.array([c.tobytes()], pa.binary()) for name, c in zip(names, cells, strict=True)}
    )


class ImpactIndex:
    """A block's index as it was written."""

    def __init__(self, t: pa.Table) -> None:
        read = lambda name, kind: np.frombuffer(t.column(name)[0].as_py(), kind)
        self.ids = read("vec_id", "<i8")
        n = len(self.ids)
        self.vectors = read("vectors", "<f8").reshape(n, t.column("width")[0].as_py())
        self.segments = read("segments", "<i8").reshape(3, -1)
        self.lists, self.impacts = read("lists", "<u2").astype(np.intp), read("impacts", "<f4")
        self.rests = read("rests", "<f8").reshape(len(STOPS), n)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query the rows that may be among its best k, never those with ``own`` (query x row)."""
        n, length = len(self.vectors), np.sqrt((queries**2).sum(axis=1))
        scores = np.zeros((n, len(queries)), dtype=np.float32)
        parts = np.ascontiguousarray(queries.T, dtype=np.float32)
        used = parts.any(axis=1).tolist()
        levels, dims, ends = self.segments
        begin, at, possible = 0, 0, ~own
        for stop, rest in zip(STOPS, self.rests, strict=True):
            upto = int(np.searchsorted(levels, stop))
            for dim, end in zip(dims[at:upto].tolist(), ends[at:upto].tolist(), strict=True):
                if dim < len(used) and used[dim]:
                    rows = self.lists[begin:end]
                    more = np.multiply.outer(self.impacts[begin:end], parts[dim])
                    more += scores.take(rows, axis=0)
                    scores[rows] = more
                begin = end
            at = upto
            # a few queries tell whether the bounds are worth trying on the whole batch
            for part in (slice(0, PROBE), slice(None)):
                slack, known = length[part, None] * rest[None, :], scores.T[part].astype(np.float64)
                low = np.where(own[part], -np.inf, known - slack)
                threshold = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
                possible = (known + slack + 1e-6 >= threshold[:, None]) & ~own[part]
                few = possible.sum() <= FEW * possible.size
                if not few and stop < LEVELS:
                    break
            if few:
                break
        return [np.flatnonzero(p) for p in possible]


def _search(k: int):
    def fn(asks: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(asks) and len(blocks):
            index, ids, queries = ImpactIndex(blocks), asks.column("vec_id").to_numpy(), _matrix(asks)
            width = min(queries.shape[1], index.vectors.shape[1])
            exact = index.vectors[:, :width].astype(np.int64)
            for i in range(0, len(queries), BATCH):
                part, asked = queries[i : i + BATCH], ids[i : i + BATCH]
                for q, own, members in zip(part, asked, index.search(part, asked[:, None] == index.ids[None, :], k), strict=True):
                    score = exact[members] @ q[:width].astype(np.int64)
                    best = np.argsort(-score, kind="stable")[:k]
                    out[0].append(np.full(len(best), own))
                    out[1].append(index.ids[members[best]])
                    out[2].append(score[best])
        query, vec, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in out)
        return pa.table({"query_id": query, "vec_id": vec, "score": score})

    return fn


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best of each query by integer inner product.

    ``vectors`` has vec_id and embedding (other columns are not read, whatever
    their names); queries are the rows whose vec_id is divisible by ``every``,
    candidates all rows with another vec_id.  Ties go to the smaller vec_id.
    Rows with a null vec_id, and vectors that are null or hold null or
    non-finite components, take no part; components that a shorter vector lacks
    count as 0.  A row that is repeated is a candidate as often as it is given;
    as a query equal rows are one, and different vectors of one query_id are
    ranked together.  Fewer candidates than ``k`` are all returned; no query, no
    row.
    """
    tables = Tables(vectors.sparkSession, "top-k")
    numbers = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = numbers.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & whole)
    q = F.transform("e", lambda x: F.floor(x * float(scale)).cast("double")).alias("q")
    rows = tables.cut(numbers.select("vec_id", q, F.monotonically_increasing_id().alias("row")), "rows")
    asks = tables.cut(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "q").distinct(), "queries")
    query_blocks, blocks = (max(1, -(-t.count() // size)) for t, size in ((asks, QUERY_BLOCK), (rows, BLOCK)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = tables.cut(rows.select("vec_id", "q", deal("row", blocks).alias("j")).groupBy("j").applyInArrow(_build, _INDEX), "index")
    left = asks.select("vec_id", "q", deal("vec_id", query_blocks).alias("i"), each(blocks).alias("j"))
    right = index.withColumn("i", each(query_blocks))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector of the table."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0) a JOIN v b ON a.vec_id <> b.vec_id
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
