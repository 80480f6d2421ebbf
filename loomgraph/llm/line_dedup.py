"""Fuzzy line dedup by MinHash (operator 4).

A line, trimmed and with A-Z in lower case, is the set of its ten-character
shingles (a shorter line is one shingle).  One-permutation sketches of 32 bins
are cut into 10 bands of 3; equal bands make lines candidates, which are
confirmed by the exact Jaccard index, 0.75 or more.  Confirmed links are joined
to components by distributed union-find, and one line of each component stays:
the one with the smallest (doc_id, line number).

Equal lines are one node (a 64-bit hash of the line) before any pair is made; a
second hash tells nodes that different lines share, and these are renamed by it.
As in near_dedup, a bucket first proposes a star around its smallest node, and
buckets that still join different components are then compared block by block,
so no link of a bucket is lost and no group of copies is squared.  A pair at
0.75 shares a band with probability 0.996, one at 0.8 with 0.999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _arrays as A
from ._shared import Tables, block_pairs, boxed, components, lookup, salted, slices, small
from .pieces import groups, ragged

SHINGLE, BITS, ROWS, PERCENT = 10, 5, 3, 75
BREAK = 10
BLANKS = "\t\n\x0b\x0c\r "
MANY = 1 << 20  # lines that are described at once
MOST_PAIRS = 4096  # pairs that one sort takes, under 1 << 16


def _lines(column: pa.Array):
    """Lines of a batch that are not blank: text index, number in the text, start and end in the code points
    of the whole batch, trimmed and in lower case, and the bytes with start and end of each line there."""
    data, offsets, _ = A.flat(column)
    data = A.LOWER[data]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(byte[:-1], offsets)
    start, end = A.spans(cp != BREAK, at)
    text = A.owner(at, start)
    breaks = np.concatenate([[0], np.cumsum(cp == BREAK)])
    number = breaks[start] - breaks[at[text]]
    blank = np.concatenate([A.BLANK[np.minimum(cp, 255)] & (cp < 128), [False]])
    solid = np.concatenate([[0], np.cumsum(~blank[:-1])])
    places = np.append(np.flatnonzero(~blank[:-1]), len(cp))
    full = solid[end] > solid[start]
    start, end, text, number = start[full], end[full], text[full], number[full]
    first, last = places[solid[start]], places[solid[end] - 1] + 1
    return cp, text, number, first, last, data, byte[first], byte[last]


def _shingles(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles with the line of each, from the prefix sums of a batch.

    Lines are in order and do not overlap.  Shingles are hashed at every place
    of the batch at once; the places at which one begins within a line are taken.
    """
    long = end - start >= SHINGLE
    hashes = A.window_hash(sums, SHINGLE)
    hashes[start[~long]] = A.span_hash(sums, start[~long], end[~long])
    change = np.zeros(len(hashes) + 1, dtype=np.int8)
    change[start] = 1
    change[np.where(long, end - SHINGLE, start) + 1] -= 1
    begins = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    return hashes[begins], np.repeat(np.arange(len(start)), np.where(long, end - start - SHINGLE + 1, 1))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with its node and the number of lines of its text; the first line of a batch with a node also has its bands."""
    for batch in slices(batches, "text", 1 << 18):
        cp, text, number, first, last, data, begins, ends = _lines(batch.column("text"))
        sums, of = A.prefix_sums(cp), np.bincount(text, minlength=1)[text]
        for i in range(0, len(first), MANY):
            start, end = first[i : i + MANY], last[i : i + MANY]
            # two hashes of different kinds, which no known texts share both of
            node, check = A.byte_hash(data, begins[i : i + MANY], ends[i : i + MANY]), A.span_hash(sums, start, end)
            _, lead, of_node = groups(node)
            fresh = check != check[lead][of_node]
            fresh[lead] = True
            hashes, line = _shingles(sums, start[fresh], end[fresh])
            bands = A.band_hashes(A.densify(*A.bin_minima_of(hashes, line, int(fresh.sum()), BITS)), ROWS)
            width = bands.shape[1]
            ends = np.concatenate([[0], np.cumsum(fresh) * width]).astype(np.int32)
            own = pa.array(text[i : i + MANY])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(own), batch.column("version").take(own), pa.array(number[i : i + MANY].astype(np.int32)), pa.array(of[i : i + MANY].astype(np.int32)),
                    pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).astype(np.int64))),
                ],
                names=["doc_id", "version", "line", "of", "node", "check", "bands"],
            )


def _line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets of lines that are trimmed and in lower case: 48-bit hashes of the shingles,
    each line's in order and once, and where each line's begin."""
    parts, counts = [], []
    for first in range(0, len(column), 1 << 16):
        data, offsets, _ = A.flat(column[first : first + (1 << 16)])
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
        hashes, line = _shingles(A.prefix_sums(cp), at[:-1], at[1:])
        key = np.sort((line.astype(A.U) << A.U(48)) | (hashes >> A.U(16)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        parts.append(key & A.U((1 << 48) - 1))
        counts.append(np.bincount((key >> A.U(48)).astype(np.int64), minlength=len(offsets) - 1))
    return np.concatenate([*parts, np.zeros(0, A.U)]), np.concatenate([[0], *counts]).cumsum()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of which the lines x and y are linked; each line of a slice is hashed once."""
    for batch in slices(batches, "x", 1 << 18):
        n = batch.num_rows
        lines = pa.concat_arrays([batch.column("x"), batch.column("y")]).dictionary_encode()
        places, begin = _line_sets(lines.dictionary)
        codes, size = lines.indices.to_numpy(), np.diff(begin)
        x, y = codes[:n], codes[n:]
        pair = np.flatnonzero(100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
        common = np.zeros(n, dtype=np.int64)
        for i in range(0, len(pair), MOST_PAIRS):
            own = pair[i : i + MOST_PAIRS]
            both = np.concatenate([x[own], y[own]])
            taken = places[ragged(begin[both], size[both])]
            key = np.sort((np.repeat(np.tile(np.arange(len(own), dtype=A.U), 2), size[both]) << A.U(48)) | taken)
            common[own] = np.bincount((key[1:][key[1:] == key[:-1]] >> A.U(48)).astype(np.int64), minlength=len(own))
        keep = 100 * common >= PERCENT * (size[x] + size[y] - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep & (common > 0)))


def _common(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with each of ``y`` (or of ``x``)."""
    sets, n = [*x, *(y or ())], len(x)
    sizes = [len(s) for s in sets]
    # a hash above the number of its set: sorting brings equal hashes together
    key = np.sort((np.concatenate(sets) << A.U(16)) | np.repeat(np.arange(len(sets), dtype=A.U), sizes))
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] >> A.U(16)) != (key[:-1] >> A.U(16))
    alone = first.copy()
    alone[:-1] &= first[1:]
    first = first[~alone]
    owner = (key[~alone] & A.U(0xFFFF)).astype(np.int64)
    place, total = np.cumsum(first) - 1, int(first.sum())
    out = np.zeros((n, len(y) if y is not None else n))
    step = max(1, min(total, (1 << 22) // max(len(sets), 1)))
    for low in range(0, total, step):
        lo, hi = np.searchsorted(place, [low, low + step])
        member = np.zeros((len(sets), step), dtype=np.float32)
        member[owner[lo:hi], place[lo:hi] - low] = 1
        out += member[:n] @ (member if y is None else member[n:]).T
    if y is None:
        np.fill_diagonal(out, sizes)
    return out


def _read(t: pa.Table):
    """Nodes, components, and for each row its set and the size of it; a node's set is hashed once."""
    node = t.column("node").to_numpy()
    _, first, spot = np.unique(node, return_index=True, return_inverse=True)
    places, begin = _line_sets(t.column("words").take(pa.array(first)).combine_chunks())
    sets = [places[i:j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return node, t.column("component").to_numpy(), [sets[k] for k in spot.tolist()], np.diff(begin)[spot]


def _across(prepared, one: np.ndarray, two: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between lines of different components, by their full sets.

    Of the links found, those that join components which the block's earlier
    ones leave apart are returned: fewer than its rows, with the same closure.
    """
    node, component, sets, size = prepared
    other = one if two is None else two
    common = _common([sets[k] for k in one.tolist()], None if two is None else [sets[k] for k in two.tolist()])
    linked = 100 * common >= PERCENT * (size[one][:, None] + size[other][None, :] - common)
    linked &= component[one][:, None] != component[other][None, :]
    if two is None:
        linked = np.triu(linked, 1)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    a, b = [], []
    for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
        x, y = root(int(component[one[i]])), root(int(component[other[j]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            a.append(min(int(node[one[i]]), int(node[other[j]])))
            b.append(max(int(node[one[i]]), int(node[other[j]])))
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        texts, totals, stay, solid = [], [], [], []
        for text, kept in zip(batch.column("text").to_pylist(), batch.column("kept_").to_pylist(), strict=True):
            lines, kept = text.split("\n"), set(kept or ())
            out = [x for i, x in enumerate(lines) if i in kept or not x.strip(BLANKS)]
            texts.append("\n".join(out)), totals.append(len(lines)), stay.append(len(out)), solid.append(len(kept))
        numbers = [pa.array(x, pa.int64()) for x in (totals, stay, solid)]
        yield pa.RecordBatch.from_arrays([batch.column("box_"), *numbers, pa.array(texts, pa.string())], names=["box_", "n_lines", "n_kept", "n_solid", "text"])


def _normal(line: Column) -> Column:
    """A line as it is compared: trimmed, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())


def keepers(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, version and the numbers of the lines that stay (null: none), for documents that lose any.

    ``docs`` has doc_id, version (a hash of the text) and text.
    """
    docs = docs.filter("doc_id is not null")
    own = ["doc_id", "version"]
    lines = tables.cut(docs.mapInArrow(_describe, "doc_id long, version long, line int, of int, node long, check long, bands array<long>"), "lines")
    place = F.min(F.struct(*own, "line")).alias("place")
    first = tables.cut(lines.groupBy("node").agg(place, (F.min("check") != F.max("check")).alias("clash")).select("node", "place.*", "clash"), "first")
    clash = tables.cut(first.filter("clash").select("node", F.lit(True).alias("clash")), "clash")
    first = first.drop("clash")
    if not clash.isEmpty():  # different lines share a node
        named = lookup(lines, clash, ["node"], "line", tables, "left")
        lines = tables.cut(named.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash"), "renamed")
        first = tables.cut(lines.groupBy("node").agg(place).select("node", "place.*"), "first")
    bands = lines.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("n_")).filter("center < last")
    shared = tables.cut(shared.drop("last"), "shared")
    # a line that every slice of the table holds has a row for each of them, which must not meet before they are one
    asked = bands if small(shared) is not shared else bands.distinct()
    buckets = tables.cut(lookup(asked, shared, ["band"], "node", tables).drop("n_").distinct(), "buckets")
    totals = tables.cut(lines.groupBy(*own).agg(F.max("of").alias("n_")), "totals")
    tables.drop(lines)
    stars = tables.cut(buckets.filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    wanted = tables.cut(first.join(small(tables.cut(buckets.select("node").distinct(), "nodes")), "node"), "wanted")
    asked = docs.join(small(tables.cut(wanted.select(*own).distinct(), "asked")), own, "left_semi")
    places = wanted.groupBy(*own).agg(F.collect_list(F.struct("line", "node")).alias("places"))
    parts = asked.join(places, own).select("places", F.split("text", "\n").alias("parts"))
    line = lambda x: F.struct(x["node"].alias("id"), _normal(F.element_at("parts", x["line"] + 1)).alias("words"))
    sets = tables.cut(parts.select(F.explode(F.transform("places", line)).alias("l")).select("l.*").dropDuplicates(["id"]), "sets")
    pairs = salted(stars, sets.select(F.col("id").alias("a"), F.col("words").alias("x")), ["a"], "b", tables)
    pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
    links = tables.cut(pairs.mapInArrow(_confirm, "a long, b long"), "links")
    near = tables.cut(components(links, tables), "near")

    labelled = lookup(buckets, near, ["node"], "band", tables, "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    labelled = tables.cut(labelled, "labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_"))
    mixed = tables.cut(mixed.filter("lo < hi and n_ > 2").select("band", "n_"), "mixed")
    found = near
    if not mixed.isEmpty():
        rest = lookup(labelled, mixed, ["band"], "node", tables).join(sets.withColumnRenamed("id", "node"), "node")
        more = block_pairs(rest, "band", "node", _read, _across, "a long, b long", mixed, block=500).distinct()
        again = near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
        found = tables.cut(components(again, tables), "components")

    linked = first.join(small(found), "node").groupBy("component").agg(F.min(F.struct(*own, "line")).alias("place")).select("place.*")
    alone = first.join(small(found), "node", "left_anti").select(*own, "line")
    kept = alone.union(linked).groupBy(*own).agg(F.collect_list("line").alias("kept_"))
    lossy = totals.join(kept, own, "left").filter(F.col("kept_").isNull() | (F.size("kept_") < F.col("n_")))
    return tables.cut(lossy.select(*own, "kept_"), "kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text rewritten to the lines that stay, and three columns about its lines.

    n_lines counts the lines of the text, n_kept those that stay, blank ones
    too, n_solid those that stay and are not blank.  Columns of ``docs`` with
    these names are replaced; any other passes through, whatever its name.

    Blank lines always stay.  A null text stays null and has no line; rows with
    a null doc_id are left as they are.  Equal rows under one doc_id are one
    document given twice and keep the same lines; different texts under one
    doc_id are different documents, of which the order of their hashes decides
    which comes first.  An empty table gives an empty one.
    """
    tables = Tables(docs.sparkSession, "line-dedup")
    added = ["n_lines", "n_kept", "n_solid"]
    columns = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("text", F.col("text").cast("string"))
    rows = boxed(docs, "text").withColumns({"doc_id": F.col("box_.doc_id").cast("long"), "version": F.xxhash64("text")})
    kept = keepers(rows.select("doc_id", "version", "text"), tables)
    ids = small(tables.cut(kept.select("doc_id", "version"), "lossy"))
    lossy = rows.join(ids, ["doc_id", "version"], "left_semi").join(kept, ["doc_id", "version"]).select("box_", "text", "kept_")
    schema = StructType([lossy.schema["box_"], *[StructField(c, LongType()) for c in added], StructField("text", StringType())])
    # the texts of all others stay as they are and are not shuffled
    whole = rows.join(ids, ["doc_id", "version"], "left_anti").withColumn("lines_", F.split("text", "\n"))
    n = F.coalesce(F.size("lines_"), F.lit(0)).cast("long")
    full = F.coalesce(F.size(F.filter("lines_", lambda x: F.btrim(x, F.lit(BLANKS)) != "")), F.lit(0)).cast("long")
    out = whole.select("box_", F.greatest(n, F.lit(0)).alias("n_lines"), F.greatest(n, F.lit(0)).alias("n_kept"), F.greatest(full, F.lit(0)).alias("n_solid"), "text")
    out = out.union(lossy.mapInArrow(_rewrite, schema))
    return out.select(*[F.col("text") if c == "text" else F.col("box_").getField(c).alias(c) for c in columns if c != "text"], *added, "text")


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents of the table with the lines that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")
