"""Near-duplicate documents by MinHash (operator 7).

One-permutation sketches of 128 bins over five-word shingles, filled up by
optimal densification, are cut into 32 bands of 4 bins.  A document's shingle
hashes are the smallest of each bin, so one hash of each shingle is enough.

1. Documents with the same shingle set form a class, one row from here on; a
   group of copies is one class.
2. Each bucket (equal band) proposes a star: every member with the bucket's
   smallest.  The number of pairs grows with the members, not their square.
3. Proposed pairs are confirmed on full shingle sets, and components are built.
4. A bucket whose members lie in different components may hide a link that the
   star did not propose.  There, and only there, members of different components
   are compared, block against block, by their sketches, and pairs that agree in
   enough bins are confirmed on full sets as well: in one round each member
   proposes its most similar partner, which joins most groups of near copies;
   in a second round all pairs that are left between components and agree in
   enough bins are compared by their whole sets.
5. Components over all links, and over the classes of a doc_id that is given
   with different texts.

At similarity 0.75 a pair shares one of 32 bands of 4 with probability
1 - 5e-6; sketches of such pairs agree in 96 of 128 bins on average with a
deviation of 5, so the 74 asked for in step 4 is over 4 deviations below.  Of
3,000 random pairs at 0.75 to 0.82 with sets of 7 to 300 shingles each, both
found every one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._shared import Tables, block_pairs, components, lookup, salted, slices, small

BITS, ROWS = 7, 4
SKETCH_AGREE = 74
SHINGLE = 5
PERCENT = 75


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = A.word_sets(batch.column("text"), SHINGLE)
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        hashes = np.concatenate([*sets, np.zeros(0, A.U)])
        group = np.repeat(np.arange(len(sets)), counts)
        sketch = A.densify(*A.bin_minima(hashes, group, len(sets), BITS))
        sums = np.zeros((2, len(hashes) + 1), dtype=A.U)
        np.cumsum(A.mix(hashes), out=sums[0, 1:])
        np.cumsum(A.mix(hashes ^ A.U(0x5851F42D4C957F2D)), out=sums[1, 1:])
        ends = np.concatenate([[0], np.cumsum(counts)])
        key = (sums[:, ends[1:]] - sums[:, ends[:-1]]).astype(np.int64)
        empty = counts == 0
        small = np.ascontiguousarray(sketch.astype(np.uint16))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("version"), pa.array(counts), pa.array(key[0]), pa.array(key[1]),
                A.list_array(A.band_hashes(sketch, ROWS), (1 << BITS) // ROWS, empty),
                pa.array([None if e else r.tobytes() for e, r in zip(empty.tolist(), small, strict=True)], pa.binary()),
            ],
            names=["doc_id", "version", "n_shingles", "k1", "k2", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = A.word_sets(batch.column("text"), SHINGLE)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "words"])


def _confirm(percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), A.U), np.frombuffer(y.as_buffer(), A.U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = A.in_both(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return fn


def confirm(pairs: DataFrame, sets: DataFrame, tables: Tables, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sets (id, words) have a Jaccard index of at least ``percent``; one a may have very many b."""
    joined = salted(pairs, sets.select(F.col("id").alias("a"), F.col("words").alias("x")), ["a"], "b", tables)
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def _prepare(t: pa.Table):
    """Columns of a group's rows, their sketches, and whole sets where they are given."""
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(t.num_rows, 1 << BITS)
    sets = [np.frombuffer(x, A.U) for x in t.column("words").to_pylist()] if "words" in t.column_names else None
    return *(t.column(c).to_numpy() for c in ("node", "component", "n_shingles", "number", "center")), sketch, sets


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = A.in_both(x, y)
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _across(prepared, one: np.ndarray, two: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket from different components whose sketches agree in enough bins.

    A pair is proposed by the first band that it shares, and not by the bucket
    whose star has proposed it.  Without whole sets, each row proposes its most
    similar partner only; with them, all pairs are returned that they link.
    """
    node, component, size, number, center, sketch, sets = prepared
    bands, other = (1 << BITS) // ROWS, one if two is None else two
    here, hub = number[one[0]], center[one[0]]
    agree = np.zeros((len(one), len(other)), dtype=np.int16)
    for i in range(0, len(one), 64):
        part = one[i : i + 64]
        fit = np.minimum.outer(size[part], size[other]) * 100 >= PERCENT * np.maximum.outer(size[part], size[other])
        fit &= (component[part][:, None] != component[other][None, :]) & (node[part] != hub)[:, None] & (node[other] != hub)[None, :]
        if two is None:
            fit &= np.arange(i, i + len(part))[:, None] < np.arange(len(other))[None, :]
        r, c = np.nonzero(fit)
        for j in range(0, len(r), 1 << 14):
            rr, cc = r[j : j + (1 << 14)], c[j : j + (1 << 14)]
            same = sketch[part[rr]] == sketch[other[cc]]
            first = same.reshape(len(rr), bands, ROWS).all(axis=2).argmax(axis=1) == here
            agree[i + rr, cc] = same.sum(axis=1) * first
    enough = agree >= SKETCH_AGREE
    if sets is None and enough.size:
        top = np.zeros_like(enough)
        top[np.arange(len(agree)), agree.argmax(axis=1)] = True
        top[agree.argmax(axis=0), np.arange(agree.shape[1])] = True
        enough &= top
    r, c = np.nonzero(enough)
    if sets is not None:
        linked = np.array([_linked(sets[one[x]], sets[other[y]]) for x, y in zip(r.tolist(), c.tolist(), strict=True)], dtype=bool)
        r, c = r[linked], c[linked]
    a, b = node[one[r]], node[other[c]]
    return np.minimum(a, b), np.maximum(a, b)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents whose shingle sets have 100 * intersection >= 75 * union.

    Returns doc_id, n_shingles, component_id (smallest doc_id that links reach)
    and kept, one row for each row of ``docs`` (doc_id, text; other columns are
    not read, whatever their names).  Null and blank texts have no shingle and
    stand alone.  Rows with a null doc_id stand alone with a null component and
    are kept.  Rows repeated under one doc_id are one document: what any of
    their texts links with is linked with it, n_shingles is that of the row.
    An empty table gives none.
    """
    tables = Tables(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    # equal rows under one doc_id are told apart only where they are dealt over tasks
    docs = docs.withColumn("row_", F.monotonically_increasing_id())
    seen = docs.mapInArrow(_describe, "doc_id long, version long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")
    seen = tables.cut(seen, "seen")
    own, same = ["doc_id", "version"], ["k1", "k2", "n_shingles"]
    repeated = not seen.groupBy(*own).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    linked = seen.filter("doc_id is not null and n_shingles > 0")
    once = linked.dropDuplicates(own) if repeated else linked
    # a class, its number and the first document that has its set
    classes = linked.groupBy(*same).agg(F.min(F.struct(*own)).alias("rep")).select(*same, "rep.*")
    classes = tables.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = tables.cut(salted(linked.select("doc_id", *same), classes.select(*same, "node"), same, "doc_id", tables).select("doc_id", "node"), "member")
    reps = lookup(once.select(*own, "n_shingles", "bands", "sketch"), classes.select(*own, "node"), own, "version", tables)

    bands = reps.select("node", F.posexplode("bands").alias("number", "band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("n_")).filter("center < last")
    shared = tables.cut(shared.drop("last"), "shared")
    buckets = tables.cut(lookup(bands, shared, ["band"], "node", tables).drop("n_").distinct(), "buckets")
    tested = tables.cut(buckets.filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Whole sets (id, words) of nodes, each once."""
        asked = tables.cut(classes.join(small(tables.cut(nodes.distinct(), "nodes")), "node").select(*own, "node"), "asked")
        texts = lookup(docs, asked, own, "row_", tables)
        if repeated:
            texts = texts.dropDuplicates(["node"])
        return tables.cut(texts.mapInArrow(_sets, "id long, words binary"), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node"))

    links = tables.cut(confirm(tested, sets_of(ends(tested)), tables), "links")
    several = member.distinct().groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    several = member.distinct().join(several, "doc_id").select("a", F.col("node").alias("b"))
    found = tables.cut(components(links.union(several), tables), "components")
    active = None
    for whole in (False, True):
        labelled = lookup(buckets, found, ["node"], "band", tables, "left")
        labelled = labelled.select("band", "number", "node", "center", F.coalesce("component", "node").alias("component"))
        if active is not None:
            labelled = labelled.join(small(active), "node", "left_semi")
        labelled = tables.cut(labelled, "labelled")
        mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_"))
        mixed = tables.cut(mixed.filter("lo < hi").select("band", "n_"), "mixed")
        if mixed.isEmpty():
            break
        asked = tables.cut(lookup(labelled, mixed, ["band"], "node", tables), "asked")
        members = tables.cut(asked.select("node").distinct(), "members")
        known = reps.select("node", "n_shingles", "sketch").join(small(members), "node", "left_semi").dropDuplicates(["node"])
        if whole:
            known = known.join(sets_of(members).withColumnRenamed("id", "node"), "node")
        rows = asked.join(tables.cut(known, "known"), "node")
        pairs = block_pairs(rows, "band", "node", _prepare, _across, "a long, b long", mixed).distinct()
        pairs = tables.cut(pairs, "pairs")
        if not whole:
            active = tables.cut(ends(pairs).distinct(), "active")
            pairs = tables.cut(pairs.join(tested, ["a", "b"], "left_anti"), "untested")
            pairs = tables.cut(confirm(pairs, sets_of(ends(pairs)), tables), "more")
        if not pairs.isEmpty():
            found = tables.cut(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(pairs), tables), "components")

    # classes of one component, and through them documents, get the smallest doc_id of it
    placed = classes.select("node", "doc_id").join(small(found), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = tables.cut(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    placed = tables.cut(lookup(placed.select("node", "component"), least, ["component"], "node", tables).select("node", "component_id"), "placed")
    of = lookup(member, placed, ["node"], "doc_id", tables).select("doc_id", "component_id").distinct()
    rows = seen.select("doc_id", "n_shingles").withColumn("row_", F.monotonically_increasing_id())
    out = salted(rows, tables.cut(of, "of"), ["doc_id"], "row_", tables, "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id")).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents of the table, with their near-duplicate group."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
