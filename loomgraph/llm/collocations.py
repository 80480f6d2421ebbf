"""Phrase collocation mining (operator 12).

A phrase is counted only where all its parts may be frequent (Apriori), level by
level.  Words, and phrases of 2 to ``longest`` words, are counted like this:

1. mappers cut texts into words and bincount the phrases of a slice; what can't
   be frequent is left out by a bit table of the frequent shorter phrases.  That
   table has a fixed size, so it errs on the safe side: it may let a phrase pass,
   and never loses one;
2. a phrase goes to one of many segments by its hash.  Within a segment,
   candidates are the phrases whose hash bucket has enough occurrences in all.
   A minimal perfect hash gives each candidate a slot, at which its words are
   stored; each mapper's counts are added by slot after the stored words are
   compared, and the arrays of counts are summed as a tree;
3. the counts of a cut's two parts are looked up among the shorter phrases.

Words are known by 64-bit keys of language and word.  All words are counted as
text first, and if two of them had one key, another seed is taken; so a phrase is
the list of its words' keys, exactly.  Segments are as many as the words ask for,
so a task's memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._shared import Tables, lookup, salted, slices
from .pieces import groups, ragged

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
SLICE = 4 << 20  # bytes of text that a mapper counts at once
SEGMENT = 1 << 20  # phrases of a segment, about
BITS, CHUNK = 26, 18  # of the table of frequent phrases, and of a part of it
SEEDS = 8
PARTS = 64  # of a language, whose best phrases are found first
U = np.uint64

_KIND = np.ones(256, dtype=np.uint8)  # 1: of a word, 0: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 0
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: n keys have the slots 0 to n - 1.

    At each level, keys that are alone at their place in a bit array stay there,
    and the others go on to the next level; a key's slot is the number of bits
    before its own.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.n, self.levels = len(keys), []
        before = 0
        while len(keys):
            size = 2 * len(keys) + 1
            place = self._place(keys, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, before + np.cumsum(alone) - 1))
            before += int(alone.sum())
            keys = keys[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (A.mix(keys ^ U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; one that is not a member has any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(keys[rest], level, len(alone))
            hit = alone[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        return out


def phrase_hash(keys: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, given the keys of their first words, second words and so on."""
    total = np.full(len(keys[0]), len(keys), dtype=U)
    for k in keys:
        total = A.mix(total * U(0xD1342543DE82EF95) ^ k)
    return total


@dataclass
class Words:
    """The words of a slice: keys, places in ``data``, language codes, and how many follow in the piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray
    key: np.ndarray
    joined: np.ndarray  # whether the next word follows within the piece


def _words(batch: pa.RecordBatch, seed: int) -> tuple[Words, pa.Array]:
    data, offsets, _ = A.flat(batch.column("text"))
    data = A.LOWER[data]
    kind = _KIND[data]
    start, end = A.spans(kind == 1, offsets)
    langs = batch.column("lang").dictionary_encode()
    names, _, _ = A.flat(langs.dictionary)
    edges = np.cumsum([0, *[len(x.encode()) for x in langs.dictionary.to_pylist()]])
    text = A.owner(offsets, start)
    lang = langs.indices.to_numpy()[text]
    mark = A.byte_hash(names, edges[:-1], edges[1:], seed + 1)
    key = A.mix(A.byte_hash(data, start, end, seed) ^ (mark * U(0x94D049BB133111EB))[lang])
    ends = np.concatenate([[0], np.cumsum(kind == 2)])
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (text[1:] == text[:-1]) & (ends[start[1:]] == ends[start[:-1]])
    return Words(data, start, end, lang, key, joined), langs.dictionary


def _count_words(seed: int):
    most = SLICE

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            w, langs = _words(batch, seed)
            if not len(w.key):
                continue
            _, first, inverse = groups(w.key)
            n = w.end - w.start
            lead = first[inverse]
            same = (n == n[lead]) & (w.lang == w.lang[lead])
            same[same] = A.same_spans(w.data, w.start[same], w.start[lead[same]], n[same])
            times = np.bincount(inverse[same], minlength=len(first))
            # words that only share a key with another are given one by one, and the keys are then seen to clash
            rows = np.concatenate([first, np.flatnonzero(~same)])
            counts = np.concatenate([times, np.ones(int((~same).sum()), np.int64)])
            text = w.data[ragged(w.start[rows], n[rows])]
            at = np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(rows), pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(w.lang[rows])), words, pa.array(w.key[rows].view(np.int64)), pa.array(counts)], names=["lang", "word", "k1", "n"]
            )

    return fn


class Bits:
    """The bit table of a level: whether a hash may belong to a frequent phrase."""

    def __init__(self, parts: list[tuple[int, bytes]], size: int, part: int) -> None:
        self.mask, self.bits = U((1 << size) - 1), np.zeros(1 << (size - 3), dtype=np.uint8)
        for chunk, raw in parts:
            self.bits[chunk << (part - 3) : (chunk + 1) << (part - 3)] = np.frombuffer(raw, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = (h & self.mask).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def frequent_bits(hashes: DataFrame) -> Bits:
    """Bit table of a column ``h`` of hashes; its size, 8 MB, does not depend on how many there are."""
    size, part = BITS, CHUNK

    def fn(t: pa.Table) -> pa.Table:
        place = (t.column("h").to_numpy().view(U) & U((1 << part) - 1)).astype(np.int64)
        marks = np.zeros(1 << part, dtype=bool)
        marks[place] = True
        return pa.table({"chunk": t.column("chunk")[:1], "raw": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    chunk = F.shiftrightunsigned("h", part).cast("int")
    places = hashes.select(F.col("h").bitwiseAND(F.lit((1 << size) - 1)).alias("h")).distinct().withColumn("chunk", chunk)
    parts = places.groupBy("chunk").applyInArrow(fn, "chunk int, raw binary").collect()
    return Bits([(r["chunk"], bytes(r["raw"])) for r in parts], size, part)


def _emit(width: int, seed: int, segments: int, known: list) -> Callable:
    """Phrases of ``width`` words of each slice with their number there, packed by segment."""
    most = SLICE

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b.value for b in known]
        for batch in slices(batches, "text", most):
            w, _ = _words(batch, seed)
            n = len(w.key) - width + 1
            if n <= 0:
                continue
            distinct, _, number = groups(w.key)
            m = len(distinct)
            usable = tables[0](distinct)[number]
            at = np.flatnonzero(usable)
            # code: number of the phrase of the first ``size`` words from a place on
            code = number
            for size in range(2, width + 1):
                at = at[at + size <= len(w.key)]
                at = at[w.joined[at + size - 2] & usable[at + size - 1]]
                pair = code[at] * m + number[at + size - 1]
                values, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
                places = at[first]
                if size < width:
                    # a phrase goes on only if it may be frequent, and so only where both its ends may be
                    good = tables[size - 1](phrase_hash([w.key[places + i] for i in range(size)]))
                    stay = good[inverse]
                    usable_from = np.zeros(len(w.key), dtype=bool)
                    usable_from[at[stay]] = True
                    code = np.zeros(len(w.key), dtype=np.int64)
                    code[at] = inverse
                    at = at[stay]
                    at = at[at + size < len(w.key)]
                    at = at[usable_from[at + 1]]
                else:
                    counts = np.bincount(inverse, minlength=len(values))
            if not len(at):
                continue
            keys = [w.key[places + i] for i in range(width)]
            h = phrase_hash(keys)
            order = np.argsort(h)
            h = h[order]
            segment = ((h >> U(32)) * U(segments) >> U(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
            offsets = lambda size: pa.py_buffer((edges * size).astype(np.int32).tobytes())
            packed = [pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets(8), pa.py_buffer(k[order].tobytes())]) for k in keys]
            packed.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets(4), pa.py_buffer(counts[order].astype(np.uint32).tobytes())]))
            names = [*(f"k{i + 1}" for i in range(width)), "n"]
            yield pa.RecordBatch.from_arrays([pa.array(segment[edges[:-1]]), *packed], names=["segment", *names])

    return fn


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    """Sum of arrays of one size, pair by pair."""
    while len(arrays) > 1:
        arrays = [arrays[i] + arrays[i + 1] if i + 1 < len(arrays) else arrays[i] for i in range(0, len(arrays), 2)]
    return arrays[0]


def candidates(keys: list[np.ndarray], h: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Places of the first occurrence of each phrase whose hash bucket has ``least`` occurrences in all."""
    size = 1 << max(8, int(len(h)).bit_length() + 1)
    bucket = (h & U(size - 1)).astype(np.int64)
    likely = np.flatnonzero(np.bincount(bucket, weights=counts, minlength=size)[bucket] >= least)
    order = likely[np.lexsort([*(k[likely] for k in keys), h[likely]])]
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = h[order[1:]] != h[order[:-1]]
        for k in keys:
            fresh[1:] |= k[order[1:]] != k[order[:-1]]
    return order[fresh]


def count_segment(parts: list[tuple[list[np.ndarray], np.ndarray]], least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys, counts and hashes of the phrases of a segment with ``least`` occurrences in all ``parts`` together.

    A part has the key columns of its phrases and their counts.
    """
    width = len(parts[0][0])
    keys = [np.concatenate([p[0][i] for p in parts]) for i in range(width)]
    counts, h = np.concatenate([p[1] for p in parts]).astype(np.int64), phrase_hash(keys)
    members = candidates(keys, h, counts, least)
    # phrases that share their hash are told apart by another hash, of which one that separates all is taken
    salt = 0
    while True:
        name = h if not salt else phrase_hash([*keys, np.full(len(h), salt, dtype=U)])
        if len(np.unique(name[members])) == len(members):
            break
        salt += 1
    index = PerfectHash(name[members])
    slot = index.slots(name[members])
    stored = [np.empty(len(members), dtype=U) for _ in range(width)]
    hashes = np.empty(len(members), dtype=U)
    for own, k in zip([*stored, hashes], [*keys, h], strict=True):
        own[slot] = k[members]
    step, arrays = 1 << 19, [np.zeros(len(members), dtype=np.int64)]
    for i in range(0, len(h) if len(members) else 0, step):
        slots = index.slots(name[i : i + step])
        known = slots >= 0
        for own, k in zip(stored, keys, strict=True):
            known &= own[slots] == k[i : i + step]
        # sums below 2**53 are exact in double precision
        arrays.append(np.bincount(slots[known], weights=counts[i : i + step][known], minlength=len(members)).astype(np.int64))
        if len(arrays) == 8:
            arrays = [tree_sum(arrays)]
    total = tree_sum(arrays)
    often = total >= least
    return [k[often] for k in stored], total[often], hashes[often]


def _reduce(width: int, least: int) -> Callable[[pa.Table], pa.Table]:
    def fn(t: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(t.column(f"k{i + 1}").to_pylist()), U) for i in range(width)]
        keys, total, h = count_segment([(columns, np.frombuffer(b"".join(t.column("n").to_pylist()), np.uint32))], least)
        names = [f"k{i + 1}" for i in range(width)]
        return pa.table({**{c: k.view(np.int64) for c, k in zip(names, keys, strict=True)}, "f": total, "h": h.view(np.int64)})

    return fn


def phrase_counts(docs: DataFrame, tables: Tables, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The frequent words (lang, word, k1, f, n: all words of the language), and for each number of words from 1
    to ``longest`` the frequent phrases (k1 and so on, f)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for seed in range(SEEDS):
        counts = rows.mapInArrow(_count_words(seed), "lang string, word string, k1 long, n long")
        words = tables.cut(counts.groupBy("lang", "word", "k1").agg(F.sum("n").alias("f")), "words")
        if words.groupBy("k1").count().filter("count > 1").isEmpty():
            break
    else:
        raise ValueError("no seed tells all words of the table apart")
    sizes = tables.cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = tables.cut(words.filter(F.col("f") >= least), "frequent")
    found = {1: frequent.select("k1", "f")}
    known = [spark.sparkContext.broadcast(frequent_bits(frequent.select(F.col("k1").alias("h"))))]
    segments = max(1, -(-total // SEGMENT))
    for width in range(2, longest + 1):
        names = [f"k{i + 1}" for i in range(width)]
        packed = rows.mapInArrow(_emit(width, seed, segments, list(known)), "segment long, " + ", ".join(f"{c} binary" for c in [*names, "n"]))
        schema = ", ".join(f"{c} long" for c in [*names, "f", "h"])
        level = tables.cut(packed.groupBy("segment").applyInArrow(_reduce(width, least), schema), f"phrases{width}")
        found[width] = level.select(*names, "f")
        known.append(spark.sparkContext.broadcast(frequent_bits(level.select("h"))))
    return frequent.join(sizes, "lang"), found


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best ``top`` phrases of each language (None: all).

    Texts are cut into pieces at . , ; : ! ? and line ends, and those into words
    at spaces and tabs, A-Z in lower case.  a counts the phrase's occurrences
    within pieces, l and r those of its two parts at the cut with the lowest
    score, floor(1000000 * a * a / (l * r)), ties to the shorter first part; n
    counts all words of the language.  A phrase that lies inside a longer
    candidate with at least ``share`` percent of its occurrences is left out.
    Order: score and a descending, phrase ascending by its bytes.

    A null lang is ``und``, a null text is empty; repeated rows and doc_ids count
    as often as they are there, other columns are not read, and an empty table
    gives no row.  Products are exact up to 10**16 occurrences of a phrase.
    """
    if longest < 2:
        raise ValueError("a phrase that can be cut has at least two words")
    tables = Tables(docs.sparkSession, "collocations")
    words, found = phrase_counts(docs, tables, longest, least)
    names = [f"k{i + 1}" for i in range(longest)]
    scored = None
    for width in range(2, longest + 1):
        own = names[:width]
        rows = found[width].withColumnRenamed("f", "a")
        for k in range(1, width):
            for part, column in ((own[:k], f"l{k}"), (own[k:], f"r{k}")):
                table = found[len(part)].select(*[F.col(a).alias(b) for a, b in zip(names, part, strict=False)], F.col("f").alias(column))
                by = next((c for c in own if c not in part), own[0])
                rows = tables.cut(lookup(rows, tables.cut(table, "part"), part, by, tables), "cut")
        exact = lambda c: F.col(c).cast("decimal(19,0)")
        cuts = []
        for k in range(1, width):
            rows = rows.withColumn("above", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", exact(f"l{k}") * exact(f"r{k}"))
            rows = rows.withColumn(f"s{k}", F.expr("above div below")).drop("above", "below")
            cuts.append(F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select(*own, "a", "cut.l", "cut.r", "cut.score")
        inside = None
        for wider in range(width + 1, longest + 1):
            for i in range(wider - width + 1):
                part = found[wider].select(*[F.col(names[i + j]).alias(own[j]) for j in range(width)], "f")
                inside = part if inside is None else inside.union(part)
        if inside is not None:
            # one aggregation brings a phrase and the longer ones around it together
            figures, none = ["a", "l", "r", "score"], F.lit(None).cast("long")
            both = rows.withColumn("most", none).unionByName(inside.select(*own, *[none.alias(c) for c in figures], F.col("f").alias("most")))
            rows = both.groupBy(*own).agg(*[F.max(c).alias(c) for c in [*figures, "most"]])
            rows = rows.filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
        rows = rows.select(*own, *[F.lit(None).cast("long").alias(c) for c in names[width:]], "a", "l", "r", "score")
        scored = rows if scored is None else scored.union(rows)
    scored = tables.cut(scored, "scored")

    label = words.select("k1", "lang", "n")
    rows = salted(scored, label, ["k1"], "k2", tables)
    if top is not None:
        # the best of each part of a language, then of the language, ties included, so that its phrases never meet in one task
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(PARTS)))
        for keys in (["lang", "part"], ["lang"]):
            best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"))
            rows = rows.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place")
        rows = rows.drop("part")
    rows = tables.cut(rows, "best")
    for i, c in enumerate(names):
        rows = salted(rows, words.select(F.col("k1").alias(c), F.col("word").alias(f"w{i}")), [c], "k2" if c == "k1" else "k1", tables, "left")
    rows = tables.cut(rows.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(longest)])), "named")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank.cast("long"))
    rows = rows if top is None else rows.filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents of the table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)
),
f AS MATERIALIZED (
  SELECT lang, k, ws[s : s + k - 1] AS words, count(*) AS f
  FROM t, (SELECT unnest([1, 2, 3]) AS k), unnest(range(1, len(ws) - k + 2)) p(s) GROUP BY ALL
),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND f >= 10),
cut AS (
  SELECT c.lang, c.words, c.k, c.f AS a, x.f AS l, y.f AS r, cc,
         CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c, unnest(range(1, c.k)) q(cc)
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : cc]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[cc + 1 : c.k]
),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cc) = 1),
inside AS (
  SELECT lang, sub, max(f) AS most FROM (SELECT lang, f, unnest([words[1 : 2], words[2 : 3]]) AS sub FROM c WHERE k = 3) GROUP BY lang, sub
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT low.lang, array_to_string(low.words, ' ') AS phrase, a, l, r, n.n, score
      FROM low JOIN n ON n.lang = low.lang LEFT JOIN inside ON inside.lang = low.lang AND inside.sub = low.words
      WHERE most IS NULL OR 100 * most < 50 * a)
QUALIFY rank <= 2000
"""
