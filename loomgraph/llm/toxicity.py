"""Toxicity by weak supervision (operator 8).

Voters are lexicon entries and patterns.  The lexicon is mined from a bounded
sample of labelled documents: words, and prefixes of words of 4 to 7 letters
(which catch inflected forms that the sample lacks), that are far more frequent
in toxic texts.  A generative label model then estimates, by expectation
maximisation, how often each voter fires on either class; voters that fire
together beyond what the class explains are correlated, and each voter's
evidence is divided by its correlations, so ten forms of one word do not count
ten times.  The posterior labels train a logistic regression on the votes,
which scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._shared import crc32_text, slices
from .pieces import LETTER, classes

#: At most so many labelled documents of each class are learned from.
SAMPLE = 4000
LEXICON = 160
PREFIXES = (4, 5, 6, 7)
#: An entry is so much likelier in toxic texts of the sample, with so large a log
#: likelihood ratio against chance.
LEAST_RATIO, LEAST_EVIDENCE = 8.0, 12.0
PATTERNS = ("shouting", "exclamations", "no entry", "two entries", "three entries")


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            low = chr(i).lower()
            if len(low) == 1:
                table[i] = ord(low)
    return table


@dataclass
class Terms:
    """Terms of a batch: for each its text, hash and place in the code points."""

    n: int
    cp: np.ndarray
    at: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    prefix: np.ndarray


def _terms(column: pa.Array) -> tuple[Terms, np.ndarray]:
    """All words and word prefixes of a batch, and which simple patterns each text shows."""
    data, offsets, _ = A.flat(column)
    raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    cp = _lower()[raw]
    letters = classes()[cp] == LETTER
    start, end = A.spans(letters, at)
    sums = A.prefix_sums(cp)
    length = end - start
    parts = [(start, end, np.zeros(len(start), bool))]
    for k in PREFIXES:
        longer = length > k
        parts.append((start[longer], start[longer] + k, np.ones(int(longer.sum()), bool)))
    start, end, prefix = (np.concatenate([p[i] for p in parts]) for i in range(3))
    hashes = A.span_hash(sums, start, end) ^ prefix.astype(A.U)
    # patterns, from running counts
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    marks = np.zeros(len(raw), dtype=bool)
    if len(raw) > 1:
        marks[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
    n_letters = count(letters)
    simple = np.stack([(count(cp != raw) > 0.6 * n_letters) & (n_letters > 10), count(marks) > 0], axis=1)
    return Terms(len(offsets) - 1, cp, at, A.owner(at, start), hashes, start, end, prefix), simple


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that hold each term, summed within a slice."""
    for batch in slices(batches, "text"):
        t, _ = _terms(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((t.text, t.hash))
        h, text = t.hash[order], t.text[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        order, h, text = order[fresh], h[fresh], text[fresh]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        hits = np.add.reduceat(toxic[text].astype(np.int64), first) if len(h) else first
        total = np.diff(np.append(first, len(h)))
        whole = t.cp.astype("<u4").tobytes()
        names = [whole[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(t.start[order[first]].tolist(), t.end[order[first]].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(t.prefix[order[first]]), pa.array(h[first].astype(np.int64)), pa.array(hits), pa.array(total - hits)],
            names=["term", "prefix", "hash", "toxic", "clean"],
        )


@dataclass
class Model:
    lexicon: list[str]
    hashes: np.ndarray  # ascending
    weights: np.ndarray  # of the entries, then of PATTERNS
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def votes(self, column: pa.Array) -> np.ndarray:
        return _votes(column, self.hashes)

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(votes @ self.weights + self.bias)))


def _votes(column: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """One row a text: which entries and patterns fire."""
    t, simple = _terms(column)
    out = np.zeros((t.n, len(hashes) + len(PATTERNS)), dtype=np.float32)
    if len(hashes):
        spot = np.minimum(np.searchsorted(hashes, t.hash), len(hashes) - 1)
        hit = hashes[spot] == t.hash
        out[t.text[hit], spot[hit]] = 1
        # a word and its prefixes start at one place, which counts once
        place, first = np.unique(t.start[hit], return_index=True)
        words = np.bincount(t.text[hit][first], minlength=t.n) if len(place) else np.zeros(t.n)
        out[:, -2], out[:, -1] = words >= 2, words >= 3
    out[:, -3] = ~out[:, : len(hashes)].any(axis=1)
    out[:, len(hashes) : len(hashes) + 2] = simple
    return out


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class, firing rates per class and correlations of voters.

    ``start`` is the first guess of the posterior.  A voter that does not fire
    abstains; one of the voters fires where no entry does.  A voter's log
    likelihood ratio is divided by one plus its (positive) correlations within
    the classes.
    """
    q, n = np.clip(start, 0.02, 0.98), len(votes)
    for _ in range(rounds):
        rates = np.stack([(votes.T @ (1 - q) + 0.1) / ((1 - q).sum() + 1), (votes.T @ q + 0.5) / (q.sum() + 1)])
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        centred = votes - (np.outer(1 - q, rates[0]) + np.outer(q, rates[1]))
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-6
        corr = (centred.T @ centred) / max(n, 1) / np.outer(spread, spread)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
        z = np.log(prior / (1 - prior)) + votes @ (np.log(rates[1] / rates[0]) * share)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    return q, rates, corr


def fit_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum."""
    w, b = np.zeros(x.shape[1]), float(np.log((q @ weight + 1e-3) / ((1 - q) @ weight + 1e-3)))
    weight = weight / weight.sum()
    vw, vb = np.zeros_like(w), 0.0
    scale = 1 / (np.sqrt((x * x * weight[:, None]).sum(axis=0)) + 0.02)
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-(x @ w + b))) - q) * weight
        vw = 0.9 * vw + (x.T @ e) * scale * scale * 0.5 + 1e-5 * w
        vb = 0.9 * vb + e.sum()
        w, b = w - vw, b - vb
    return w, b


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(crc32_text(doc_id) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` labelled documents of each class."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    u = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    picked = known.filter(u < share).orderBy(F.xxhash64("doc_id")).limit(3 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null")
    # copies of one text would vote many times; these are sampled rows only
    # one that is labelled both ways is toxic
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.max("toxic") == 1).alias("toxic")).select("doc_id", "text", "toxic").persist()
    terms = rows.mapInArrow(_count, "term string, prefix boolean, hash long, toxic long, clean long")
    terms = terms.groupBy("hash").agg(F.min("term").alias("term"), F.first("prefix").alias("prefix"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    pos, neg = max(1, min(sample, counts[1])), max(1, min(sample, counts[0]))
    ratio = ((F.col("t") + 0.1) / float(pos)) / ((F.col("c") + 1.0) / float(neg))
    base, n = pos / (pos + neg), F.col("t") + F.col("c")
    chance = F.col("t") * F.log(F.greatest(F.col("t"), F.lit(1e-9)) / n / base) + F.col("c") * F.log(F.greatest(F.col("c"), F.lit(1e-9)) / n / (1 - base))
    best = terms.filter((ratio >= LEAST_RATIO) & (chance >= LEAST_EVIDENCE)).orderBy(F.desc(F.log(ratio) * F.col("t")), "term", "prefix").limit(LEXICON).collect()
    best = sorted(best, key=lambda r: r["hash"] % (1 << 64))
    hashes = np.array([r["hash"] % (1 << 64) for r in best], dtype=A.U)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            votes = np.packbits(_votes(batch.column("text"), hashes).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([v.tobytes() for v in votes], pa.binary())], names=["doc_id", "toxic", "votes"])

    table = rows.mapInArrow(cast, "doc_id long, toxic boolean, votes binary").orderBy("doc_id").toArrow()
    rows.unpersist()
    if not len(table):
        return None
    width = len(hashes) + len(PATTERNS)
    packed = np.frombuffer(b"".join(table.column("votes").to_pylist()), np.uint8).reshape(len(table), -1)
    votes = np.unpackbits(packed, axis=1)[:, :width].astype(np.float64)
    toxic = table.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    if toxic.all() or not toxic.any():
        return None
    entries = votes[:, : len(hashes)].sum(axis=1)
    q, rates, corr = label_model(votes, float(toxic.mean()), np.where(entries > 0, 0.9, 0.05))
    # the sample has more toxic texts than the corpus: weigh the classes back
    true = counts[1] / (counts[0] + counts[1])
    weight = q * true / toxic.mean() + (1 - q) * (1 - true) / (1 - toxic.mean())
    w, b = fit_linear(votes, q, weight)
    return Model([r["term"] + "*" * r["prefix"] for r in best], hashes, w, b, rates, corr)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of ``docs``.

    Null and empty texts get the score of a text on which no voter fires; with
    nothing to learn from, every score is 0.  Rows are scored one by one, so
    null or repeated doc_ids change nothing, and an empty table gives no row.
    Other columns are not read, whatever their names.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = model.score(model.votes(batch.column("text"))) if model is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(fn, "doc_id long, held_out boolean, score double, predicted int")


def op8(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
