"""Runs of words against their definition."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import word_runs

FOLDER = "/root/testdata/sf0.001"


def _plain_runs(w):
    """All runs by trying every period: maximal stretches in which words q apart agree, smallest periods only."""
    found = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _plain_row(i, text):
    words = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [x if k < a else words[a + (k - a) % p] for k, x in enumerate(words)]
    runs = _plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (i, len(runs), *best, milli, digest(lines), digest(" ".join(x for k, x in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("letters,most", [(1, 30), (2, 60), (3, 90), (5, 200)])
def test_runs_of_random_words(letters, most):
    rng = random.Random(letters)
    for _ in range(400):
        n = rng.randrange(most)
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.8:  # repeat a part, and that again
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(len(w))
                w[a : a + 1] = w[a : a + rng.randrange(1, 9)] * rng.randrange(2, 8)
        words = [str(x).encode() for x in w]
        assert word_runs.runs_of(words) == _plain_runs(words)
        # the automaton alone, without cutting at rare words
        assert sorted((s, e - s, q) for s, e, q in word_runs.runs(w)) == sorted(_plain_runs(w))


def test_runs_inside_of_copied_parts():
    part = "x a b a b a b a b y c c c c c c c z".split()
    words = [x.encode() for x in part * 5 + ["end"] + part[3:] + part * 2 + ["a", "b"] * 9]
    assert word_runs.runs_of(words) == _plain_runs(words)


def test_factors():
    assert word_runs.factors([0, 0, 1, 0, 0, 1, 0, 0]) == [(0, 1, -1), (1, 2, 0), (2, 3, -1), (3, 8, 0)]
    assert word_runs.factors([]) == []


def test_op13_against_its_definition(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, word_runs.op13(spark, FOLDER).collect()))
    assert found == sorted(_plain_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in found) > 5


def test_odd_rows(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate([None, "", " \t\n ", "a", "a " * 5, "a " * 6, "é b " * 7, "ab AB " * 4, "x\x0by\x0cz\r" * 9])]
    rows += [(100 + i, "one two three " * 40 + f"tail{i}") for i in range(40)] + [(None, "a b " * 9), (5, "a " * 6), (5, "b " * 6)]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, runs int, collapsed string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, word_runs.op13(spark, str(tmp_path)).collect()), key=key) == sorted((_plain_row(*r) for r in rows), key=key)
    assert word_runs.word_runs(frame.limit(0)).count() == 0


def test_long_texts(spark):
    """300,000 words: a long period, and words that hardly repeat."""
    period = [f"w{i}" for i in range(20_000)]
    words = [*(f"v{i}" for i in range(60_000)), *(period * 12), "end"]
    found = word_runs.word_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(60_000, 240_000, 20_000)]
    assert found["collapsed"].split(" ") == [*words[:80_000], "end"] and found["n_words"] == 300_001
    assert word_runs.word_runs(spark.createDataFrame([(1, "a " * 50_000)], "doc_id long, text string")).select(F.col("runs")[0]["length"]).first()[0] == 50_000
