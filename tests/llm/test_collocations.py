"""Phrases against their definition, and the parts that count them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import _arrays, _shared, collocations
from tests.compare import differs, tables


def _plain(rows, longest=3, least=10, share=50, top=2000):
    f = {}
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [x for x in re.split("[ \t]", piece) if x]
            for k in range(1, longest + 1):
                for s in range(len(ws) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(ws[s : s + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    inside[p[s : s + k]] = max(inside[p[s : s + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _rows(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "x" * 300, "x" * 299 + "y", "\x00", "a-b", "'s", *(f"w{i}" for i in range(40))]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.randrange(1, len(words) + 1)]) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "! "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + ("new york city of the new york city" if i % 3 == 0 else "")))
    return [*rows, ("en", None), (None, ""), ("fr", " \t\n"), ("en", "solo " * 5000), ("en", "New York City")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "c") for r in _rows()], "lang string, text string, n int, k1 string").repartition(3)


def test_sql(spark):
    assert differs(collocations.op12(spark, "/root/testdata/sf0.001"), collocations.SQL, tables("/root/testdata/sf0.001")) == ""


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"longest": 4, "least": 5}, {"longest": 2, "least": 1, "top": None}])
def test_odd_rows(frame, options):
    assert sorted(map(tuple, collocations.collocations(frame, **options).collect())) == _plain(_rows(), **{k: (10**9 if v is None else v) for k, v in options.items()})


def test_many_segments_slices_and_full_bit_tables(frame, monkeypatch):
    """Small slices and segments, a bit table that nearly everything passes, and no broadcast."""
    monkeypatch.setattr(collocations, "SEGMENT", 500)
    monkeypatch.setattr(collocations, "SLICE", 3000)
    monkeypatch.setattr(collocations, "BITS", 6)
    monkeypatch.setattr(collocations, "CHUNK", 4)
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_shared, "HOT", 5)
    assert sorted(map(tuple, collocations.collocations(frame).collect())) == _plain(_rows())


def test_empty_tables(frame):
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_keys_that_clash_are_seen(frame, monkeypatch):
    """With a hash of very few bits no seed tells the words apart, which is an error and not a wrong count."""
    real = _arrays.byte_hash
    monkeypatch.setattr(collocations, "SEEDS", 2)
    count = collocations._count_words

    def few(seed):
        def fn(batches):
            from loomgraph.llm import _arrays as own

            own.byte_hash = lambda *a, **b: real(*a, **b) & np.uint64(3)
            try:
                yield from count(seed)(batches)
            finally:
                own.byte_hash = real

        return fn

    monkeypatch.setattr(collocations, "_count_words", few)
    with pytest.raises(ValueError, match="no seed"):
        collocations.collocations(frame)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    index = collocations.PerfectHash(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    other = np.random.default_rng(n + 1).integers(0, 2**63, 100).astype(np.uint64)
    assert ((index.slots(other) >= -1) & (index.slots(other) < max(len(keys), 1))).all()


def test_segment_counts():
    rng = np.random.default_rng(2)
    parts = [([rng.integers(0, 30, 500).astype(np.uint64) for _ in range(2)], rng.integers(1, 4, 500)) for _ in range(20)]
    want = Counter()
    for (x, y), n in parts:
        for a, b, c in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
            want[(a, b)] += c
    (x, y), total, _ = collocations.count_segment(parts, 25)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), total.tolist(), strict=True)) == {p: c for p, c in want.items() if c >= 25}


def test_byte_hash():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"\x00ab") for _ in range(rng.randrange(600))) for _ in range(500)] + [b"", b"\x00", b"\x00\x00", b"a", b"a\x00"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
    starts = np.concatenate([[0], ends[:-1]])
    h = _arrays.byte_hash(data, starts, ends, 5).tolist()
    assert len(set(zip(h, texts, strict=True))) == len(set(texts)) == len(set(h))
    i, j = np.arange(len(texts)), np.array([rng.randrange(len(texts)) for _ in texts])
    n = np.array([min(len(texts[a]), len(texts[b])) for a, b in zip(i, j, strict=True)])
    same = _arrays.same_spans(data, starts[i], starts[j], n)
    assert same.tolist() == [texts[a][:m] == texts[b][:m] for a, b, m in zip(i, j, n, strict=True)]
