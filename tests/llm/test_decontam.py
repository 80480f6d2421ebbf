"""Windows of benchmark items in documents, against their definition."""

from __future__ import annotations

import hashlib

import pytest

from loomgraph.llm import _shared, decontam
from tests.compare import differs, tables


def _words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not (c.isalnum()):
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def _plain(docs, items, width=10):
    windows = {}
    for item, text in items:
        ws = _words(text)
        for s in range(max(0, len(ws) - width) + 1 if ws else 0):
            windows.setdefault(tuple(ws[s : s + width]), set()).add(item)
    out = []
    for i, text in docs:
        ws, hit, found = _words(text), set(), set()
        for m in {len(w) for w in windows}:
            for s in range(len(ws) - m + 1):
                if tuple(ws[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[tuple(ws[s : s + m])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


PASSAGE = "The quick brown fox, it jumps over the lazy dog; and then rests (in 2024) under an É-tree."
ITEMS = [
    (10, PASSAGE), (9, PASSAGE.upper()), (2, "the the the the the the the the the the the"), (3, "short item"), (4, "É"), (5, None), (6, ""), (7, " .;- "),
    (8, "never seen words of an item that no document has at all here"), (None, "one two three four five six seven eight nine ten eleven"), (10, "second text of item ten which has more than ten words in it"),
]
DOCS = [
    (1, PASSAGE), (2, "x " + PASSAGE + " y"), (3, "Quick brown fox it jumps over the lazy dog and"), (4, "quick brown fox it jumps over the lazy dog"), (5, None), (6, ""),
    (7, "the " * 9), (8, "the " * 25), (9, "a short item, a short itém"), (10, "É é"), (11, "One two three four five six seven eight nine ten eleven twelve"),
    (12, "z " * 5000 + PASSAGE + " z" * 5000), (None, PASSAGE), (None, "nothing"), (1, "other text"), (1, PASSAGE), (13, "second text of item ten which has more than TEN"), (14, "\x00 \n"),
    (15, PASSAGE + " " + PASSAGE), (16, "jumps over the lazy dog and then rests in 2024 under an É tree"), (17, "Σ ΟΔΟΣ İ short item"),
]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(*r, 1, "c") for r in DOCS], "doc_id long, text string, n_hit int, ws string").repartition(3)
    return docs, spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, wid int")


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_sql(spark):
    assert differs(decontam.op11(spark, "/root/testdata/sf0.001"), decontam.SQL, tables("/root/testdata/sf0.001")) == ""


@pytest.mark.parametrize("shingle,width", [(3, 10), (1, 10), (5, 4), (3, 2)])
def test_odd_rows(frames, shingle, width):
    assert _rows(decontam.contamination(*frames, width=width, shingle=shingle)) == _plain(DOCS, ITEMS, width)


def test_items_in_blocks_and_results_that_are_shuffled(frames, monkeypatch):
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert _rows(decontam.contamination(*frames)) == _plain(DOCS, ITEMS)


def test_empty_tables(frames):
    docs, items = frames
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert _rows(decontam.contamination(docs, items.limit(0))) == _plain(DOCS, [])
    assert decontam.contained_windows(docs, items.limit(0)).count() == 0


def test_where_windows_occur(frames):
    found = {(r["start"], r["n_words"], r["window"], r["item_id"]) for r in decontam.contained_windows(*frames).filter("doc_id = 13").collect()}
    assert found == {(0, 10, "second text of item ten which has more than ten", "10")}


def test_plan_has_no_python_and_scans_two_columns(frames, spark, tmp_path):
    frames[0].write.parquet(str(tmp_path / "documents.parquet"))
    frames[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = decontam.op11(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
