"""The quad store and the text index against plain tables, and what their scans open."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import search
from loomgraph.operators import text_index as X
from loomgraph.operators.graph_edit import of_keys
from loomgraph.plans import history
from loomgraph.sources.quad_store import QuadStore
from tests.test_queries import FOLDER


def _quads(spark, rows):
    return of_keys(spark.createDataFrame([(g, f"<urn:{s}>", f"<urn:{p}>", o) for g, s, p, o in rows], "g string, sk string, pk string, ok string"))


def _set(frame):
    return {(r["g"], r["s"], r["p"], r["o_key"]) for r in frame.collect()}


ROWS = [("urn:a", "s1", "p/x y?", '"1"'), ("urn:a", "s1", "q", "<urn:o>"), ("urn:b", "s2", "q", '"x"@en'), (None, "s3", "q", "_:b"), ("urn:a", "s1", "q", "<urn:o>")]


def test_graphs_are_replaced_one_by_one(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.seq() == 0
    every = _quads(spark, ROWS)
    assert store.replace(every, ["urn:a", "urn:b", None]) == 1
    assert _set(store.read()) == _set(every) and store.read().count() == 4
    assert _set(store.read(["urn:a"])) == {r for r in _set(every) if r[0] == "urn:a"} and _set(store.read([None])) == {r for r in _set(every) if r[0] is None}
    before = {f for f in store.read(["urn:b", None]).inputFiles()}
    store.change("urn:a", add=_quads(spark, [("urn:z", "s9", "q", '"new"')]), remove=_quads(spark, ROWS[1:2]))
    assert _set(store.read(["urn:a"])) == {("urn:a", "urn:s1", "urn:p/x y?", '"1"'), ("urn:a", "urn:s9", "urn:q", '"new"')}
    assert {r["graph"]: r["seq"] for r in store.current().collect()} == {"urn:a": 2, "urn:b": 1, "default:": 1}
    # the other graphs lie where they lay
    assert {r["commit"] for r in store.current().filter("graph <> 'urn:a'").collect()} == {next(iter(before)).split("commit_=")[1].split("/")[0]}
    store.replace(every.limit(0), ["urn:b"])
    assert _set(store.read(["urn:b"])) == set() and store.read().count() == 3
    assert store.sweep() == 2 and store.read().count() == 3 and store.sweep() == 0


def test_commits_that_collide(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "store"))
    base = store.replace(_quads(spark, ROWS), ["urn:a", "urn:b", None])
    store.replace(_quads(spark, ROWS[:1]), ["urn:a"])
    with pytest.raises(ValueError, match="changed after"):
        store.replace(_quads(spark, ROWS[:2]), ["urn:a"], base)
    assert store.replace(_quads(spark, ROWS[2:3]), ["urn:b"], base) == 3
    with pytest.raises(Exception, match="not a graph of this commit"):
        store.replace(_quads(spark, ROWS), ["urn:a"])
    assert store.seq() == 3 and store.read(["urn:a"]).count() == 1


def test_scans_open_the_parts_asked_for(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "store"))
    store.replace(_quads(spark, ROWS), ["urn:a", "urn:b", None])
    rows = store.read(["urn:a"]).filter(F.col("p") == "urn:q")
    filters = next(x for x in _plan(rows).splitlines() if x.startswith("PartitionFilters"))
    assert "graph_" in filters and "commit_" in filters and "= urn:q" in filters
    assert {r[0].split("/quads/")[1].split("/", 1)[1].rsplit("/", 1)[0] for r in rows.select(F.input_file_name()).distinct().collect()} == {"graph_=urn%253Aa/p=urn%253Aq"}  # escaped as a path, then as a URI


def _plan(frame):
    return frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def _records(n=120):
    rng = random.Random(5)
    words = ["kyoto", "Tokyo", "tower", "aaaa", "red", "Straße", "日本語文", "İstanbul", ""]
    return [(f"urn:{i:03d}", " ".join(rng.choices(words, k=rng.randrange(4))), None if i % 7 == 0 else " ".join(rng.choices(words, k=rng.randrange(6))), [f"urn:T{i % 3}"], "term" if i % 5 == 0 else "entity") for i in range(n)]


SCHEMA = "iri string, label string, comment string, types array<string>, kind string"
QUERIES = ["kyo", "TOWER", "aaa", "o r", "red tower", "straße", "日本語", "ky", "", "absent", "istan", "kyoto tokyo"]


def _rows(frame):
    return [(r["iri"], r["label"], round(r["score"], 9)) for r in frame.collect()]


def _agree(spark, index, recs):
    frame = spark.createDataFrame(recs, SCHEMA)
    for q in QUERIES:
        assert _rows(index.search(q, limit=1000)) == _rows(search.search(frame, q, limit=1000)), q
    assert _rows(index.search("kyo", kind="entity", cls="urn:T1", limit=5, offset=2)) == _rows(search.search(frame, "kyo", kind="entity", cls="urn:T1", limit=5, offset=2))


def test_the_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch):
    recs = _records()
    index = X.TextIndex(spark, str(tmp_path / "index"))
    assert index.search("kyo").count() == 0
    index.build(spark.createDataFrame(recs, SCHEMA))
    _agree(spark, index, recs)
    # some change, some go, some are new; then the same ones change again
    for k in (1, 2):
        recs = [(i, f"changed kyoto {k}", c, ty, kind) if int(i[-3:]) % 10 == 1 else (i, x, c, ty, kind) for i, x, c, ty, kind in recs if int(i[-3:]) % (40 * k)]
        recs += [(f"urn:9{k}9", "new Tokyo tower", None, ["urn:T1"], "entity")]
        touched = [(f"urn:{i:03d}",) for i in range(120) if i % 10 == 1 or i % (40 * k) == 0] + [(f"urn:9{k}9",)]
        index.update(spark.createDataFrame(recs, SCHEMA), spark.createDataFrame(touched, "iri string"))
    assert len(index.segments()) == 3
    _agree(spark, index, recs)
    monkeypatch.setattr(X, "MOST_SEGMENTS", 3)
    index.update(spark.createDataFrame(recs, SCHEMA), spark.createDataFrame([("urn:002",)], "iri string"))
    assert len(index.segments()) == 1
    _agree(spark, index, recs)


def test_only_the_parts_of_the_query_are_read(spark, tmp_path):
    index = X.TextIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(_records(), SCHEMA))
    plan = _plan(index.occurrences("kyoto"))
    scan = next(x for x in plan.split("\n\n") if "postings" in x)
    assert "PartitionFilters: [bucket" in scan and all(g in scan.split("PushedFilters: ")[1].splitlines()[0] for g in ("kyo", "yot", "oto"))
    assert "label" not in scan.split("ReadSchema")[1]
    assert {r["bucket"] for r in spark.read.parquet(f"{tmp_path}/index/{index.segments()[0][1]}/postings").filter("gram = 'kyo'").select("bucket").distinct().collect()} == {X._bucket("kyo")}


def _counted(spark, frame):
    """``frame`` and the number of rows that were made of it so far."""
    made = spark.sparkContext.accumulator(0)

    def seen(iri):
        made.add(1)
        return iri

    return frame.withColumn("iri", F.udf(seen, "string").asNondeterministic()("iri")), made


def test_records_are_made_once_for_a_segment(spark, tmp_path):
    index = X.TextIndex(spark, str(tmp_path / "index"))
    recs = spark.createDataFrame(_records(), SCHEMA)
    built, made = _counted(spark, recs)
    index.build(built)
    assert made.value == 120
    fresh, made = _counted(spark, recs)
    touched, named = _counted(spark, recs.select("iri").limit(30))
    index.update(fresh, touched)
    assert (made.value, named.value) == (120, 30)


def test_an_upkeep_makes_the_records_of_the_graph_once(spark, monkeypatch):
    kept, parts = [], history._parts

    def counted(*args):
        frame, made = _counted(spark, parts(*args))
        kept.append(made)
        return frame

    monkeypatch.setattr(history, "_parts", counted)
    history.QUERIES["search_index_upkeep"](spark, FOLDER).collect()
    assert [made.value for made in kept] == [spark.read.parquet(f"{FOLDER}/part.parquet").count()]


def test_an_upkeep_gives_all_hits(spark, tmp_path):
    plan = _plan(history.QUERIES["search_index_upkeep"](spark, FOLDER))
    assert "Limit" not in plan and "TakeOrdered" not in plan
    recs = spark.createDataFrame(_records(), SCHEMA)
    index = X.TextIndex(spark, str(tmp_path / "index"))
    index.build(recs)
    for q in ("kyo", "ky", ""):
        whole = _rows(search.search(recs, q, limit=1000))
        for found in (index.search, lambda *a, **k: search.search(recs, *a, **k)):
            assert sorted(_rows(found(q, limit=None))) == sorted(whole) and len(whole) > 20
            assert _rows(found(q, limit=None, offset=5)) == whole[5:]
            with pytest.raises(ValueError, match="negative"):
                found(q, limit=-1)


def test_names_of_many_gone_records_are_not_broadcast(spark, tmp_path, monkeypatch):
    recs = spark.createDataFrame(_records(), SCHEMA)
    index = X.TextIndex(spark, str(tmp_path / "index"))
    index.build(recs)
    index.update(recs, recs.select("iri").limit(30))
    assert "BroadcastHashJoin" in _plan(index.records())
    monkeypatch.setattr(storage, "SMALL", 0)
    assert "Broadcast" not in _plan(index.records()) and index.records().count() == 120
