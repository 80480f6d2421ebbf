"""Golden cases of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import terms as t
from loomgraph.operators import changelog, fixpoint, inference, search
from loomgraph.sources import mapping, nquads

# fixed values: what each text is taken for
KINDS = [
    ("", "string"), ("true", "boolean"), ("False", "boolean"), ("42", "integer"), ("-7", "integer"), ("3.14", "decimal"),
    ("1e3", "string"), ("2024-01-31", "date"), ("2024-02-31", "string"), ("2024-01-31T10:00:00Z", "dateTime"), ("hello", "string"),
]


def test_infer_datatype(spark):
    rows = spark.createDataFrame([(x,) for x, _ in KINDS], "x string").select("x", t.infer_datatype(F.col("x")).alias("k")).collect()
    assert {r["x"]: r["k"].rsplit("#", 1)[1] for r in rows} == dict(KINDS)


def test_names(spark):
    row = spark.range(1).select(
        t.expand_iri(F.lit("rdfs:label")).alias("a"), t.compact_iri(F.lit(t.LABEL)).alias("b"), t.local_name(F.lit("http://x/y#z")).alias("c"), t.local_name(F.lit("urn:a:b")).alias("d")
    ).first()
    assert tuple(row) == (t.LABEL, "rdfs:label", "z", "b")


def test_slug(spark):
    row = spark.createDataFrame([("works for ABC",)], "x string").select(t.slug(F.col("x"), True).alias("c"), t.slug(F.col("x"), False).alias("p")).first()
    assert tuple(row) == ("WorksForABC", "worksForABC")


def _facts(spark, rows):
    return spark.createDataFrame([tuple(f"<{x}>" if not x.startswith('"') else x for x in r) for r in rows], "s string, p string, o string")


def test_chain_rounds_and_caps(spark):
    sub = t.RDFS + "subClassOf"
    chain = _facts(spark, [(f"c{i}", sub, f"c{i + 1}") for i in range(8)])
    done = inference.materialise(chain, "rdfs")
    assert done.derivations.count() == 9 * 8 // 2 - 8 and done.reached_fixed_point
    short = inference.materialise(chain, "rdfs", max_rounds=1)
    assert short.rounds == 1 and not short.reached_fixed_point
    capped = inference.materialise(chain, "rdfs", max_derived=5)
    assert capped.hit_cap and capped.derivations.count() == 5


def test_no_cap_unless_asked_for(spark):
    """More instances of a subclass than the published service derives."""
    n = inference.MAX_DERIVED + 10
    key = lambda x: F.lit(f"<{x}>")
    facts = spark.range(n).select(F.concat(F.lit("<urn:i:"), F.col("id").cast("string"), F.lit(">")).alias("s"), key(t.TYPE).alias("p"), key("urn:a").alias("o"))
    facts = facts.union(spark.range(1).select(key("urn:a"), key(t.RDFS + "subClassOf"), key("urn:b")))
    done = inference.materialise(facts, "rdfs")
    assert done.reached_fixed_point and not done.hit_cap and done.derivations.count() == n


def test_queries_fail_at_a_limit(spark):
    from loomgraph.plans import reasoning

    facts = spark.createDataFrame([("<urn:x>", f"<{t.TYPE}>", "<urn:a>"), ("<urn:a>", f"<{t.RDFS}subClassOf>", "<urn:b>")], "s string, p string, o string")
    with pytest.raises(RuntimeError):
        reasoning._whole(inference.materialise(facts, "rdfs", max_derived=1))


def test_cycle_and_literal_subject(spark):
    sub = t.RDFS + "subClassOf"
    facts = _facts(spark, [("a", sub, "b"), ("b", sub, "a"), ("x", t.TYPE, "a"), ("p", t.RDFS + "range", "c"), ("x", "p", '"text"')])
    found = {(r["s"], r["p"], r["o"]) for r in inference.materialise(facts, "rl-lite").derivations.collect()}
    assert ("<x>", f"<{t.TYPE}>", "<b>") in found and not any(s.startswith('"') for s, _, _ in found)


def test_profiles():
    assert [len(inference.PROFILES[n]) for n in ("none", "rdfs", "rl-lite")] == [0, 6, 17]


def test_closure_is_safe_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    assert fixpoint.closure(edges).count() == 9
    seeds = spark.createDataFrame([("a",)], "a string")
    assert fixpoint.closure(edges, reflexive=True, seeds=seeds).count() == 3


def test_undo_stacks():
    # what is redone is the inverse of the patch that undid
    assert changelog.stacks([(1, None), (2, None), (3, 2)]) == ([1], [3])
    assert changelog.stacks([(1, None), (2, None), (3, 2), (4, 3)]) == ([1, 4], [])
    assert changelog.stacks([(1, None), (2, 7)]) == ([1, 2], [])
    assert changelog.stacks([(1, None), (2, 1), (3, None)]) == ([3], [])


def test_mapping_needs_its_columns(spark):
    table = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(ValueError):
        mapping.ingest(table, mapping.Mapping("x", ["k"], ["X"], "name"))


def test_rows_without_a_key_are_nodes_of_their_own(spark):
    table = spark.createDataFrame([("1", " "), (" ", "b"), (None, "c"), (None, "c")], "k string, name string")
    rows = mapping.ingest(table, mapping.Mapping("x", ["k"], ["X"], "name")).collect()
    assert len({r["s"] for r in rows}) == 4
    assert sorted(r["p"].rsplit("#", 1)[1] for r in rows) == ["externalKey", *["label"] * 3, *["type"] * 4]
    assert len({r["s"] for r in mapping.ingest(table, mapping.Mapping("x", [], ["X"], "name")).collect()}) == 4


def test_parts_of_a_key_keep_their_places(spark):
    table = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, " ", "")], "x string, y string, z string")
    rows = mapping.ingest(table, mapping.Mapping("t", ["x", "y", "z"], ["T"])).filter(F.col("p") == t.EXTERNAL_KEY).collect()
    assert len({r["o"] for r in rows}) == len(rows) == 2


def test_edges_name_their_source(spark):
    table = spark.createDataFrame([("1", "acme"), ("2", "acme")], "k string, employer string")
    m = mapping.Mapping("person", ["k"], ["Person"], fields=[mapping.Field("employer", "worksFor", "reference")])
    rows = mapping.with_source(mapping.ingest(table, m), m, "file://people.csv")
    assert rows.filter(F.col("p") == mapping.DERIVED_FROM).count() == 2 and rows.filter(F.col("p") == t.REIFIES).count() == 2


def test_a_filter_on_the_predicate_prunes_the_scan(spark):
    from loomgraph.plans.graph import kg

    plan = kg(spark, "/root/testdata/sf0.001", "customer").filter(F.col("p") == t.ONT + "segment")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan and "c_acctbal" not in plan


def test_nquads_escapes_and_errors(spark):
    lines = spark.createDataFrame([('<a> <b> "x\\"y\\n\\\\" .',), ("# note",), ("",), ('_:n <b> "z"@en <g> .',)], "value string")
    rows = {r["o"]: r for r in nquads.parse(lines).collect()}
    assert set(rows) == {'x"y\n\\', "z"} and rows["z"]["o_lang"] == "en" and rows["z"]["s_kind"] == "bnode" and rows["z"]["g"] == "g"
    with pytest.raises(Exception, match="not a statement"):
        nquads.parse(spark.createDataFrame([("nonsense",)], "value string")).collect()


def test_search_limits_and_short_queries(spark):
    recs = spark.createDataFrame([("i", "Tokyo", "", ["X"], "entity"), ("j", "Kyoto", "old", ["X"], "entity")], "iri string, label string, comment string, types array<string>, kind string")
    with pytest.raises(ValueError):
        search.search(recs, "x", limit=-1)
    assert [r["iri"] for r in search.search(recs, "ky").collect()] == ["i", "j"]
    assert [r["iri"] for r in search.search(recs, "kyo").collect()] == ["i", "j"]
    assert search.search(recs, '"((').count() == 0


def test_no_local_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from loomgraph.storage import Growing, Tables, shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(far)
    grown = Growing(Tables(spark, "test"), "n", spark.range(1).schema)
    assert grown.add(spark.range(3)).count() == 3 and grown.add(spark.range(0)).isEmpty() and grown.read().count() == 3


def test_paths_of_length_zero_and_given_terms(spark):
    from loomgraph.operators import paths

    rows = spark.createDataFrame([("a", "b"), ("b", "c")], "x string, y string")
    rows = t.quads(rows, F.concat(F.lit("urn:"), "x"), [t.iri_object("urn:p", F.concat(F.lit("urn:"), "y"))])
    step = paths.link("urn:p")
    found = lambda path, start="?x", end="?y": {tuple(r) for r in paths.match(rows, start, path, end).collect()}
    assert found(paths.maybe(step)) == {(f"<urn:{x}>", f"<urn:{y}>") for x, y in ("aa", "bb", "cc", "ab", "bc")}
    assert found(paths.star(step, given=("<urn:z>",)), "<urn:z>") == {("<urn:z>",)}
    assert found(paths.plus(step), "<urn:a>") == {("<urn:b>",), ("<urn:c>",)} and found(paths.inverse(step), "<urn:b>") == {("<urn:a>",)}
    assert found(paths.seq(step, step)) == {("<urn:a>", "<urn:c>")} and found(paths.negated("urn:p")) == set()


def test_class_forest(spark):
    from loomgraph.operators import graph_edit

    def forest(pairs):
        rows = graph_edit.of_keys(spark.createDataFrame([(t.ONTOLOGY, f"<urn:{a}>", f"<{t.RDFS}subClassOf>", f"<urn:{b}>") for a, b in pairs], "g string, sk string, pk string, ok string"))
        return sorted("/".join(x[4:] for x in r["path"]) for r in graph_edit.class_forest(rows).collect())

    assert forest([("r", "outside"), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("c", "c")]) == ["r", "r/a", "r/a/c", "r/b", "r/b/c"]
    assert forest([("a", "b"), ("b", "a")]) == ["a", "a/b", "b", "b/a"]
    assert forest([("r", "outside"), ("a", "r"), ("a", "b"), ("b", "a")]) == ["r", "r/a", "r/a/b"]


def test_nearest_vectors(spark):
    from loomgraph.operators import search

    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    assert [r["id"] for r in search.nearest(frame, [3.0, 0.0]).collect()] == [1, 2, 3]
    assert [r["id"] for r in search.nearest(frame, [3.0, 0.0], limit=9, least=-2.0).collect()] == [1, 2, 3, 4]
    assert [r["id"] for r in search.nearest(frame, [3.0, 0.0], least=0.8).collect()] == [1, 2] and search.nearest(frame, [0.0, 0.0]).count() == 0


def test_declared_datatypes_are_checked(spark):
    rows = spark.createDataFrame([("a", " 12 ", "2024-02-29"), ("b", "", None)], "k string, n string, day string")
    fields = [mapping.Field("n", "n", datatype="integer"), mapping.Field("day", "day", datatype="date")]
    made = mapping.ingest(rows, mapping.Mapping("m", ["k"], ["T"], None, fields, unique=True))
    assert {r["o"] for r in made.filter(F.col("p").isin(t.ONT + "n", t.ONT + "day")).collect()} == {"12", "2024-02-29"}
    for wrong in ("1.5", "x"):
        with pytest.raises(Exception, match="column n: not of type integer"):
            mapping.ingest(rows.withColumn("n", F.lit(wrong)), mapping.Mapping("m", ["k"], ["T"], None, fields, unique=True)).collect()
    with pytest.raises(ValueError, match="a datatype and a language"):
        mapping.ingest(rows, mapping.Mapping("m", ["k"], ["T"], None, [mapping.Field("n", "n", datatype="integer", language="en")]))
