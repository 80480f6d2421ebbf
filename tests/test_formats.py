"""Formats, scalar functions and snapshots on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalar as S
from loomgraph.functions import terms as t
from loomgraph.operators import changelog, property_graph, snapshots
from loomgraph.sources import jsonld, turtle

TURTLE = '''@prefix ex: <http://x/> . @base <http://base/> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
# a comment with <angle> and "quote"
ex:a a ex:Person , <Other> ; ex:name "Ann \\"A\\"\\n"@en-GB, \'\'\'two
lines\'\'\' ; ex:age 42 ; ex:height 1.75 ; ex:mass 6.0e1 ; ex:ok true ;
  ex:born "2000-01-02"^^xsd:date ; ex:address [ ex:city "Tokyo" ] .
ex:list ex:items ( 1 ex:b "c" ) .
_:n ex:knows _:m , ex:a\\-b .
[] ex:p ex:q .
ex:empty ex:items () ;.
'''
TRIG = '@prefix ex: <http://x/> . ex:s ex:p ex:o . ex:g { ex:s ex:p 1 . ex:t ex:p 2 } GRAPH <http://h> { ex:s ex:q "x" }'


def _write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_turtle(spark, tmp_path):
    rows = turtle.read(spark, _write(tmp_path, "a.ttl", TURTLE)).collect()
    said = {(r["s"].rsplit("/", 1)[-1], r["p"].rsplit("/", 1)[-1], r["o_key"]) for r in rows if r["s_kind"] == "iri"}
    assert {("a", "age", f'"42"^^<{t.XSD}integer>'), ("a", "height", f'"1.75"^^<{t.XSD}decimal>'), ("a", "mass", f'"6.0e1"^^<{t.XSD}double>')} <= said
    assert {("a", "name", '"Ann \\"A\\"\\n"@en-gb'), ("a", "name", '"two\\nlines"'), ("a", "22-rdf-syntax-ns#type", "<http://base/Other>")} <= said
    assert {("a", "born", f'"2000-01-02"^^<{t.XSD}date>'), ("a", "ok", f'"true"^^<{t.XSD}boolean>'), ("empty", "items", f"<{t.RDF}nil>")} <= said
    blanks = [r for r in rows if r["s_kind"] == "bnode"]
    assert sorted(r["p"].rsplit("/", 1)[-1] for r in blanks) == ["22-rdf-syntax-ns#first"] * 3 + ["22-rdf-syntax-ns#rest"] * 3 + ["city", "knows", "knows", "p"]
    assert len(rows) == 22 and {r["o"] for r in rows if r["p"].endswith("knows")} >= {"http://x/a-b"}
    assert next(r["o"] for r in rows if r["p"].endswith("name") and r["o_lang"]) == 'Ann "A"\n'


def test_blank_labels_of_two_files_stay_apart(spark, tmp_path):
    for name in ("a.ttl", "b.ttl"):
        _write(tmp_path, name, "_:x <http://x/p> 1 .")
    assert turtle.read(spark, str(tmp_path)).select("s").distinct().count() == 2


def test_trig(spark, tmp_path):
    rows = turtle.read(spark, _write(tmp_path, "a.trig", TRIG), graph=None).collect()
    assert sorted((r["g"] or "", r["o"]) for r in rows) == [("", "http://x/o"), ("http://h", "x"), ("http://x/g", "1"), ("http://x/g", "2")]


@pytest.mark.parametrize("text", ["<a> <b> .", "ex:a ex:b ex:c .", "<a> <b> <c>", '<a> <b> "open .', "<a> <b> {"])
def test_turtle_errors(spark, tmp_path, text):
    with pytest.raises(Exception, match="expected|no prefix|no term|not Turtle|found"):
        turtle.read(spark, _write(tmp_path, "bad.ttl", text)).collect()


XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:base="http://base/">
  <x:Person rdf:about="http://x/a" x:nick="A&amp;B" xml:lang="en">
    <x:name>Ann</x:name><x:age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">42</x:age>
    <x:knows rdf:resource="rel"/><x:knows><rdf:Description rdf:nodeID="b"><x:name xml:lang="de">B</x:name></rdf:Description></x:knows>
    <x:address rdf:parseType="Resource"><x:city>Tokyo</x:city></x:address>
    <x:items rdf:parseType="Collection"><rdf:Description rdf:about="http://x/i"/></x:items>
  </x:Person>
  <rdf:Seq rdf:ID="s"><rdf:li>one</rdf:li><rdf:li rdf:nodeID="b"/></rdf:Seq>
</rdf:RDF>"""


def test_rdfxml(spark, tmp_path):
    from loomgraph.sources import rdfxml

    rows = rdfxml.read(spark, _write(tmp_path, "a.rdf", XML))
    said = {(r["s"], r["p"].rsplit("/", 1)[-1], r["o_key"]) for r in rows.collect() if r["s_kind"] == "iri"}
    a = "http://x/a"
    assert {(a, "nick", '"A&B"@en'), (a, "name", '"Ann"@en'), (a, "age", f'"42"^^<{t.XSD}integer>'), (a, "knows", "<http://base/rel>"), (a, "22-rdf-syntax-ns#type", "<http://x/Person>")} <= said
    assert ("http://base/#s", "22-rdf-syntax-ns#_1", '"one"') in said and rows.filter("s_kind = 'bnode'").count() == 4
    rdfxml.write(rows, str(tmp_path / "out"))
    again = rdfxml.read(spark, str(tmp_path / "out"))
    assert again.filter("s_kind = 'iri' and o_kind <> 'bnode'").select("s", "p", "o_key").exceptAll(rows.select("s", "p", "o_key")).isEmpty() and again.count() == rows.count()


def test_jsonld(spark):
    rows = [
        '{"@id":"ex:a","@type":["ex:T"],"rdfs:label":[{"@value":"x","@language":"EN"},{"@value":"1","@type":"xsd:integer"}],"ex:n":[1,true,"t",2.5],"ex:to":{"@id":"_:b"}}',
        '{"rdfs:label":"no id"}', '{"@id":"rel"}',
    ]
    frame = spark.createDataFrame([(x,) for x in rows], "value string")
    found = jsonld.parse(frame, {**t.PREFIXES, "ex": "http://x/"}).collect()
    keys = sorted(r["o_key"] for r in found)
    assert keys == sorted(['<http://x/T>', '"x"@en', f'"1"^^<{t.XSD}integer>', f'"1"^^<{t.XSD}integer>', f'"true"^^<{t.XSD}boolean>', '"t"', f'"2.5"^^<{t.XSD}double>', "_:b", '"no id"'])
    assert {r["s_kind"] for r in found} == {"iri", "bnode"}


# fixed values: a call and the key or value that it gives
CASES = [
    (lambda k: S.strbefore(k('"abc"@en'), k('"b"')), '"a"@en'), (lambda k: S.strbefore(k('"abc"@en'), k('"z"')), '""'), (lambda k: S.strafter(k('"abc"'), k('"b"')), '"c"'),
    (lambda k: S.strbefore(k('"abc"'), k('"b"@en')), None), (lambda k: S.substr(k('"motor car"'), F.lit(7)), '"car"'), (lambda k: S.substr(k('"abc"'), F.lit(0), F.lit(2)), '"a"'),
    (lambda k: S.add(k('1', "integer"), k('2', "integer")), ("3", "integer")), (lambda k: S.add(k('1', "integer"), k('2.50', "decimal")), ("3.5", "decimal")),
    (lambda k: S.divide(k('1', "integer"), k('4', "integer")), ("0.25", "decimal")), (lambda k: S.divide(k('1', "integer"), k('0', "integer")), None),
    (lambda k: S.divide(k('1.0', "double"), k('0', "integer")), ("INF", "double")), (lambda k: S.add(k('"x"'), k('1', "integer")), None),
    (lambda k: S.round_(k('-2.5', "decimal")), ("-2", "decimal")), (lambda k: S.round_(k('2.5', "decimal")), ("3", "decimal")), (lambda k: S.ceil(k('1.2', "double")), ("2.0", "double")),
    (lambda k: S.cast(k('3.9', "decimal"), "integer"), ("3", "integer")), (lambda k: S.cast(k('"x"'), "integer"), None), (lambda k: S.cast(k('true', "boolean"), "integer"), ("1", "integer")),
    (lambda k: S.cast(k('"1"'), "boolean"), ("true", "boolean")), (lambda k: S.cast(k('"1e3"'), "double"), ("1000.0", "double")), (lambda k: S.cast(k('2024-02-30T00:00:00', "dateTime"), "dateTime"), None),
    (lambda k: S.timezone(k('2024-01-31T10:00:00-05:30', "dateTime")), ("-PT5H30M", "dayTimeDuration")), (lambda k: S.tz(k('2024-01-31T10:00:00', "dateTime")), '""'),
    (lambda k: S.seconds(k('2024-01-31T10:20:05.50', "dateTime")), ("5.5", "decimal")), (lambda k: S.langmatches(k('"en-GB"'), k('"EN"')), True), (lambda k: S.langmatches(k('""'), k('"*"')), False),
    (lambda k: S.truth(k('""')), False), (lambda k: S.truth(k('NaN', "double")), False), (lambda k: S.truth(k("<http://x>")), None), (lambda k: S.equal(k('1', "integer"), k('1.0', "decimal")), True),
    (lambda k: S.less(k('2024-01-01T00:00:00Z', "dateTime"), k('2024-01-01T00:00:00-01:00', "dateTime")), True), (lambda k: S.less(k('"a"'), k('1', "integer")), None),
    (lambda k: S.encode_for_uri(k('"a b*~é"')), '"a%20b%2A~%C3%A9"'), (lambda k: S.concat(k('"a"@en'), k('"b"@en')), '"ab"@en'), (lambda k: S.concat(k('"a"@en'), k('"b"')), '"ab"'),
    (lambda k: S.replace(k('"abcab"@en'), "B", "x", "i"), '"axcax"@en'), (lambda k: S.regex(k('"a.c"'), "A.C", "iq"), True), (lambda k: S.iri(k('"b"')), f"<{t.BASE}b>"),
    (lambda k: S.strlang(k('"a"'), k('"EN"')), '"a"@en'), (lambda k: S.strlang(k('"a"@de'), k('"EN"')), None), (lambda k: S.object_(S.triple(k("<s>"), k("<p>"), k('"a b"'))), '"a b"'),
    (lambda k: S.text(k('"a\\"\\\\\\n"')), 'a"\\\n'), (lambda k: S.strlen(k('"日本"@ja')), 2),
]


def test_scalar_functions(spark):
    def key(text, kind=None):
        return F.concat(F.col("empty"), F.lit(f'"{text}"^^<{t.XSD}{kind}>' if kind else text))

    one = spark.createDataFrame([("",)], "empty string")
    for i in range(0, len(CASES), 8):
        found = one.select(*[fn(key).alias(f"c{j}") for j, (fn, _) in enumerate(CASES[i : i + 8])]).first()
        wanted = [f'"{x[0]}"^^<{t.XSD}{x[1]}>' if isinstance(x, tuple) else x for _, x in CASES[i : i + 8]]
        assert list(found) == wanted


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    numbers = lambda: sorted(r["seq"] for r in snapshots.catalogue(spark, folder).collect())
    assert numbers() == []
    for seq in (5, 3, 9, 5):
        snapshots.keep(spark.range(seq), folder, seq)
    assert numbers() == [3, 5, 9]
    assert snapshots.give_up(spark, folder, snapshots.surplus(snapshots.catalogue(spark, folder), 2)) == [3] and numbers() == [5, 9]
    assert snapshots.give_up(spark, folder, snapshots.surplus(snapshots.catalogue(spark, folder), 2)) == []
    spark.range(1).write.parquet(f"{folder}/states/11-unfinished")
    assert numbers() == [5, 9]
    with pytest.raises(ValueError, match="from 0"):
        snapshots.keep(spark.range(1), folder, -1)
    with pytest.raises(ValueError, match="at least 0"):
        snapshots.surplus(snapshots.catalogue(spark, folder), -1)


def test_when_a_snapshot_is_due():
    assert [snapshots.due(n, 0.0, (0, 0.0), changes=10) for n in (9, 10, 11)] == [False, True, True]
    assert [snapshots.due(1, now, (0, 30.0), seconds=60) for now in (30.0, 89.0, 90.0)] == [False, False, True]
    assert not snapshots.due(10**6, 1e9, (0, 0.0)) and snapshots.due(5, 0.0, (4, 0.0), changes=1, seconds=60)
    for wrong in ({"changes": 0}, {"seconds": 0}):
        with pytest.raises(ValueError, match="between two"):
            snapshots.due(1, 1.0, (0, 0.0), **wrong)


def test_node_and_edge_tables_in_an_archive(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "graph.zip", "w") as z:
        z.writestr("nodes.csv", ':ID,label,:LABEL,age\nhttp://x/a,"Ann, ""A""\nB",Person;Other,42\nhttp://x/b,,,\n,no id,,\n')
        z.writestr("edges.csv", ":START_ID,:END_ID,:TYPE,predicate\nhttp://x/a,http://x/b,knows,http://x/knows\nhttp://x/a,,knows,http://x/knows\n")
    n, e = property_graph.read_tables(spark, *property_graph.unpack(spark, str(tmp_path / "graph.zip"), str(tmp_path / "tables")))
    rows = {(r["s"], r["p"], r["o"]) for r in property_graph.to_quads(n, e).collect()}
    assert rows == {
        ("http://x/a", t.LABEL, 'Ann, "A"\nB'), ("http://x/a", t.TYPE, t.ONT + "Person"), ("http://x/a", t.TYPE, t.ONT + "Other"), ("http://x/a", t.ONT + "age", "42"), ("http://x/a", "http://x/knows", "http://x/b"),
    }


@pytest.mark.parametrize("lines", [["A k 1"], ["TX 1 ann", "A k 1", "TX 2 bob"], ["TX 1 ann", "B k 1", "TC ."], ["TX x ann", "TC ."]])
def test_patch_text_that_is_wrong(spark, lines):
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, value string")
    with pytest.raises(Exception, match="line"):
        changelog.parse(rows, strict=True).collect()
    assert changelog.parse(rows).count() <= 1


def test_patch_text(spark):
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(["TX 1 ann", "A k 1", "D k 2", "TC .", "", "TX 2 bob b", "A k 3", "TC ."])], "file string, line int, value string")
    found = changelog.parse(rows, strict=True).collect()
    assert [tuple(r) for r in sorted(found)] == [(1, "ann", "A", "k 1"), (1, "ann", "D", "k 2"), (2, "bob b", "A", "k 3")]


QUOTED = """@prefix : <http://x/> .
:a :p :b ~ :r {| :sure 0.9 ; :by :me |} , :c {| :sure 1 |} .
<< :a :p :d ~ :r2 >> :by :you .
:r3 <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> <<( :a a "x"@en )>> .
<< :a :q _:n >> .
"""


def test_quoted_triples(spark, tmp_path):
    rows = turtle.read(spark, _write(tmp_path, "q.ttl", QUOTED)).collect()
    stated = {(r["o_triple"]["p"].rsplit("/")[-1], r["o_triple"]["o_key"]): r["s"] for r in rows if r["o_kind"] == "triple"}
    assert stated[("p", "<http://x/b>")] == "http://x/r" and stated[("p", "<http://x/d>")] == "http://x/r2" and stated[("22-rdf-syntax-ns#type", '"x"@en')] == "http://x/r3"
    assert len(stated) == 5 and {r["o"] for r in rows if r["p"] == "http://x/by" and r["s"] == "http://x/r"} == {"http://x/me"}
    sure = {r["s"]: r["o"] for r in rows if r["p"] == "http://x/sure"}
    assert sure["http://x/r"] == "0.9" and sure[stated[("p", "<http://x/c>")]] == "1"
    assert len(rows) == 5 + 2 + 4
    turtle.write(turtle.read(spark, str(tmp_path / "q.ttl")), str(tmp_path / "out"))
    assert turtle.read(spark, str(tmp_path / "out")).count() == len(rows)


JSONLD = [
    # names, links and a nested node, by the terms of a context
    ('{"@context":{"name":"http://schema.org/name","image":{"@id":"http://schema.org/image","@type":"@id"},"knows":"http://schema.org/knows"},"@id":"http://me/","name":"M","image":"http://me/i.png","knows":{"@id":"http://you/","name":"Y"}}',
     {("<http://me/>", "<http://schema.org/name>", '"M"'), ("<http://me/>", "<http://schema.org/image>", "<http://me/i.png>"), ("<http://me/>", "<http://schema.org/knows>", "<http://you/>"), ("<http://you/>", "<http://schema.org/name>", '"Y"')}),
    # strings stay strings
    ('{"@id":"http://a/x","http://p/s":["2024","true","{x","[y","1.5",true,2024,1.5]}',
     {("<http://a/x>", "<http://p/s>", k) for k in ('"2024"', '"true"', '"{x"', '"[y"', '"1.5"', f'"true"^^<{t.XSD}boolean>', f'"2024"^^<{t.XSD}integer>', f'"1.5"^^<{t.XSD}double>')}),
    # languages, index and reverse
    ('{"@context":{"@language":"de","l":{"@id":"http://p/l","@container":"@language"},"i":{"@id":"http://p/i","@container":"@index"},"parent":{"@reverse":"http://p/child"},"n":{"@id":"http://p/n","@language":null}},"@id":"http://a/x","l":{"en":"E","ja":["J","K"],"@none":"N"},"i":{"a":"A","b":{"@id":"http://b/"}},"parent":{"@id":"http://p/x"},"n":"plain","http://p/d":"tagged"}',
     {("<http://a/x>", "<http://p/l>", k) for k in ('"E"@en', '"J"@ja', '"K"@ja', '"N"')} | {("<http://a/x>", "<http://p/i>", k) for k in ('"A"@de', "<http://b/>")}
     | {("<http://p/x>", "<http://p/child>", "<http://a/x>"), ("<http://a/x>", "<http://p/n>", '"plain"'), ("<http://a/x>", "<http://p/d>", '"tagged"@de')}),
    # contexts of terms and types, prefixes made of prefixes, a null term, @set, @json, a typed value, keyword aliases
    ('{"@context":{"ex":"http://x/","sub":"ex:sub#","T":{"@id":"ex:T","@context":{"p":"ex:tp"}},"q":{"@id":"ex:q","@context":{"p":"sub:p"}},"gone":null,"id":"@id","type":"@type","j":{"@id":"ex:j","@type":"@json"}},"id":"ex:a","type":"T","p":1,"q":{"id":"ex:b","p":2},"gone":3,"ex:s":{"@set":["a",null]},"j":{"b":[1],"a":"x"},"ex:v":{"@value":"5","@type":"ex:dt"},"@reverse":{"ex:r":{"id":"ex:c"}}}',
     {("<http://x/a>", f"<{t.TYPE}>", "<http://x/T>"), ("<http://x/a>", "<http://x/tp>", f'"1"^^<{t.XSD}integer>'), ("<http://x/a>", "<http://x/q>", "<http://x/b>"), ("<http://x/b>", "<http://x/sub#p>", f'"2"^^<{t.XSD}integer>'),
      ("<http://x/a>", "<http://x/s>", '"a"'), ("<http://x/a>", "<http://x/v>", '"5"^^<http://x/dt>'), ("<http://x/c>", "<http://x/r>", "<http://x/a>"), ("<http://x/a>", "<http://x/j>", f'"{{\\"a\\":\\"x\\",\\"b\\":[1]}}"^^<{t.RDF}JSON>')}),
]


@pytest.mark.parametrize("k", range(len(JSONLD)))
def test_jsonld_contexts(spark, k):
    text, want = JSONLD[k]
    found = jsonld.parse(spark.createDataFrame([(text,)], "value string")).collect()
    assert {(f"<{r['s']}>" if r["s_kind"] == "iri" else f"_:{r['s']}", f"<{r['p']}>", r["o_key"]) for r in found} == want


def test_jsonld_lists_and_graphs(spark):
    text = '{"@context":{"@vocab":"http://v/","l":{"@container":"@list"}},"@graph":[{"@id":"http://a/","l":["x",{"@id":"http://b/"},{"deep":1}]},{"@id":"http://g/","@graph":[{"@id":"http://c/","l":[]}],"@included":[{"@id":"http://d/","w":"y"}]}]}'
    rows = jsonld.parse(spark.createDataFrame([(text,)], "value string"), graph=None).collect()
    assert {(r["g"], r["s"], r["o_key"]) for r in rows if r["s"] in ("http://c/", "http://d/")} == {("http://g/", "http://c/", f"<{t.RDF}nil>"), (None, "http://d/", '"y"')}
    rest = {r["s"]: r["o"] for r in rows if r["p"] == t.RDF + "rest"}
    first = {r["s"]: r["o_key"] for r in rows if r["p"] == t.RDF + "first"}
    node, items = next(r["o"] for r in rows if r["s"] == "http://a/"), []
    while node in first:
        items.append(first[node])
        node = rest[node]
    assert items[:2] == ['"x"', "<http://b/>"] and items[2].startswith("_:") and len(items) == 3


@pytest.mark.parametrize("text", ['{"@context":"http://elsewhere/","a":1}', '{"@nest":{"a":1}}', '{"@id":"http://a/","http://p/":{"@value":{"x":1}}}', "[1]", '{"@context":{"a":{"@id":"b:x"},"b":{"@id":"a:y"}}}'])
def test_jsonld_errors(spark, text):
    with pytest.raises(Exception, match="fetched|not read|value|node object|each other"):
        jsonld.parse(spark.createDataFrame([(text,)], "value string")).collect()


def test_a_session_without_a_shared_folder(tmp_path):
    """In local mode a temporary folder is made; it is the same one for all tables of the session."""
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession; from loomgraph.storage import Tables, shared_dir\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None and shared_dir(s) == shared_dir(s)\n"
        "assert Tables(s, 'x').cut(s.range(3)).count() == 3"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([os.getcwd(), *sys.path])}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120)


def test_search_returns_as_many_as_are_asked_for(spark):
    from loomgraph.operators import search

    recs = spark.range(1500).select(F.concat(F.lit("urn:"), "id").alias("iri"), F.lit("kyoto").alias("label"), F.lit("").alias("comment"), F.array().cast("array<string>").alias("types"), F.lit("entity").alias("kind"))
    assert search.search(recs, "kyo", limit=1500).count() == 1500 and search.search(recs, "ky", limit=1400).count() == 1400


def test_attributes_in_exports(spark, tmp_path):
    """Attributes survive GraphML and node tables, with odd characters, several values and names of the formats."""
    said = [("a", t.LABEL, '"A <&>"'), ("a", "http://x/age", f'"4"^^<{t.XSD}integer>'), ("a", "http://x/age", f'"5"^^<{t.XSD}integer>'), ("a", "http://x/types", '"q&q"'), ("b", "http://x/Age", '"other"'), ("a", "http://x/to", "<urn:b>")]
    from loomgraph.operators.graph_edit import of_keys

    rows = of_keys(spark.createDataFrame([(t.DATA, f"<urn:{s}>", f"<{p}>", o) for s, p, o in said], "g string, sk string, pk string, ok string"))
    lines = [r["line"] for r in property_graph.graphml(rows).orderBy("part").collect()]
    (tmp_path / "g").mkdir()
    path = _write(tmp_path / "g", "a.graphml", "\n".join(lines))
    n, e = property_graph.read_graphml(spark, path)
    assert {r["id"]: {(a["key"], a["value"]) for a in r["attrs"]} for r in n.collect()} == {"urn:a": {("age", "4 5"), ("types_", "q&q")}, "urn:b": {("Age", "other")}}
    assert [tuple(r) for r in e.collect()] == [("urn:a", "http://x/to", "urn:b")] and n.filter("id = 'urn:a'").first()["label"] == "A <&>"
    found = {r[":ID"]: r for r in property_graph.node_csv(rows).collect()}
    assert property_graph.node_csv(rows).columns == [":ID", "label", ":LABEL", "Age", "age_", "types"]
    assert tuple(found["urn:a"])[3:] == (None, "4 5", "q&q") and tuple(found["urn:b"])[3:] == ("other", None, None)
    chart = [r["line"] for r in property_graph.mermaid(rows, 1).orderBy("part").collect()]
    assert chart[0] == "graph LR" and len(chart) == 3 and chart[-1] == "%% 1 more nodes are left out"
