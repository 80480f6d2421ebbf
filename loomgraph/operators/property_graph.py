"""The property-graph view of quads and its text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as t


def nodes(rows: DataFrame) -> DataFrame:
    """(id, label, types, attrs): IRI subjects and the targets of their edges."""
    own = rows.filter("s_kind = 'iri'")
    literal, link = F.col("o_kind") == "literal", F.col("o_kind") == "iri"
    label = F.min(F.when(F.col("p").isin(t.PREF_LABEL, t.LABEL) & literal, F.struct((F.col("p") == t.LABEL).alias("r"), "o")))
    types = F.sort_array(F.collect_set(F.when((F.col("p") == t.TYPE) & link, F.col("o"))))
    pairs = F.sort_array(F.collect_set(F.when(literal & ~F.col("p").isin(t.PREF_LABEL, t.LABEL), F.struct(t.local_name(F.col("p")).alias("key"), F.col("o").alias("value")))))
    subjects = own.groupBy(F.col("s").alias("id")).agg(label.getField("o").alias("label"), types.alias("types"), pairs.alias("attrs"))
    targets = own.filter(link & (F.col("p") != t.TYPE)).select(F.col("o").alias("id")).distinct()
    return subjects.join(targets, "id", "full").select(
        "id", F.coalesce("label", t.local_name(F.col("id"))).alias("label"), F.coalesce("types", F.array().cast("array<string>")).alias("types"),
        F.coalesce("attrs", F.array().cast("array<struct<key:string,value:string>>")).alias("attrs"),
    )


def edges(rows: DataFrame) -> DataFrame:
    """(source, predicate, target) between IRIs; types are no edges."""
    return rows.filter((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri") & (F.col("p") != t.TYPE)).select(F.col("s").alias("source"), F.col("p").alias("predicate"), F.col("o").alias("target")).distinct()


def degrees(rows: DataFrame) -> DataFrame:
    """(id, outgoing, incoming)."""
    e = edges(rows)
    out = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    return out.union(e.select(F.col("target").alias("id"), F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def mermaid(rows: DataFrame, most: int = 200) -> DataFrame:
    """(part, line) of a flow chart of the first ``most`` nodes by id and the edges between them; sorted by part it is well formed.

    A last line says how many nodes were left out, if any were.
    """
    every = nodes(rows).select("id", "label")
    n = every.orderBy("id").limit(most)
    n = n.withColumn("i", F.row_number().over(Window.orderBy("id")) - 1)
    name = F.concat(F.lit("n"), F.col("i").cast("string"))
    clean = F.translate(F.replace("label", F.lit('"'), F.lit("'")), "\n", " ")
    node_lines = n.select(F.lit(1).alias("part"), F.concat(name, F.lit('["'), clean, F.lit('"]')).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "graph LR")], "part int, line string")
    left_out = every.agg((F.count("*") - most).alias("n")).filter("n > 0")
    tail = left_out.select(F.lit(3).alias("part"), F.concat(F.lit("%% "), F.col("n").cast("string"), F.lit(" more nodes are left out")).alias("line"))
    a, b = n.select(F.col("id").alias("source"), name.alias("a")), n.select(F.col("id").alias("target"), name.alias("b"))
    e = edges(rows).join(F.broadcast(a), "source").join(F.broadcast(b), "target")
    edge_lines = e.select(F.lit(2).alias("part"), F.concat("a", F.lit(" -->|"), t.local_name(F.col("predicate")), F.lit("| "), "b").alias("line"))
    return t.union(head, node_lines, edge_lines, tail)


def loss(rows: DataFrame) -> DataFrame:
    """What a plain property graph cannot hold: one row of counts."""
    return rows.agg(F.count(F.when(F.col("o_lang").isNotNull(), 1)).alias("language_tagged"), F.count(F.when(F.col("o_kind") == "triple", 1)).alias("with_triples"), F.countDistinct("g").alias("graphs"))


def to_quads(node_rows: DataFrame, edge_rows: DataFrame, lang: str | None = None, g: str = t.DATA) -> DataFrame:
    """Quads of nodes (id, label, types, attrs) and edges (source, predicate, target)."""
    named = t.quads(node_rows, F.col("id"), [t.literal_object(t.LABEL, F.col("label"), lang=lang, g=g)])
    typed = t.quads(node_rows.select("id", F.explode("types").alias("c")), F.col("id"), [t.iri_object(t.TYPE, F.col("c"), g)])
    pairs = node_rows.select("id", F.explode("attrs").alias("a")).select("id", "a.*")
    p = F.when(F.col("key").contains("://"), F.col("key")).otherwise(F.concat(F.lit(t.ONT), "key"))
    attrs = t.quads(pairs, F.col("id"), [t.literal_object(p, F.col("value"), t.infer_datatype(F.col("value")), g=g)])
    links = t.quads(edge_rows, F.col("source"), [t.iri_object(F.col("predicate"), F.col("target"), g)])
    return t.as_set(t.union(named, typed, attrs, links))


def node_csv(rows: DataFrame) -> DataFrame:
    """Node table of a graph import: :ID, label, :LABEL and a column for each attribute, several values apart by spaces.

    Attributes whose names differ in case only share no column: the later one has ``_`` added.
    """
    n = nodes(rows)
    names = F.transform("types", lambda c: t.local_name(c))
    keys = sorted(r[0] for r in n.select(F.explode("attrs.key")).distinct().collect())  # as many as the vocabulary has
    columns, taken = [], {":id", "label", ":label"}
    for key in keys:
        name = key
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.nullif(_values("attrs", F.lit(key)), F.lit("")).alias(name))
    return n.select(F.col("id").alias(":ID"), "label", F.array_join(names, ";").alias(":LABEL"), *columns)


def _values(attrs: str, key: Column) -> Column:
    """The values of one attribute, in order, apart by spaces."""
    return F.array_join(F.transform(F.filter(attrs, lambda a: a["key"] == key), lambda a: a["value"]), " ")


def edge_csv(rows: DataFrame) -> DataFrame:
    return edges(rows).select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), t.local_name(F.col("predicate")).alias(":TYPE"), "predicate")


def _xml(c):
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def graphml(rows: DataFrame) -> DataFrame:
    """(part, line) of a GraphML document with the attributes of nodes; sorted by part it is well formed."""
    own = lambda k: F.when(k.isin("label", "types", "predicate"), F.concat(k, F.lit("_"))).otherwise(k)
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), _xml(c), F.lit("</data>"))
    every = nodes(rows)
    one = lambda k: F.concat(F.lit('<data key="'), _xml(own(k)), F.lit('">'), _xml(_values("attrs", k)), F.lit("</data>"))
    more = F.array_join(F.transform(F.array_distinct("attrs.key"), one), "")
    n = every.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("label", F.col("label")), data("types", F.array_join("types", " ")), more, F.lit("</node>")).alias("line"))
    e = edges(rows).select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), data("predicate", F.col("predicate")), F.lit("</edge>")).alias("line"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label"/><key id="types" for="node" attr.name="types"/><key id="predicate" for="edge" attr.name="predicate"/>'
    keys = F.sort_array(F.collect_set("key"))  # as many as the vocabulary has
    declared = F.transform(keys, lambda k: F.concat(F.lit('<key id="'), _xml(own(k)), F.lit('" for="node" attr.name="'), _xml(k), F.lit('"/>')))
    first = every.select(F.explode("attrs.key").alias("key")).agg(F.concat(F.lit(head), F.array_join(declared, ""), F.lit('<graph edgedefault="directed">')).alias("line"))
    last = rows.sparkSession.createDataFrame([(3, "</graph></graphml>")], "part int, line string")
    return t.union(first.select(F.lit(0).alias("part"), "line"), n, e, last)


def read_graphml(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files, read by Spark's XML source, one row an element."""
    pair = "array<struct<_key:string,_VALUE:string>>"
    n = spark.read.schema(f"_id string, data {pair}").format("xml").option("rowTag", "node").load(path)
    e = spark.read.schema(f"_source string, _target string, data {pair}").format("xml").option("rowTag", "edge").load(path)
    value = lambda k: F.element_at(F.transform(F.filter("data", lambda d: d["_key"] == k), lambda d: d["_VALUE"]), 1)
    get = lambda k: F.when(F.exists("data", lambda d: d["_key"] == k), value(k))
    attrs = F.transform(F.filter("data", lambda d: ~d["_key"].isin("label", "types")), lambda d: F.struct(d["_key"].alias("key"), d["_VALUE"].alias("value")))
    types = F.filter(F.split(F.coalesce(get("types"), F.lit("")), " "), lambda x: x != "")
    n = n.select(F.col("_id").alias("id"), F.coalesce(get("label"), t.local_name(F.col("_id"))).alias("label"), types.alias("types"), attrs.alias("attrs"))
    e = e.select(F.col("_source").alias("source"), get("predicate").alias("predicate"), F.col("_target").alias("target"))
    return n, e.dropna()


def read_tables(spark, node_path: str, edge_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the tables that ``node_csv`` and ``edge_csv`` make, written with a header.

    Columns of the node table other than :ID, label, :LABEL and attrs are
    attributes; rows without an id, or an edge without an end or a predicate,
    are left out.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
    n, e = spark.read.csv(node_path, **options), spark.read.csv(edge_path, **options)
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    own = [c for c in n.columns if c not in (":ID", "label", ":LABEL", "attrs")]
    plain = F.filter(F.array(*[pair(F.lit(c), F.col(f"`{c}`")) for c in own]), lambda a: a["value"].isNotNull()) if own else F.array().cast("array<struct<key:string,value:string>>")
    if "attrs" in n.columns:
        packed = F.from_json("attrs", "array<struct<key:string,value:string>>")
        plain = F.concat(plain, F.coalesce(packed, F.array().cast("array<struct<key:string,value:string>>")))
    types = F.filter(F.split(F.coalesce(F.col("`:LABEL`"), F.lit("")), ";"), lambda c: c != "")
    full = F.transform(types, lambda c: F.when(c.contains("://"), c).otherwise(F.concat(F.lit(t.ONT), c)))
    n = n.select(F.trim(F.col("`:ID`")).alias("id"), "label", full.alias("types"), plain.alias("attrs")).filter("id <> ''")
    ends = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(a) for c, a in ((":START_ID", "source"), ("predicate", "predicate"), (":END_ID", "target"))]
    return n, e.select(*ends).dropna()


def unpack(spark, archive: str, folder: str) -> tuple[str, str]:
    """The two tables of a zip archive (nodes.csv, edges.csv), copied to ``folder`` in the shared store; a task copies each archive."""

    def fn(batches):
        import io
        import zipfile

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if missing := sorted({"nodes.csv", "edges.csv"} - set(z.namelist())):
                        raise ValueError(f"the archive has no {', '.join(missing)}")
                    yield pd.DataFrame({"name": ["nodes", "edges"], "value": [z.read(f"{n}.csv").decode("utf-8").rstrip("\r\n") for n in ("nodes", "edges")]})

    tables = spark.read.format("binaryFile").load(archive).select("content").mapInPandas(fn, "name string, value string")
    tables.write.partitionBy("name").text(folder)
    return f"{folder}/name=nodes", f"{folder}/name=edges"


def documents(rows: DataFrame) -> DataFrame:
    """(id, json): a JSON-LD node document for each IRI subject, values grouped by property."""
    value = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.when(F.col("o_lang").isNull() & (F.col("o_dt") != t.XSD + "string"), F.col("o_dt")).alias("@type"), F.col("o_lang").alias("@language"))))
    value = value.otherwise(F.to_json(F.struct(F.when(F.col("o_kind") == "bnode", F.concat(F.lit("_:"), "o")).otherwise(F.col("o")).alias("@id"))))
    plain = rows.filter("s_kind = 'iri' and o_kind <> 'triple'")
    by = plain.withColumn("v", F.when(F.col("p") == t.TYPE, F.to_json(F.array("o")).substr(F.lit(2), F.length(F.to_json(F.array("o"))) - 2)).otherwise(value))
    grouped = by.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_set("v")), ",").alias("vs"))
    name = F.when(F.col("p") == t.TYPE, F.lit("@type")).otherwise(F.col("p"))
    members = grouped.withColumn("m", F.concat(F.lit('"'), name, F.lit('":['), "vs", F.lit("]")))
    docs = members.groupBy(F.col("s").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("m")), ",").alias("ms"))
    return docs.select("id", F.concat(F.lit('{"@id":"'), "id", F.lit('",'), "ms", F.lit("}")).alias("json"))
