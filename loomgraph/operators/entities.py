"""Writing and reading of entities and of the ontology's terms, as set operations on quads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import terms as t
from . import graph_edit as E

Values = dict[str, str | list[str]]


def _quads(rows: DataFrame, node: str, said: list[tuple[str, str]], g: str) -> DataFrame:
    """Quads of one node from (predicate, object key)."""
    made = rows.sparkSession.createDataFrame([(g, f"<{node}>", f"<{p}>", o) for p, o in said], "g string, sk string, pk string, ok string")
    return E.of_keys(made)


def _said(values: Values) -> list[tuple[str, str]]:
    return [(p, o) for p, given in values.items() for o in (given if isinstance(given, list) else [given])]


def _literal(text: str, lang: str | None) -> str:
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, coded)
    return f'"{text}"' + (f"@{lang.lower()}" if lang else "")


def new_iri(label: str, salt: str, base: str = t.ID) -> str:
    """An IRI for a new node; the same label and salt give the same one again."""
    return base + hashlib.sha256(f"{salt}\x00{label}".encode()).hexdigest()[:26]


def create(rows: DataFrame, node: str, label: str, types: list[str] = (), comment: str | None = None, values: Values | None = None, lang: str = "ja", g: str = t.DATA) -> DataFrame:
    """``rows`` with a new node: its label, types, comment and further values (keys by predicate)."""
    if not label.strip():
        raise ValueError("a label is needed")
    said = [(t.LABEL, _literal(label.strip(), lang)), *((t.TYPE, f"<{c}>") for c in types), *_said(values or {})]
    if comment:
        said.append((t.COMMENT, _literal(comment.strip(), lang)))
    return E.insert(rows, _quads(rows, node, said, g))


def patch(rows: DataFrame, node: str, add: Values | None = None, remove: Values | None = None, label: str | None = None, comment: str | None = None, lang: str = "ja", g: str = t.DATA) -> DataFrame:
    """``rows`` after values of a node are removed and added; a new label or comment replaces all old ones."""
    for predicate, text in ((t.LABEL, label), (t.COMMENT, comment)):
        if text is not None:
            old = F.col("g").eqNullSafe(F.lit(g)) & (F.col("s") == node) & (F.col("p") == predicate)
            rows = rows.filter(~old)
            add = {**(add or {}), predicate: [*_as_list((add or {}).get(predicate)), _literal(text.strip(), lang)]}
    if remove:
        rows = E.delete(rows, _quads(rows, node, _said(remove), g))
    return E.insert(rows, _quads(rows, node, _said(add), g)) if add else rows


def _as_list(x: str | list[str] | None) -> list[str]:
    return [] if x is None else x if isinstance(x, list) else [x]


def with_labels(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """``quads`` with the label of each object that is an IRI (``o_label``), from all of ``rows``."""
    names = t.labels(rows).select(F.col("s").alias("o"), F.col("label").alias("o_label"))
    named = quads.filter("o_kind = 'iri'").join(names, "o", "left").select(*quads.columns, "o_label")
    return named.unionByName(quads.filter("o_kind <> 'iri'").withColumn("o_label", F.lit(None).cast("string")))


def add_class(rows: DataFrame, iri: str, label: str, parent: str | None = None, comment: str | None = None, lang: str = "ja") -> DataFrame:
    """A class in the ontology graph, below ``parent`` if one is given."""
    values: Values = {t.RDFS + "subClassOf": f"<{parent}>"} if parent else {}
    return create(rows, iri, label, [t.OWL + "Class"], comment, values, lang, t.ONTOLOGY)


def add_property(rows: DataFrame, iri: str, label: str, domain: str | None = None, range_: str | None = None, parent: str | None = None, comment: str | None = None, lang: str = "ja") -> DataFrame:
    """A property in the ontology graph; one whose range is a datatype of XSD is a datatype property."""
    kind = "DatatypeProperty" if range_ and range_.startswith(t.XSD) else "ObjectProperty"
    given = {"domain": domain, "range": range_, "subPropertyOf": parent}
    values: Values = {t.RDFS + k: f"<{v}>" for k, v in given.items() if v}
    return create(rows, iri, label, [t.OWL + kind], comment, values, lang, t.ONTOLOGY)


def replace_metadata(rows: DataFrame, s: str, p: str, o_key: str, fields: dict[str, str], g: str = t.DATA) -> DataFrame:
    """``rows`` with the metadata of one edge (texts by predicate) in place of what was said of it."""
    rows = E.delete(rows, metadata_quads(rows, s, p, o_key))
    edge = rows.sparkSession.createDataFrame([(s, p, o_key, *fields.values())], ", ".join(["s string", "p string", "o_key string", *(f"f{i} string" for i in range(len(fields)))]))
    return E.insert(rows, E.annotate(edge, {name: F.col(f"f{i}") for i, name in enumerate(fields)}, g)) if fields else rows


def metadata_quads(rows: DataFrame, s: str, p: str, o_key: str) -> DataFrame:
    """All quads of the reifiers of one triple."""
    stated = (F.col("p") == t.REIFIES) & (F.col("o_triple.s") == s) & (F.col("o_triple.p") == p) & (F.col("o_triple.o_key") == o_key)
    return rows.join(rows.filter(stated).select("s").distinct(), "s", "left_semi").select(*rows.columns)


def class_list(rows: DataFrame) -> DataFrame:
    """(iri, label, instances, examples): the classes with the number of their direct instances and the three smallest."""
    own = E.class_parents(rows).select("iri")
    typed = rows.filter((F.col("g") == t.DATA) & (F.col("p") == t.TYPE) & (F.col("o_kind") == "iri")).select(F.col("o").alias("iri"), "s")
    counts = typed.groupBy("iri").agg(F.count("*").alias("instances"))
    place = F.row_number().over(Window.partitionBy("iri").orderBy("s"))
    first = typed.withColumn("place", place).filter("place <= 3").groupBy("iri").agg(F.sort_array(F.collect_list("s")).alias("examples"))
    names = t.labels(rows.filter(F.col("g") == t.ONTOLOGY)).withColumnRenamed("s", "iri")
    out = own.join(names, "iri", "left").join(counts, "iri", "left").join(first, "iri", "left")
    return out.select("iri", F.coalesce("label", t.local_name(F.col("iri"))).alias("label"), F.coalesce("instances", F.lit(0)).alias("instances"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: quads, graphs, entities, edges between them, classes and properties."""
    data, terms = F.col("g") == t.DATA, (F.col("g") == t.ONTOLOGY) & (F.col("p") == t.TYPE)
    count = lambda test, what: F.countDistinct(F.when(test, what))
    link = data & (F.col("o_kind") == "iri") & (F.col("p") != t.TYPE)
    is_property: Column = F.col("o").isin(*E.PROPERTY_TYPES)
    return rows.agg(
        F.count("*").alias("quads"), F.countDistinct("g").alias("graphs"), count(data & (F.col("s_kind") == "iri"), F.col("s")).alias("entities"),
        F.count(F.when(link, 1)).alias("edges"), count(terms & (F.col("o") == t.OWL + "Class"), F.col("s")).alias("classes"), count(terms & is_property, F.col("s")).alias("properties"),
    )


def value_key(text: Column) -> Column:
    """A plain value as the key of a literal with the datatype that it looks like."""
    return S.literal(text, t.infer_datatype(text))
