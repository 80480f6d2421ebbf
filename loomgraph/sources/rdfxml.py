"""RDF/XML as quads, and quads as RDF/XML text.

As with Turtle, reading is one task for each file; a written row is one whole
``rdf:Description`` with its own namespaces.
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.graph_edit import of_keys
from .turtle import _quoted

_RDF = "{" + t.RDF + "}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
#: Attributes of the syntax; any other is a property with a plain text.
_SYNTAX = {_RDF + n for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "bagID")}
_OPEN = '<rdf:RDF xmlns:rdf="' + t.RDF + '">'
_CLOSE = "</rdf:RDF>"


class _Reader:
    """Triples of one document as (subject, predicate, object) keys."""

    def __init__(self, base: str, scope: str) -> None:
        self.base, self.scope, self.made, self.out = base, scope, 0, []

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def whole(self, iri: str, base: str) -> str:
        return f"<{iri if ':' in iri.split('/', 1)[0] else urljoin(base, iri)}>"

    def subject(self, e: ET.Element, base: str) -> str:
        if (about := e.get(_RDF + "about")) is not None:
            return self.whole(about, base)
        if (own := e.get(_RDF + "ID")) is not None:
            return self.whole("#" + own, base)
        label = e.get(_RDF + "nodeID")
        return f"_:{self.scope}{label}" if label is not None else self.fresh()

    def attributes(self, e: ET.Element, subject: str, lang: str | None) -> None:
        for tag, value in e.attrib.items():
            if tag == _RDF + "type":
                self.out.append((subject, f"<{t.TYPE}>", f"<{value}>"))
            elif tag not in _SYNTAX and not tag.startswith(_XML) and tag.startswith("{"):
                self.out.append((subject, f"<{self.name(tag)}>", _quoted(value) + (f"@{lang.lower()}" if lang else "")))

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        subject = self.subject(e, base)
        if e.tag != _RDF + "Description":
            self.out.append((subject, f"<{t.TYPE}>", f"<{self.name(e.tag)}>"))
        self.attributes(e, subject, lang)
        self.properties(e, subject, base, lang)
        return subject

    def properties(self, e: ET.Element, subject: str, base: str, lang: str | None) -> None:
        place = 0
        for child in e:
            if child.tag == _RDF + "li":
                place += 1
                predicate = f"<{t.RDF}_{place}>"
            else:
                predicate = f"<{self.name(child.tag)}>"
            self.out.append((subject, predicate, self.value(child, base, lang)))

    def value(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        kind = e.get(_RDF + "parseType")
        if kind == "Resource":
            node = self.fresh()
            self.properties(e, node, base, lang)
            return node
        if kind == "Collection":
            rest = f"<{t.RDF}nil>"
            for item in reversed([self.node(x, base, lang) for x in e]):
                cell = self.fresh()
                self.out += [(cell, f"<{t.RDF}first>", item), (cell, f"<{t.RDF}rest>", rest)]
                rest = cell
            return rest
        if kind is not None:
            inside = (e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e)
            return f"{_quoted(inside)}^^<{t.RDF}XMLLiteral>"
        if (resource := e.get(_RDF + "resource")) is not None:
            node = self.whole(resource, base)
            self.attributes(e, node, lang)
            return node
        if (label := e.get(_RDF + "nodeID")) is not None:
            return f"_:{self.scope}{label}"
        if len(e):
            return self.node(e[0], base, lang)
        if any(x not in _SYNTAX and not x.startswith(_XML) for x in e.attrib):
            node = self.fresh()
            self.attributes(e, node, lang)
            return node
        datatype = e.get(_RDF + "datatype")
        if datatype and datatype != t.XSD + "string":
            return f"{_quoted(e.text or '')}^^<{datatype}>"
        return _quoted(e.text or "") + (f"@{lang.lower()}" if lang and not datatype else "")

    def document(self, text: str) -> list[tuple]:
        root = ET.fromstring(text)
        base = root.get(_XML + "base", self.base)
        for e in root if root.tag == _RDF + "RDF" else [root]:
            self.node(e, base, root.get(_XML + "lang"))
        return self.out


def read(spark: SparkSession, path: str, base: str = t.BASE, graph: str | None = t.DATA) -> DataFrame:
    """Quads of RDF/XML files, in one graph; blank labels of different files stay apart."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["name"], batch["value"], strict=True):
                scope = "x" + hashlib.sha256(name.encode()).hexdigest()[:12] + "-"
                if text.strip():
                    yield pd.DataFrame(_Reader(base, scope).document(text), columns=["sk", "pk", "ok"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    rows = files.mapInPandas(fn, "sk string, pk string, ok string")
    return of_keys(rows.select(F.lit(graph).alias("g"), "sk", "pk", "ok"))


def _escaped(c: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def lines(rows: DataFrame) -> DataFrame:
    """One description for each subject (column value); quoted triples and predicates without a local name are left out."""
    space, local = F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w.-]*)$", 1), F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w.-]*)$", 2)
    text, plain = _escaped(F.col("o")), F.col("o_dt").isin(t.XSD + "string", t.RDF + "langString")
    says = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).when(plain, "").otherwise(F.concat(F.lit(' rdf:datatype="'), _escaped(F.col("o_dt")), F.lit('"')))
    start = F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), _escaped(space), F.lit('"'))
    value = F.when(F.col("o_kind") == "iri", F.concat(start, F.lit(' rdf:resource="'), text, F.lit('"/>'))).when(F.col("o_kind") == "bnode", F.concat(start, F.lit(' rdf:nodeID="'), text, F.lit('"/>')))
    value = value.otherwise(F.concat(start, says, F.lit(">"), text, F.lit("</n:"), local, F.lit(">")))
    who = F.when(F.col("s_kind") == "bnode", F.concat(F.lit('rdf:nodeID="'), _escaped(F.col("s")), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), _escaped(F.col("s")), F.lit('"')))
    said = rows.filter("o_kind <> 'triple'").filter(local != "").select(who.alias("who"), value.alias("item"))
    body = said.groupBy("who").agg(F.array_join(F.sort_array(F.collect_set("item")), "").alias("items"))
    return body.select(F.concat(F.lit("<rdf:Description "), "who", F.lit(">"), "items", F.lit("</rdf:Description>")).alias("value"))


def write(rows: DataFrame, folder: str) -> None:
    """Write text files of which each is a document."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [_OPEN]})
        yield from batches
        yield pd.DataFrame({"value": [_CLOSE]})

    lines(rows).mapInPandas(fn, "value string").write.text(folder)
