"""JSON-LD documents, one a line, as quads, and quads as node objects.

Each row is a document of its own: a node object, an array of them, or an object
with ``@graph``.  Contexts within documents are applied as the expansion
algorithm of the JSON-LD recommendation says: term definitions with types,
languages and containers, lists, reverse properties, nested and included nodes,
contexts of terms and types.  Contexts elsewhere are not fetched: naming one is an
error, as is a keyword that is not read.  ``prefixes`` and ``base`` are what holds
before a document's own context.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.graph_edit import of_keys

_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_CONTAINERS = {"@list", "@set", "@language", "@index", "@id", "@type", "@graph"}


class _Number(str):
    """A number as it was written."""


def _quoted(text: str) -> str:
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, coded)
    return f'"{text}"'


def _numbers(x):
    """A JSON value whose numbers are numbers."""
    if isinstance(x, dict):
        return {k: _numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_numbers(v) for v in x]
    return json.loads(x) if isinstance(x, _Number) else x


def _many(x) -> list:
    return x if isinstance(x, list) else [x]


class _Context:
    """What terms mean at a place of a document."""

    def __init__(self, base: str, vocab: str | None, terms: dict[str, dict], language: str | None = None) -> None:
        self.base, self.vocab, self.terms, self.language = base, vocab, terms, language

    def given(self, said, first: _Context) -> _Context:
        """This context after what a document says; ``first`` holds again after null."""
        now = self
        for part in _many(said):
            if part is None:
                now = first
                continue
            if not isinstance(part, dict):
                raise ValueError(f"a context elsewhere is not fetched: {part}")
            now = _Context(now.base, now.vocab, dict(now.terms), now.language)
            if "@base" in part:
                now.base = urljoin(now.base, part["@base"]) if part["@base"] else ""
            if "@vocab" in part:
                now.vocab = None if part["@vocab"] is None else now.iri(part["@vocab"], True)
            if "@language" in part:
                now.language = part["@language"]
            rest = {k: v for k, v in part.items() if not k.startswith("@")}
            # a definition may use another one of the same context
            for name, meaning in rest.items():
                now.terms[name] = {"@id": None} if meaning is None else {"@id": meaning} if isinstance(meaning, str) else dict(meaning)
            for name in rest:
                now.terms[name] = now.defined(name, rest, ())
        return now

    def defined(self, name: str, rest: dict, above: tuple[str, ...]) -> dict:
        if name in above:
            raise ValueError(f"terms that are defined by each other: {name}")
        meaning = dict(self.terms[name])
        if odd := set(_many(meaning.get("@container", []) or [])) - _CONTAINERS:
            raise ValueError(f"container {', '.join(sorted(odd))} is not read")
        if odd := {k for k in meaning if k.startswith("@")} - {"@id", "@reverse", "@type", "@language", "@container", "@context", "@prefix", "@protected", "@index"}:
            raise ValueError(f"{', '.join(sorted(odd))} of term {name} is not read")
        if meaning.get("whole"):
            return meaning
        given = meaning.get("@reverse", meaning.get("@id", name))
        if isinstance(given, str) and not given.startswith("@"):
            prefix = given.split(":", 1)[0]
            if prefix != name and prefix in rest:
                self.terms[prefix] = self.defined(prefix, rest, (*above, name))
            elif given != name and given in rest:
                self.terms[given] = self.defined(given, rest, (*above, name))
            own = self.terms.pop(name)
            given = self.iri(given, True)
            self.terms[name] = own
        meaning["@reverse" if "@reverse" in meaning else "@id"] = given
        return meaning | {"whole": True}

    def iri(self, text: str, vocab: bool = False) -> str | None:
        """An IRI, blank label or keyword; terms and the vocabulary count where ``vocab`` says so."""
        if text.startswith("@"):
            return text
        if vocab and text in self.terms:
            return self.terms[text].get("@id", self.terms[text].get("@reverse"))
        if ":" in text:
            prefix, rest = text.split(":", 1)
            if prefix == "_" or rest.startswith("//"):
                return text
            meaning = self.terms.get(prefix)
            if meaning and isinstance(meaning.get("@id"), str):
                return meaning["@id"] + rest
            if _ABSOLUTE.match(text):
                return text
        if vocab:
            return None if self.vocab is None else self.vocab + text
        return urljoin(self.base, text) if self.base else text


class _Document:
    """Statements of one document as (graph, subject, predicate, object) keys."""

    def __init__(self, text: str, first: _Context, graph: str | None) -> None:
        self.first, self.graph, self.out, self.made = first, None if graph is None else f"<{graph}>", [], 0
        self.scope = "j" + hashlib.sha256(text.encode()).hexdigest()[:26]
        whole = json.loads(text, parse_float=_Number, parse_int=_Number)
        for node in _many(whole):
            if not isinstance(node, dict):
                raise ValueError("not a node object")
            context = first.given(node["@context"], first) if "@context" in node else first
            if set(node) <= {"@context", "@graph"}:
                self.several(node.get("@graph", []), context, self.graph)
            else:
                self.node(node, context, self.graph)

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}" + (f"-{self.made - 1}" if self.made > 1 else "")

    def key(self, iri: str | None) -> str | None:
        return None if iri is None else iri if iri.startswith("_:") else f"<{iri}>"

    def several(self, nodes, context: _Context, graph: str | None) -> None:
        for node in _many(nodes):
            if not isinstance(node, dict):
                raise ValueError("not a node object")
            self.node(node, context, graph)

    def node(self, node: dict, context: _Context, graph: str | None) -> str:
        """Says what a node object says, and returns its key."""
        if "@context" in node:
            context = context.given(node["@context"], self.first)
        types_key = [k for k in node if context.iri(k, True) == "@type"]
        types = [x for k in types_key for x in _many(node[k])]
        typed = context
        for name in sorted(x for x in types if isinstance(x, str)):
            if "@context" in context.terms.get(name, {}):
                typed = typed.given(context.terms[name]["@context"], self.first)
        ident = next((node[k] for k in node if context.iri(k, True) == "@id"), None)
        own = self.fresh() if ident is None else self.key(context.iri(ident))
        for x in types:
            if (said := self.key(context.iri(x, True))) is not None:
                self.out.append((graph, own, f"<{t.TYPE}>", said))
        for k, v in node.items():
            self.property(own, k, typed.iri(k, True), v, typed, graph)
        return own

    def property(self, own: str, name: str, p: str | None, value, context: _Context, graph: str | None) -> None:
        if p in ("@id", "@type", "@context", "@index") or p is None or value is None:
            return
        if p in ("@graph", "@included"):
            self.several(value, context, own if p == "@graph" else graph)
            return
        if p == "@reverse":
            for k, v in value.items():
                self.items(own, context.iri(k, True), v, context.terms.get(k, {}), context, graph, True)
            return
        if p.startswith("@"):
            raise ValueError(f"{p} is not read")
        term = context.terms.get(name, {})
        self.items(own, p, value, term, context, graph, "@reverse" in term)

    def items(self, own: str, p: str | None, value, term: dict, context: _Context, graph: str | None, back: bool) -> None:
        if p is None or (not _ABSOLUTE.match(p) and not p.startswith("_:")):
            return
        inner = context.given(term["@context"], self.first) if "@context" in term else context
        container = set(_many(term.get("@container") or []))
        if "@list" in container:
            value = [{"@list": _many(value)}] if not (isinstance(value, dict) and "@list" in value) else [value]
        elif "@language" in container and isinstance(value, dict):
            tagged = lambda k, x: {"@value": x} if k == "@none" else {"@value": x, "@language": k}
            value = [tagged(k, x) for k, xs in value.items() for x in _many(xs) if x is not None]
        elif container & {"@index", "@id", "@type"} and isinstance(value, dict):
            flat = []
            for k, xs in value.items():
                for x in _many(xs):
                    if "@graph" in container and not (isinstance(x, dict) and "@graph" in x):
                        x = {"@graph": x}
                    if k != "@none" and "@id" in container:
                        x = {"@id": k, **x} if isinstance(x, dict) else x
                    if k != "@none" and "@type" in container:
                        x = {**x, "@type": [k, *_many(x.get("@type", []))]} if isinstance(x, dict) else {"@id": x, "@type": k}
                    flat.append(x)
            value = flat
        elif "@graph" in container:
            value = [x if isinstance(x, dict) and "@graph" in x else {"@graph": x} for x in _many(value)]
        for x in [value] if term.get("@type") == "@json" else _many(value):
            for o in self.objects(x, term, inner, graph):
                said = (o, p, own) if back else (own, p, o)
                if back and not o.startswith(("<", "_:")):
                    raise ValueError("a literal has no reverse property")
                self.out.append((graph, said[0], self.key(p), said[2]))

    def objects(self, x, term: dict, context: _Context, graph: str | None) -> list[str]:
        """Keys of the terms that a value stands for."""
        if term.get("@type") == "@json":
            return [self.literal(x, "@json", None, context)]
        if x is None:
            return []
        if isinstance(x, list):
            return [o for y in x for o in self.objects(y, term, context, graph)]
        if not isinstance(x, dict):
            kind = term.get("@type")
            if kind in ("@id", "@vocab") and isinstance(x, str) and not isinstance(x, _Number):
                key = self.key(context.iri(x, kind == "@vocab"))
                return [] if key is None else [key]
            language = term["@language"] if "@language" in term else context.language
            return [self.literal(x, None if kind in ("@id", "@vocab", "@none") else kind, language, context)]
        named = {context.iri(k, True): k for k in x}
        if "@list" in named:
            rest = f"<{t.RDF}nil>"
            for o in reversed([o for y in _many(x[named["@list"]]) for o in self.objects(y, term, context, graph)]):
                node = self.fresh()
                self.out += [(graph, node, f"<{t.RDF}first>", o), (graph, node, f"<{t.RDF}rest>", rest)]
                rest = node
            return [rest]
        if "@set" in named:
            return self.objects(x[named["@set"]], term, context, graph)
        if "@value" in named:
            value = x[named["@value"]]
            kind, language = x.get(named.get("@type", "")), x.get(named.get("@language", ""))
            return [] if value is None and kind != "@json" else [self.literal(value, kind, language, context)]
        return [self.node(x, context, graph)]

    def literal(self, x, kind: str | None, language: str | None, context: _Context) -> str:
        if kind == "@json":
            return f"{_quoted(json.dumps(_numbers(x), sort_keys=True, separators=(',', ':'), ensure_ascii=False))}^^<{t.RDF}JSON>"
        if isinstance(x, (dict, list)):
            raise ValueError("a value is neither text, number nor truth value")
        datatype = None if kind is None else context.iri(kind, True)
        if isinstance(x, bool):
            x, datatype = str(x).lower(), datatype or t.XSD + "boolean"
        elif isinstance(x, _Number):
            datatype = datatype or t.XSD + ("integer" if re.fullmatch(r"-?\d+", x) else "double")
        elif datatype is None and language:
            return f"{_quoted(x)}@{language.lower()}"
        return _quoted(x) if datatype in (None, t.XSD + "string") else f"{_quoted(x)}^^<{datatype}>"


def parse(lines: DataFrame, prefixes: dict[str, str] = t.PREFIXES, base: str = t.BASE, graph: str | None = t.DATA, parts: int | None = None) -> DataFrame:
    """Quads of the column ``value``, one document in each row.

    Keys and types that no context explains are completed with ``base``, as
    relative identifiers are.  What is said outside ``@graph`` goes to ``graph``.
    A node without ``@id`` is a blank node named by a hash of the row; labels of
    blank nodes are shared between the rows.  A document that is not JSON-LD
    fails the read.  ``parts`` as in ``terms.as_set``.
    """

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = _Context(base, base, {k: {"@id": v, "whole": True} for k, v in prefixes.items()})
        for batch in batches:
            rows = [r for text in batch["value"] if text and text.strip() for r in _Document(text, first, graph).out]
            yield pd.DataFrame(rows, columns=["gk", "sk", "pk", "ok"])

    rows = lines.select("value").mapInPandas(fn, "gk string, sk string, pk string, ok string")
    return of_keys(rows.select(F.regexp_replace("gk", "^<(.*)>$", "$1").alias("g"), "sk", "pk", "ok"), parts)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Quads of files with one node object a line."""
    return parse(spark.read.text(path), **options)


def lines(rows: DataFrame) -> DataFrame:
    """Expanded node objects, one row for each subject (column value)."""
    o = F.col("o")
    text = F.to_json(F.struct(o.alias("@value"), F.when(F.col("o_dt").isin(t.XSD + "string", t.RDF + "langString"), None).otherwise(F.col("o_dt")).alias("@type"), F.col("o_lang").alias("@language")))
    link = F.to_json(F.struct(F.when(F.col("o_kind") == "bnode", F.concat(F.lit("_:"), o)).otherwise(o).alias("@id")))
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    typed = (F.col("p") == t.TYPE) & (F.col("o_kind") == "iri")
    item = F.when(typed, quote(o)).when(F.col("o_kind") == "literal", text).otherwise(link)
    said = rows.filter("o_kind <> 'triple'").select(F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), "s")).otherwise(F.col("s")).alias("id"), F.when(typed, "@type").otherwise(F.col("p")).alias("key"), item.alias("item"))
    members = said.groupBy("id", "key").agg(F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))
    entry = F.concat(quote(F.col("key")), F.lit(":["), "items", F.lit("]"))
    nodes = members.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("entries"))
    return nodes.select(F.concat(F.lit('{"@id":'), quote(F.col("id")), F.lit(","), "entries", F.lit("}")).alias("value"))
