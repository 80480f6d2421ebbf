"""RDF terms as columns: schema of quads, keys, names, literals.

A quad is one row.  ``s`` and ``o`` hold the plain value (IRI, blank label or
lexical form), ``o_key`` the object's N-Triples text, which tells terms of all
kinds apart and is what objects are joined on.  ``g`` is null in the default
graph.  A quoted triple is an object with ``o_kind`` ``triple`` and its parts in
``o_triple``.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = "https://kg.example/"
ONT, ID = BASE + "ont#", BASE + "id/"
DATA, ONTOLOGY, SHAPES = "urn:kg:data", "urn:kg:ontology", "urn:kg:shapes"
INFERRED, LAYOUT, VOCAB = "urn:kg:inferred", "urn:kg:layout", "urn:kg:vocab/"
EDITABLE = (ONTOLOGY, DATA, SHAPES)

# fixed values: namespaces of public vocabularies
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SH = "http://www.w3.org/ns/shacl#"
PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS, "sh": SH,
    "dcterms": "http://purl.org/dc/terms/", "foaf": "http://xmlns.com/foaf/0.1/",
    "prov": "http://www.w3.org/ns/prov#", "schema": "https://schema.org/", "ont": ONT, "id": ID,
}
TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
PREF_LABEL, REIFIES = SKOS + "prefLabel", RDF + "reifies"
EXTERNAL_KEY = ONT + "externalKey"

TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("s", "p", "o_key")])
QUADS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")]
    + [T.StructField("o_triple", TRIPLE), T.StructField("o_key", T.StringType())]
)
NAMES = QUADS.fieldNames()

_DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
#: Lexical form of each datatype that is checked.
LEXICAL = {
    "integer": r"(?U)^[+-]?\d+$", "decimal": r"(?U)^[+-]?(\d+(\.\d*)?|\.\d+)$", "double": r"(?U)^[+-]?(\d+(\.\d*)?|\.\d+)$",
    "boolean": r"(?i)^(true|false|0|1)$", "date": _DATE, "dateTime": _TIME,
}


def _real_day(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()


def infer_datatype(text: Column) -> Column:
    """Datatype IRI that the trimmed text looks like; the order of the tests matters."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return (
        F.when(t == "", XSD + "string")
        .when(F.lower(t).isin("true", "false"), XSD + "boolean")
        .when(t.rlike(r"(?U)^[+-]?\d+$"), XSD + "integer")
        .when(t.rlike(r"(?U)^[+-]?(\d+\.\d*|\.\d+)$"), XSD + "decimal")
        .when(t.rlike(_DATE) & _real_day(t), XSD + "date")
        .when(t.rlike(_TIME) & _real_day(t), XSD + "dateTime")
        .otherwise(XSD + "string")
    )


def lexically_valid(text: Column, datatype: Column) -> Column:
    """Whether a literal's text is in the lexical space of its datatype; others pass."""
    out = F.lit(True)
    for name, pattern in LEXICAL.items():
        ok = text.rlike(pattern) & (_real_day(text) if name in ("date", "dateTime") else F.lit(True))
        out = F.when(datatype == XSD + name, ok).otherwise(out)
    return out


def escape(text: Column) -> Column:
    """A literal's text as N-Triples writes it between quotes."""
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def iri_key(iri: Column) -> Column:
    return F.concat(F.lit("<"), iri, F.lit(">"))


def node_key(value: Column, kind: Column) -> Column:
    return F.when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(iri_key(value))


def literal_key(text: Column, datatype: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), escape(text), F.lit('"'))
    return (
        F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), F.lower(lang)))
        .when(datatype.isNull() | (datatype == XSD + "string"), quoted)
        .otherwise(F.concat(quoted, F.lit("^^"), iri_key(datatype)))
    )


def _column(x: str | Column | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def iri_object(p: str | Column, iri: Column, g: str | Column | None = DATA) -> Column:
    """The part of a quad after its subject, with an IRI as object."""
    null = F.lit(None).cast("string")
    return F.struct(
        _column(g).alias("g"), _column(p).alias("p"), iri.alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_dt"),
        null.alias("o_lang"), F.lit(None).cast(TRIPLE).alias("o_triple"), iri_key(iri).alias("o_key"),
    )


def literal_object(p: str | Column, text: Column, datatype: str | Column | None = None, lang: str | Column | None = None, g: str | Column | None = DATA) -> Column:
    """The part of a quad after its subject, with a literal as object."""
    text, lang = text.cast("string"), _column(lang)
    datatype = F.when(lang.isNotNull(), RDF + "langString").otherwise(F.coalesce(_column(datatype), F.lit(XSD + "string")))
    return F.struct(
        _column(g).alias("g"), _column(p).alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), datatype.alias("o_dt"),
        lang.alias("o_lang"), F.lit(None).cast(TRIPLE).alias("o_triple"), literal_key(text, datatype, lang).alias("o_key"),
    )


def triple_object(p: str, s: Column, tp: Column, o_key: Column, g: str | Column | None = DATA) -> Column:
    """The part of a quad after its subject, with a quoted triple as object."""
    null = F.lit(None).cast("string")
    key = F.concat(F.lit("<<( "), iri_key(s), F.lit(" "), iri_key(tp), F.lit(" "), o_key, F.lit(" )>>"))
    return F.struct(
        _column(g).alias("g"), _column(p).alias("p"), null.alias("o"), F.lit("triple").alias("o_kind"), null.alias("o_dt"),
        null.alias("o_lang"), F.struct(s.alias("s"), tp.alias("p"), o_key.alias("o_key")).cast(TRIPLE).alias("o_triple"), key.alias("o_key"),
    )


def quads(df: DataFrame, subject: Column, objects: list[Column], s_kind: str = "iri") -> DataFrame:
    """One scan of ``df`` that gives a quad for each of ``objects`` that has a value.

    With one object its parts stay plain columns, so a filter on a constant
    predicate or graph is decided while planning.
    """
    rows = df.select(subject.alias("s"), (objects[0] if len(objects) == 1 else F.explode(F.array(*objects))).alias("q"))
    rows = rows.filter(F.col("s").isNotNull() & F.col("q.o_key").isNotNull() & F.col("q.p").isNotNull())
    return rows.select("q.g", "s", F.lit(s_kind).alias("s_kind"), "q.p", "q.o", "q.o_kind", "q.o_dt", "q.o_lang", "q.o_triple", "q.o_key")


def as_set(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """A dataset is a set of quads; ``parts`` says in how many parts equal ones are looked for, by default Spark does."""
    key = ["g", "s", "s_kind", "p", "o_key"]
    return (rows if parts is None else rows.repartition(parts, *key)).dropDuplicates(key)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def expand_iri(text: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """``rdfs:label`` to the whole IRI; whole IRIs and unknown prefixes stay."""
    out = text
    for name, ns in prefixes.items():
        out = F.when(F.substring_index(text, ":", 1) == name, F.concat(F.lit(ns), F.substring(text, len(name) + 2, 1 << 30))).otherwise(out)
    return F.when(text.contains("://") | text.startswith("urn:") | ~text.contains(":"), text).otherwise(out)


def compact_iri(iri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """A whole IRI to ``prefix:rest`` by the longest namespace that fits."""
    out = iri
    for name, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(iri.startswith(ns), F.concat(F.lit(name + ":"), F.substring(iri, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def local_name(iri: Column) -> Column:
    """What follows the last #, else /, else : (where that is not empty)."""
    tail = lambda c: F.nullif(F.regexp_extract(iri, f"{c}([^{c}]+)$", 1), F.lit(""))
    return F.coalesce(tail("#"), tail("/"), tail(":"), iri)


def labels(rows: DataFrame) -> DataFrame:
    """(s, label): a preferred label beats an ordinary one, the smallest wins a tie."""
    named = rows.filter(F.col("p").isin(PREF_LABEL, LABEL) & (F.col("o_kind") == "literal"))
    return named.groupBy("s").agg(F.min(F.struct((F.col("p") == LABEL).alias("r"), "o")).getField("o").alias("label"))


def skolemise(rows: DataFrame, base: str = BASE) -> DataFrame:
    """Blank nodes as IRIs below ``.well-known/genid``."""
    prefix = F.lit(base + ".well-known/genid/")
    s = F.when(F.col("s_kind") == "bnode", F.concat(prefix, "s")).otherwise(F.col("s"))
    blank = F.col("o_kind") == "bnode"
    o = F.when(blank, F.concat(prefix, "o")).otherwise(F.col("o"))
    return rows.withColumns({"s": s, "s_kind": F.lit("iri"), "o": o, "o_key": F.when(blank, iri_key(o)).otherwise(F.col("o_key")), "o_kind": F.when(blank, "iri").otherwise(F.col("o_kind"))})


def _slug(text: str | None, cls: bool) -> str | None:
    if text is None:
        return None
    words = "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", text)).split()
    out = []
    for i, w in enumerate(words):
        if not cls and i == 0:
            out.append(w.lower() if w.isupper() else w[0].lower() + w[1:])
        else:
            out.append(w if w.isupper() else w[0].upper() + w[1:])
    return "".join(out)


def slug(text: Column, cls: bool) -> Column:
    """Local name of a class (PascalCase) or property (camelCase) from its label.

    Spark has no NFKC, so this is a vectorised UDF; labels of terms are few.
    """

    @F.pandas_udf("string")
    def fn(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _slug(x, cls))

    return fn(text)
