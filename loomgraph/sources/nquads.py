"""N-Quads and N-Triples: splittable text in, splittable text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t

_NODE = r"(<[^>]*>|_:\S+)"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
_QUOTED = r"<<\( .*? \)>>"
_LINE = rf"^\s*{_NODE}\s+<([^>]*)>\s+({_QUOTED}|<[^>]*>|_:\S+|{_LITERAL})\s*(?:<([^>]*)>|(_:\S+))?\s*\.\s*(?:#.*)?$"

#: File suffixes and the formats that are read or written for them.
FORMATS = {
    ".nt": "ntriples", ".nq": "nquads", ".csv": "csv", ".tsv": "tsv", ".graphml": "graphml",
    ".jsonld": "jsonld", ".mmd": "mermaid", ".parquet": "parquet",
}


def format_of(name: str) -> str | None:
    """Format of a file name by its suffix, None if it is not known."""
    return next((f for suffix, f in FORMATS.items() if name.lower().endswith(suffix)), None)


def _unescape(text: Column) -> Column:
    mark = F.lit("\u0000")
    text = F.replace(text, F.lit("\\\\"), mark)
    for raw, coded in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return F.replace(text, mark, F.lit("\\"))


def parse(lines: DataFrame, column: str = "value", graph: str | None = None, strict: bool = True, parts: int | None = None) -> DataFrame:
    """Quads of text lines.  ``graph`` replaces the graph of lines that name none.

    Blank lines and comments are skipped; with ``strict`` any other line that is
    not a statement is an error, else it is skipped.  ``parts`` as in ``terms.as_set``.
    """
    line = F.trim(F.col(column))
    rows = lines.filter((line != "") & ~line.startswith("#")).select(line.alias("line"))
    part = lambda i: F.regexp_extract("line", _LINE, i)
    rows = rows.select("line", part(1).alias("sk"), part(2).alias("p"), part(3).alias("ok"), F.nullif(part(4), F.lit("")).alias("g"))
    bad = F.col("sk") == ""
    if strict:
        rows = rows.withColumn("sk", F.when(bad, F.raise_error(F.concat(F.lit("not a statement: "), "line"))).otherwise(F.col("sk")))
    else:
        rows = rows.filter(~bad)
    o = F.col("ok")
    kind = F.when(o.startswith("<<("), "triple").when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")
    text = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    lang = F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    dt = F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    inner = lambda i: F.regexp_extract(o, r"^<<\( <([^>]*)> <([^>]*)> (.*) \)>>$", i)
    rows = rows.withColumn("o_kind", kind)
    literal, triple = F.col("o_kind") == "literal", F.col("o_kind") == "triple"
    value = F.when(literal, _unescape(text)).when(F.col("o_kind") == "iri", o.substr(F.lit(2), F.length(o) - 2)).when(F.col("o_kind") == "bnode", o.substr(F.lit(3), F.length(o)))
    datatype = F.when(lang.isNotNull(), t.RDF + "langString").otherwise(F.coalesce(dt, F.lit(t.XSD + "string")))
    blank = F.col("sk").startswith("_:")
    s = F.when(blank, F.expr("substring(sk, 3)")).otherwise(F.expr("substring(sk, 2, length(sk) - 2)"))
    out = rows.select(
        F.coalesce("g", F.lit(graph)).alias("g"), s.alias("s"), F.when(blank, "bnode").otherwise("iri").alias("s_kind"), "p", value.alias("o"), "o_kind",
        F.when(literal, datatype).alias("o_dt"), F.when(literal, lang).alias("o_lang"),
        F.when(triple, F.struct(inner(1).alias("s"), inner(2).alias("p"), inner(3).alias("o_key"))).alias("o_triple"),
        F.when(literal, t.literal_key(_unescape(text), datatype, lang)).otherwise(o).alias("o_key"),
    )
    return t.as_set(out, parts)


def read(spark, path: str, graph: str | None = None) -> DataFrame:
    """Quads of N-Quads or N-Triples files."""
    return parse(spark.read.text(path), graph=graph)


def lines(rows: DataFrame, graphs: bool = True) -> DataFrame:
    """One statement a row, as N-Quads or (without graphs) N-Triples."""
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), t.iri_key(F.col("g")))).otherwise(F.lit("")) if graphs else F.lit("")
    return rows.select(F.concat(t.node_key(F.col("s"), F.col("s_kind")), F.lit(" "), t.iri_key(F.col("p")), F.lit(" "), "o_key", g, F.lit(" .")).alias("value"))


def write(rows: DataFrame, path: str, graphs: bool = True) -> None:
    lines(rows, graphs).write.text(path)
