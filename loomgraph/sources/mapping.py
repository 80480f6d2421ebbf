"""Mapping-driven ingest: rows of a table become quads in one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.graph_edit import annotate

DERIVED_FROM = "http://www.w3.org/ns/prov#wasDerivedFrom"


@dataclass(frozen=True)
class Field:
    """A column of the table as a property.

    ``kind`` is ``literal``, ``link`` (to the node that another mapping makes of
    this key, below ``target``) or ``reference`` (to a node made for each
    distinct value).
    """

    column: str
    predicate: str
    kind: str = "literal"
    datatype: str | None = None
    language: str | None = None
    target: str | None = None
    skip_empty: bool = True


@dataclass(frozen=True)
class Mapping:
    name: str
    key: list[str]
    types: list[str]
    label: str | None = None
    fields: list[Field] = field(default_factory=list)
    graph: str = t.DATA
    label_lang: str | None = None
    #: The key is a primary key of the table: never blank, never repeated.
    unique: bool = False

    def check(self, columns: list[str]) -> None:
        asked = [*self.key, *([self.label] if self.label else []), *(f.column for f in self.fields)]
        if missing := sorted(set(asked) - set(columns)):
            raise ValueError(f"mapping {self.name}: no column {', '.join(missing)}")
        if both := sorted(f.column for f in self.fields if f.datatype and f.language):
            raise ValueError(f"mapping {self.name}: a datatype and a language for {', '.join(both)}")


def node_iri(table: str, key: Column) -> Column:
    """A deterministic IRI for a key, so that another ingest finds the same node."""
    return F.concat(F.lit(f"{t.ID}{table}/"), key.cast("string"))


def reference_iri(predicate: str, cell: Column) -> Column:
    return F.concat(F.lit(f"{t.ID}ref/"), F.substring(F.sha2(F.concat(F.lit(f"ref:{predicate}:"), cell), 256), 1, 26))


def _key(mapping: Mapping) -> Column:
    """Text of the key, null where it is blank; parts keep their place in a key of several columns."""
    if not mapping.key:
        return F.lit(None).cast("string")
    parts = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in mapping.key]
    if len(parts) == 1:
        return parts[0]
    return F.when(F.coalesce(*parts).isNotNull(), F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in parts]), 256))


def _without_key(table: DataFrame, mapping: Mapping) -> DataFrame:
    """Rows with a blank key and, as ``node_``, a node of its own for each.

    Equal rows are counted before they are numbered, so a row that is repeated
    very often meets in no task.
    """
    repeated = table.filter(_key(mapping).isNull()).groupBy(*table.columns).agg(F.count("*").alias("times_"))
    row = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(table.columns)])), 256)
    numbered = repeated.withColumn("number_", F.explode(F.sequence(F.lit(1).cast("long"), "times_")))
    node = F.concat(F.lit(f"{t.ID}{mapping.name}/row-"), F.substring(row, 1, 26), F.lit("-"), F.col("number_").cast("string"))
    return numbered.withColumn("node_", node).drop("times_", "number_")


def ingest(table: DataFrame, mapping: Mapping, known: DataFrame | None = None, predicates: set[str] | None = None) -> DataFrame:
    """Quads of a table.  ``known`` (key, s) gives the nodes that already stand for keys.

    Rows with the same key are one node; a row with a blank key, or of a mapping
    without one, makes a node of its own.  Additions only: what an earlier
    ingest said about a node stays.

    Each property is a branch of a union, so a filter on the predicate prunes
    the others while planning and the scan reads the columns of what is left;
    ``predicates`` leaves branches out from the start.  With a ``unique`` mapping
    the quads are distinct as they come and need no shuffle.

    A text that is not in the lexical space of the datatype declared for its
    column is an error; columns of another type than text are taken as they are.
    """
    mapping.check(table.columns)
    key = F.col("key_")
    rows = table.withColumn("key_", _key(mapping))
    subject = node_iri(mapping.name, key)
    if known is not None:
        rows = rows.join(known.select(F.col("key").alias("key_"), F.col("s").alias("known_")), "key_", "left")
        subject = F.coalesce(F.col("known_"), subject)
    if not mapping.unique:
        rows = rows.filter(key.isNotNull()).unionByName(_without_key(table, mapping), allowMissingColumns=True)
        subject = F.coalesce(F.col("node_"), subject)
    objects = [(t.TYPE, t.iri_object(t.TYPE, F.lit(t.ONT + c), mapping.graph)) for c in mapping.types]
    objects.append((t.EXTERNAL_KEY, t.literal_object(t.EXTERNAL_KEY, key, g=mapping.graph)))
    if mapping.label:
        text = F.nullif(F.trim(F.col(mapping.label).cast("string")), F.lit(""))
        objects.append((t.LABEL, t.literal_object(t.LABEL, text, lang=mapping.label_lang, g=mapping.graph)))
    for f in mapping.fields:
        p, cell = t.ONT + f.predicate, F.trim(F.col(f.column).cast("string"))
        if f.skip_empty or f.kind != "literal":
            cell = F.nullif(cell, F.lit(""))
        if f.kind == "literal":
            if f.datatype and table.schema[f.column].dataType.typeName() == "string":
                wrong = F.raise_error(F.concat(F.lit(f"mapping {mapping.name}, column {f.column}: not of type {f.datatype}: "), cell))
                cell = F.when(cell.isNull() | t.lexically_valid(cell, F.lit(t.XSD + f.datatype)), cell).otherwise(wrong.cast("string"))
            kind = t.XSD + f.datatype if f.datatype else (None if f.language else t.infer_datatype(cell))
            objects.append((p, t.literal_object(p, cell, kind, f.language, mapping.graph)))
        else:
            node = node_iri(f.target, cell) if f.kind == "link" else reference_iri(p, cell)
            objects.append((p, t.iri_object(p, node, mapping.graph)))
    asked = [o for p, o in objects if predicates is None or p in predicates]
    branches = [t.quads(rows, subject, [o]) for o in asked] or [t.quads(rows.limit(0), subject, [objects[0][1]])]
    out = t.union(*branches)
    return out if mapping.unique else t.as_set(out)


def with_source(rows: DataFrame, mapping: Mapping, source: str) -> DataFrame:
    """The quads of an ingest and, for the edges of its link and reference fields, the IRI they come from."""
    links = [t.ONT + f.predicate for f in mapping.fields if f.kind != "literal"]
    edges = rows.filter(F.col("p").isin(*links) & (F.col("o_kind") == "iri"))
    return rows.unionByName(annotate(edges, {DERIVED_FROM: F.lit(source)}, mapping.graph))


def reference_nodes(table: DataFrame, mapping: Mapping, existing: DataFrame | None = None) -> DataFrame:
    """Label and key of each distinct value of the reference fields, made once.

    ``existing`` (s) are nodes that are already there and get nothing new.
    """
    asked = [f for f in mapping.fields if f.kind == "reference"]
    cells = F.explode(F.array(*[F.struct(F.lit(t.ONT + f.predicate).alias("p"), F.nullif(F.trim(F.col(f.column).cast("string")), F.lit("")).alias("cell")) for f in asked]))
    rows = table.select(cells.alias("c")).select("c.*").filter("cell is not null").distinct()
    rows = rows.withColumn("node", F.concat(F.lit(f"{t.ID}ref/"), F.substring(F.sha2(F.concat(F.lit("ref:"), "p", F.lit(":"), "cell"), 256), 1, 26)))
    if existing is not None:
        rows = rows.join(existing.select(F.col("s").alias("node")).distinct(), "node", "left_anti")
    key = F.concat(F.lit("ref:"), "p", F.lit(":"), "cell")
    return t.quads(rows, F.col("node"), [t.literal_object(t.LABEL, F.col("cell"), g=mapping.graph), t.literal_object(t.EXTERNAL_KEY, key, g=mapping.graph)])


def known_keys(rows: DataFrame) -> DataFrame:
    """(key, s) of the nodes of the data graph that have an external key."""
    found = rows.filter((F.col("g") == t.DATA) & (F.col("p") == t.EXTERNAL_KEY) & (F.col("o_kind") == "literal"))
    return found.groupBy(F.col("o").alias("key")).agg(F.min("s").alias("s"))


def guess_delimiter(first_line: str) -> str:
    """Tab or comma, whichever the first line holds more of."""
    return "\t" if first_line.count("\t") > first_line.count(",") else ","


def read_delimited(spark, path: str, delimiter: str = ",") -> DataFrame:
    """A delimited file with a header; quotes may hold delimiters and line breaks."""
    return spark.read.csv(path, header=True, sep=delimiter, multiLine=True, escape='"', quote='"')
