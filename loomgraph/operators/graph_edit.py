"""Entities, terms of the ontology, edge metadata and updates, as set operations on quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import terms as t
from ..storage import Growing, KeyTables
from . import algebra
from .fixpoint import closure

PROPERTY_TYPES = (t.OWL + "ObjectProperty", t.OWL + "DatatypeProperty", t.RDF + "Property")
STATEMENT = t.BASE + "stmt/"


def insert(rows: DataFrame, more: DataFrame) -> DataFrame:
    return t.as_set(rows.unionByName(more))


def _same(key: tuple[str, ...] = ("g", "s", "s_kind", "p", "o_key")) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.alias("a").join(gone.alias("b"), _same(), "left_anti")


def from_template(solutions: DataFrame, template: list[algebra.Pattern], g: str | None = t.DATA) -> DataFrame:
    """Quads of a template for each solution; a fourth part names the graph, ``g`` where there is none.

    Parts are variables (``?x``) or keys.  Ill-formed quads, and those with an
    unbound part, are left out.
    """
    term = lambda x: F.lit(None).cast("string") if x is None else F.col(x[1:]) if x.startswith("?") else F.lit(x)
    made = []
    for s, p, o, *graph in template:
        own = term(graph[0] if graph else None if g is None else f"<{g}>")
        made.append(F.struct(own.alias("gk"), F.lit(bool(graph)).alias("named"), term(s).alias("sk"), term(p).alias("pk"), term(o).alias("ok")))
    rows = solutions.select(F.explode(F.array(*made)).alias("x")).select("x.*")
    rows = rows.filter((S.is_iri(F.col("sk")) | S.is_blank(F.col("sk"))) & S.is_iri(F.col("pk")) & F.col("ok").isNotNull() & (~F.col("named") | S.is_iri(F.col("gk"))))
    return of_keys(rows.select(S.text(F.col("gk")).alias("g"), "sk", "pk", "ok"))


def of_keys(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Quads (as a set, see ``terms.as_set``) of a graph's plain name and the keys sk, pk and ok."""
    o, lang = F.col("ok"), F.nullif(S.lang(F.col("ok")), F.lit(""))
    kind = F.when(S.is_triple(o), "triple").when(S.is_iri(o), "iri").when(S.is_blank(o), "bnode").otherwise("literal")
    quoted = F.struct(S.text(S.subject(o)).alias("s"), S.text(S.predicate(o)).alias("p"), S.object_(o).alias("o_key"))
    plain = rows.select(
        "g", algebra.text(F.col("sk")).alias("s"), F.when(S.is_blank(F.col("sk")), "bnode").otherwise("iri").alias("s_kind"), S.text(F.col("pk")).alias("p"),
        F.when(~S.is_triple(o), algebra.text(o)).alias("o"), kind.alias("o_kind"), S.datatype(o).alias("o_dt"), lang.alias("o_lang"),
        F.when(S.is_triple(o), quoted).cast(t.TRIPLE).alias("o_triple"), o.alias("o_key"),
    )
    return t.as_set(plain, parts)


def update(rows: DataFrame, solutions: DataFrame, gone: list[algebra.Pattern], made: list[algebra.Pattern], g: str | None = t.DATA) -> DataFrame:
    """DELETE {gone} INSERT {made} WHERE: all deletions of the solutions come before all insertions."""
    left = delete(rows, from_template(solutions, gone, g)) if gone else rows
    return insert(left, from_template(solutions, made, g)) if made else left


def clear(rows: DataFrame, graph: str | None = None, named: bool = False) -> DataFrame:
    """Without one graph, without all named graphs, or (None) without the default graph."""
    if named:
        return rows.filter(F.col("g").isNull())
    return rows.filter(F.col("g").isNotNull()) if graph is None else rows.filter(~F.col("g").eqNullSafe(F.lit(graph)))


def replace_graph(rows: DataFrame, graph: str, made: DataFrame) -> DataFrame:
    """``rows`` with the quads of ``made`` as the whole of one graph."""
    return clear(rows, graph).unionByName(t.as_set(made.withColumn("g", F.lit(graph))))


def copy_graph(rows: DataFrame, source: str, target: str, add: bool = False, move: bool = False) -> DataFrame:
    """COPY, ADD (keeps the target's quads) and MOVE (drops the source's)."""
    copied = rows.filter(F.col("g") == source).withColumn("g", F.lit(target))
    kept = rows if add else clear(rows, target)
    return insert(clear(kept, source) if move else kept, copied)


def delete_entity(rows: DataFrame, node: str) -> DataFrame:
    """All quads that have the node as subject or object, in every graph, are left out."""
    return rows.filter(~((F.col("s") == node) & (F.col("s_kind") == "iri")) & ~F.coalesce((F.col("o") == node) & (F.col("o_kind") == "iri"), F.lit(False)))


def set_value(rows: DataFrame, node: str, predicate: str, text: str, lang: str | None = None) -> DataFrame:
    """Replace all values of one property of a node in the data graph."""
    old = (F.col("g") == t.DATA) & (F.col("s") == node) & (F.col("p") == predicate)
    one = rows.sparkSession.createDataFrame([(node, text)], "s string, v string")
    return rows.filter(~F.coalesce(old, F.lit(False))).unionByName(t.quads(one, F.col("s"), [t.literal_object(predicate, F.col("v"), lang=lang)]))


def rename_term(rows: DataFrame, old: str, new: str) -> DataFrame:
    """A term's own quads in the ontology graph, without its labels, and all quads
    that point at it take the new IRI; its uses as a predicate stay."""
    own = (F.col("s") == old) & (F.col("g") == t.ONTOLOGY)
    rows = rows.filter(~(F.coalesce(own, F.lit(False)) & F.col("p").isin(t.LABEL, t.PREF_LABEL)))
    points = F.coalesce((F.col("o") == old) & (F.col("o_kind") == "iri"), F.lit(False))
    return t.as_set(rows.withColumns({
        "s": F.when(own, new).otherwise(F.col("s")), "o": F.when(points, new).otherwise(F.col("o")),
        "o_key": F.when(points, f"<{new}>").otherwise(F.col("o_key")),
    }))


def class_parents(rows: DataFrame) -> DataFrame:
    """(iri, parents) of every class of the ontology graph; roots have no parent."""
    own = rows.filter((F.col("g") == t.ONTOLOGY) & (F.col("s_kind") == "iri"))
    is_property = F.max(F.when((F.col("p") == t.TYPE) & F.col("o").isin(*PROPERTY_TYPES), 1).otherwise(0))
    parents = F.sort_array(F.collect_set(F.when((F.col("p") == t.RDFS + "subClassOf") & (F.col("o_kind") == "iri"), F.col("o"))))
    return own.groupBy(F.col("s").alias("iri")).agg(is_property.alias("prop"), parents.alias("parents")).filter("prop = 0").drop("prop")


def class_forest(rows: DataFrame) -> DataFrame:
    """(root, path, iri, depth): every class at each place that it has below a root; path leads from the root to it.

    A class with several parents has a place below each.  Parents that are no
    classes of the ontology do not count; a class is not repeated below itself,
    and if all lie on cycles, each is a root.
    """
    tables = KeyTables(rows.sparkSession, "forest")
    terms = tables.cut(class_parents(rows), "classes")
    links = terms.select(F.explode("parents").alias("parent"), F.col("iri").alias("child")).filter("parent <> child")
    links = tables.cut(links.join(terms.select(F.col("iri").alias("parent")), "parent", "left_semi"), "links")
    roots = tables.cut(terms.select("iri").join(links.select(F.col("child").alias("iri")), "iri", "left_anti"), "roots")
    roots = terms.select("iri") if roots.isEmpty() else roots
    first = roots.select(F.col("iri").alias("root"), F.array("iri").alias("path"), "iri", F.lit(0).alias("depth"))
    grown = Growing(tables, "places", first.schema)
    front = grown.add(first)
    while not front.isEmpty():
        below = front.join(links, front["iri"] == links["parent"]).filter(~F.array_contains("path", F.col("child")))
        front = grown.add(below.select("root", F.array_append("path", F.col("child")).alias("path"), F.col("child").alias("iri"), (F.col("depth") + 1).alias("depth")))
    return grown.read()


def descendants(rows: DataFrame, cls: str) -> DataFrame:
    """The class and everything below it: iri."""
    edges = rows.filter((F.col("p") == t.RDFS + "subClassOf") & (F.col("o_kind") == "iri")).select(F.col("o").alias("a"), F.col("s").alias("b"))
    seed = rows.sparkSession.createDataFrame([(cls,)], "a string")
    return closure(edges, reflexive=True, seeds=seed).select(F.col("b").alias("iri")).distinct()


def instance_counts(rows: DataFrame) -> DataFrame:
    """Direct instances of each class in the data graph: cls, n."""
    typed = rows.filter((F.col("g") == t.DATA) & (F.col("p") == t.TYPE) & (F.col("o_kind") == "iri"))
    return typed.groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))


def candidate_properties(rows: DataFrame, cls: str) -> DataFrame:
    """Properties whose domain holds the class, and those without a domain: iri, label."""
    own = rows.filter((F.col("g") == t.ONTOLOGY) & (F.col("s_kind") == "iri"))
    found = own.groupBy(F.col("s").alias("iri")).agg(
        F.max((F.col("p") == t.TYPE) & F.coalesce(F.col("o").isin(*PROPERTY_TYPES), F.lit(False))).alias("prop"),
        F.collect_set(F.when(F.col("p") == t.RDFS + "domain", F.col("o"))).alias("domain"),
    )
    found = found.filter(F.col("prop") & ((F.size("domain") == 0) | F.array_contains("domain", cls)))
    return found.join(t.labels(own).withColumnRenamed("s", "iri"), "iri", "left").select("iri", F.coalesce("label", t.local_name(F.col("iri"))).alias("label"))


def range_mismatch(rows: DataFrame) -> DataFrame:
    """Edges whose target has none of the classes in the property's range: s, p, o."""
    ranges = rows.filter((F.col("g") == t.ONTOLOGY) & (F.col("p") == t.RDFS + "range")).groupBy(F.col("s").alias("p")).agg(F.collect_set("o").alias("range"))
    types = rows.filter((F.col("p") == t.TYPE) & (F.col("o_kind") == "iri")).groupBy(F.col("s").alias("o")).agg(F.collect_set(F.col("o")).alias("types"))
    edges = rows.filter((F.col("g") == t.DATA) & (F.col("o_kind") == "iri")).select("s", "p", "o")
    joined = edges.join(ranges, "p").join(types, "o", "left")
    return joined.filter(~F.coalesce(F.arrays_overlap("types", "range"), F.lit(False))).select("s", "p", "o")


def entity_cards(rows: DataFrame) -> DataFrame:
    """(iri, label, types, comment) of every subject, over all graphs."""
    types = F.sort_array(F.collect_set(F.when((F.col("p") == t.TYPE) & (F.col("o_kind") == "iri"), F.col("o"))))
    label = F.min(F.when(F.col("p").isin(t.PREF_LABEL, t.LABEL), F.struct((F.col("p") == t.LABEL).alias("r"), "o")))
    comment = F.min(F.when(F.col("p") == t.COMMENT, F.col("o")))
    return rows.filter("s_kind = 'iri'").groupBy(F.col("s").alias("iri")).agg(F.coalesce(label.getField("o"), t.local_name(F.first("s"))).alias("label"), types.alias("types"), comment.alias("comment"))


def annotate(edges: DataFrame, fields: dict[str, Column], g: str = t.DATA) -> DataFrame:
    """Metadata quads of edges (s, p, o_key): a reifier named by a hash of the triple.

    ``fields`` maps predicates to columns; an edge on which all are null gets nothing.
    """
    triple = F.concat_ws(" ", t.iri_key(F.col("s")), t.iri_key(F.col("p")), "o_key")
    reifier = F.concat(F.lit(STATEMENT), F.substring(F.sha2(triple, 256), 1, 26))
    given = F.coalesce(*[c.cast("string") for c in fields.values()]).isNotNull()
    parts = [t.triple_object(t.REIFIES, F.col("s"), F.col("p"), F.col("o_key"), g)]
    parts += [t.literal_object(p, c.cast("string"), t.infer_datatype(c.cast("string")), g=g) for p, c in fields.items()]
    return t.as_set(t.quads(edges.filter(given), reifier, parts))


def annotations(rows: DataFrame, predicates: list[str]) -> DataFrame:
    """(s, p, o_key, one column for each predicate): metadata of every reified triple.

    Reifiers are found by what they reify; of several values the one of the
    last reifier counts.
    """
    stated = rows.filter((F.col("p") == t.REIFIES) & (F.col("o_kind") == "triple")).select(F.col("s").alias("r"), F.col("o_triple.s").alias("s"), F.col("o_triple.p").alias("p"), F.col("o_triple.o_key").alias("o_key"))
    said = rows.filter(F.col("p").isin(predicates)).select(F.col("s").alias("r"), F.col("p").alias("field"), "o")
    both = stated.join(said, "r")
    columns = [F.max_by(F.when(F.col("field") == p, F.col("o")), F.when(F.col("field") == p, F.col("r"))).alias(t_name(p)) for p in predicates]
    return both.groupBy("s", "p", "o_key").agg(*columns)


def t_name(predicate: str) -> str:
    return predicate.rsplit("#", 1)[-1].rsplit("/", 1)[-1]
