"""Property paths over quads: pairs (a, b) of keys that a path leads from and to.

A path is built from ``link``, ``inverse``, ``seq``, ``alt``, ``negated``,
``maybe``, ``star`` and ``plus``.  Sequences and alternatives keep duplicates,
as joins and unions of patterns do; ``maybe``, ``star`` and ``plus`` are sets.

A path is followed in one of three ways: as all its pairs, from given starts on,
or back from given ends.  ``match`` takes the end that a query binds, so nothing
is built that does not lie on a path from there; a closure without a bound end is
made over strongly connected components, so that cycles are not squared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..storage import Growing, KeyTables
from .fixpoint import closure


@dataclass(frozen=True)
class Path:
    """``pairs(rows)`` gives all (a, b); ``ahead(rows, starts)`` those with a in ``starts`` (a), ``back(rows, ends)`` those with b in ``ends`` (b)."""

    pairs: Callable[[DataFrame], DataFrame]
    ahead: Callable[[DataFrame, DataFrame], DataFrame]
    back: Callable[[DataFrame, DataFrame], DataFrame]

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.pairs(rows)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(t.node_key(F.col("s"), F.col("s_kind")).alias("a"), F.col("o_key").alias("b"))


def _flip(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _step(pairs: Callable[[DataFrame], DataFrame]) -> Path:
    """A path of one step, of which the given ends choose the quads."""
    return Path(pairs, lambda rows, starts: pairs(rows).join(starts, "a", "left_semi"), lambda rows, ends: pairs(rows).join(ends, "b", "left_semi").select("a", "b"))


def link(iri: str) -> Path:
    return _step(lambda rows: _pairs(rows.filter(F.col("p") == iri)))


def _named(column: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.col(rows.columns[0]).alias(column))


def inverse(path: Path) -> Path:
    return Path(
        lambda rows: _flip(path.pairs(rows)),
        lambda rows, starts: _flip(path.back(rows, _named("b", starts))),
        lambda rows, ends: _flip(path.ahead(rows, _named("a", ends))),
    )


def seq(*paths: Path) -> Path:
    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.withColumnRenamed("b", "via").join(y.withColumnRenamed("a", "via"), "via").select("a", "b")

    def ahead(rows: DataFrame, starts: DataFrame) -> DataFrame:
        found = paths[0].ahead(rows, starts)
        for path in paths[1:]:
            found = joined(found, path.ahead(rows, found.select(F.col("b").alias("a")).distinct()))
        return found

    def back(rows: DataFrame, ends: DataFrame) -> DataFrame:
        found = paths[-1].back(rows, ends)
        for path in reversed(paths[:-1]):
            found = joined(path.back(rows, found.select(F.col("a").alias("b")).distinct()), found)
        return found

    return Path(lambda rows: reduce(joined, [path.pairs(rows) for path in paths]), ahead, back)


def alt(*paths: Path) -> Path:
    return Path(
        lambda rows: reduce(DataFrame.union, [path.pairs(rows) for path in paths]),
        lambda rows, starts: reduce(DataFrame.union, [path.ahead(rows, starts) for path in paths]),
        lambda rows, ends: reduce(DataFrame.union, [path.back(rows, ends) for path in paths]),
    )


def negated(*iris: str, inverse_of: tuple[str, ...] = ()) -> Path:
    """Steps by any predicate but ``iris``; with ``inverse_of`` also backward by any but those."""

    def fn(rows: DataFrame) -> DataFrame:
        forward = _pairs(rows.filter(~F.col("p").isin(*iris)))
        if not inverse_of:
            return forward
        backward = _flip(_pairs(rows.filter(~F.col("p").isin(*inverse_of))))
        return forward.union(backward) if iris else backward

    return _step(fn)


def nodes(rows: DataFrame) -> DataFrame:
    """Every subject and object, as (a, a): the paths of length zero."""
    ends = rows.select(F.explode(F.array(t.node_key(F.col("s"), F.col("s_kind")), F.col("o_key"))).alias("a")).distinct()
    return ends.select("a", F.col("a").alias("b"))


def _same(ends: DataFrame) -> DataFrame:
    """Given ends as paths of length zero; a term has one even outside the graph."""
    a = ends.select(F.col(ends.columns[0]).alias("a"))
    return a.select("a", F.col("a").alias("b"))


def _with_ends(found: DataFrame, rows: DataFrame, given: tuple[str, ...]) -> DataFrame:
    """``found`` and the paths of length zero; terms that the query gives have one even outside the graph."""
    extra = rows.sparkSession.createDataFrame([(x, x) for x in given], "a string, b string")
    return reduce(DataFrame.union, [found, nodes(rows), extra]).distinct()


def reach(starts: DataFrame, steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) for every b that one or more steps lead to from each a of ``starts`` (a).

    ``steps(front)`` gives the pairs (a, b) of one step from the nodes of
    ``front`` (a); each round asks it for the nodes that were new in the last one,
    once for all starts that reached them.
    """
    tables = KeyTables(starts.sparkSession, "reach")
    starts = tables.cut(starts.select("a").distinct(), "starts")
    first = steps(starts).select("a", "b").distinct()
    grown = Growing(tables, "reached", first.schema)
    delta = grown.add(first)
    while not delta.isEmpty():
        front = tables.cut(delta.select(F.col("b").alias("a")).distinct(), "front")
        step = steps(front).select(F.col("a").alias("via"), "b")
        made = delta.select("a", F.col("b").alias("via")).join(step, "via").select("a", "b").distinct()
        delta = grown.add(made.join(grown.read(), ["a", "b"], "left_anti"))
    return grown.read()


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) that lie on a cycle with another node; component is the smallest of them.

    Nodes without an edge from or to one that is left are taken away first.
    Then every node learns the smallest node that leads to it; where one node's
    name has spread, those that also lead back to it are one component, and
    whoever is not settled goes on without edges between different names.
    """
    tables = KeyTables(edges.sparkSession, "components")
    left = tables.cut(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    found = []

    def spread(edges: DataFrame, names: DataFrame) -> DataFrame:
        """(node, name): the least name that edges carry to each node, its own included."""
        while True:
            said = edges.join(names.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "name")
            fresh = tables.cut(names.union(said).groupBy("node").agg(F.min("name").alias("name")), "names")
            if fresh.join(names, ["node", "name"], "left_anti").isEmpty():
                return fresh
            names = fresh

    while True:
        while True:  # what leads nowhere, or is led to from nowhere, lies on no cycle
            inner = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            inner = tables.cut(inner.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "inner")
            same = inner.count() == left.count()
            left = inner
            if same:
                break
        if left.isEmpty():
            break
        own = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        names = spread(left, own.select("node", F.col("node").alias("name")))
        # of each name, the nodes that lead back to its owner along nodes of that name
        inside = left.join(names.select(F.col("node").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("node").alias("b"), F.col("name").alias("nb")), "b")
        inside = tables.cut(inside.filter("na = nb").select("a", "b"), "inside")
        owners = tables.cut(names.filter("node = name"), "owners")
        back = tables.cut(spread(_flip(inside), owners), "back")
        whole = tables.cut(back.select("node", F.col("name").alias("component")), "found")
        found.append(whole)
        rest = inside.join(whole.select(F.col("node").alias("a")), "a", "left_anti").join(whole.select(F.col("node").alias("b")), "b", "left_anti")
        left = tables.cut(rest.select("a", "b"), "rest")
    none = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    every = reduce(DataFrame.union, found, none)
    several = every.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return tables.cut(every.join(several, "component", "left_semi").select("node", "component"), "components")


def condensed_closure(edges: DataFrame) -> DataFrame:
    """As ``closure``, over strongly connected components: the closure of what they form without cycles, then expanded."""
    tables = KeyTables(edges.sparkSession, "condensed")
    edges = tables.cut(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    member = strong_components(edges)
    if member.isEmpty():
        return closure(edges)
    of = lambda c: member.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    outer = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    outer = outer.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    loops = member.select(F.col("component").alias("a"), F.col("component").alias("b")).distinct()
    between = closure(outer.filter("a <> b").distinct()).union(outer.filter("a = b")).union(loops).distinct()
    for end in ("a", "b"):
        members = member.select(F.col("component").alias(end), F.col("node").alias("inside"))
        names = [F.coalesce("inside", end).alias(end) if c == end else F.col(c) for c in ("a", "b")]
        between = between.join(members, end, "left").select(*names)
    return between


def maybe(path: Path, given: tuple[str, ...] = ()) -> Path:
    return Path(
        lambda rows: _with_ends(path.pairs(rows), rows, given),
        lambda rows, starts: path.ahead(rows, starts).union(_same(starts)).distinct(),
        lambda rows, ends: path.back(rows, ends).union(_same(ends)).distinct(),
    )


def plus(path: Path) -> Path:
    return Path(
        lambda rows: condensed_closure(path.pairs(rows)),
        lambda rows, starts: reach(starts, lambda front: path.ahead(rows, front)),
        lambda rows, ends: _flip(reach(_named("a", ends), lambda front: _flip(path.back(rows, _named("b", front))))),
    )


def star(path: Path, given: tuple[str, ...] = ()) -> Path:
    many = plus(path)
    return Path(
        lambda rows: _with_ends(many.pairs(rows), rows, given),
        lambda rows, starts: many.ahead(rows, starts).union(_same(starts)).distinct(),
        lambda rows, ends: many.back(rows, ends).union(_same(ends)).distinct(),
    )


def match(rows: DataFrame, start: str, path: Path, end: str) -> DataFrame:
    """Solutions of ``start path end``; each end is a variable (``?x``) or a key.

    A path with a given end is followed from there only.
    """
    one = lambda column, term: rows.sparkSession.createDataFrame([(term,)], f"{column} string")
    if not start.startswith("?"):
        found = path.ahead(rows, one("a", start))
        found = found if end.startswith("?") else found.filter(F.col("b") == end)
    else:
        found = path.pairs(rows) if end.startswith("?") else path.back(rows, one("b", end))
    if start == end and start.startswith("?"):
        return found.filter("a = b").select(F.col("a").alias(start[1:]))
    return found.select(*[F.col(c).alias(x[1:]) for c, x in (("a", start), ("b", end)) if x.startswith("?")])
