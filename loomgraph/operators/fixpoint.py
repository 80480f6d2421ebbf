"""Loops to a fixed point: closure, search by levels, shortest paths.

Each round is one plan over the edges and the last round's new rows; its result
is written below the shared folder and read back, so the lineage stays short.
KeyTables that grow are appended to, never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Growing, KeyTables


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir``, without its lineage."""
    return KeyTables(df.sparkSession, "cut").cut(df)


def closure(edges: DataFrame, reflexive: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """(a, b) for every b that edges lead to from a; safe on cycles.

    Without ``seeds`` paths double in length each round, so a chain of n edges
    takes about log2(n) rounds; with ``seeds`` (a) only their paths are followed.
    """
    tables = KeyTables(edges.sparkSession, "closure")
    edges = tables.cut(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    grown = Growing(tables, "known", edges.schema)
    delta = grown.add(edges if seeds is None else edges.join(seeds.select("a").distinct(), "a", "left_semi"))
    while not delta.isEmpty():
        known = grown.read()
        step = (known if seeds is None else edges).select(F.col("a").alias("b"), F.col("b").alias("c"))
        made = delta.join(step, "b").select("a", F.col("c").alias("b"))
        if seeds is None:
            made = made.union(known.join(delta.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        delta = grown.add(made.distinct().join(known, ["a", "b"], "left_anti"))
    known = grown.read()
    if reflexive:
        nodes = (edges.select("a").union(edges.select(F.col("b").alias("a"))) if seeds is None else seeds.select("a")).distinct()
        known = known.union(nodes.select("a", F.col("a").alias("b"))).distinct()
    return known


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) of either direction; component is the smallest node of it.

    Every node points at the smallest of its neighbours and itself; pointers are
    followed by doubling, and what is left between the nodes they end at is the
    next, smaller graph.
    """
    tables = KeyTables(edges.sparkSession, "components")
    left = tables.cut(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "edges")
    at = tables.cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "at")
    left = tables.cut(left.filter("a <> b"), "left")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        point = tables.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "point")
        while True:
            ahead = point.select(F.col("a").alias("to"), F.col("to").alias("further"))
            jumped = tables.cut(point.join(ahead, "to").select("a", F.col("further").alias("to")), "point")
            still = jumped.join(point, ["a", "to"], "left_anti").isEmpty()
            point = jumped
            if still:
                break
        end = lambda c: point.select(F.col("a").alias(c), F.col("to").alias(f"{c}_"))
        left = tables.cut(left.join(end("a"), "a").join(end("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")).filter("a <> b").distinct(), "left")
        moved = at.join(point.select(F.col("a").alias("component"), "to"), "component", "left")
        at = tables.cut(moved.select("node", F.coalesce("to", "component").alias("component")), "at")
    return at


def levels(edges: DataFrame, start: DataFrame, depth: int, enough: int | None = None) -> DataFrame:
    """(start, node, level) within ``depth`` steps of each row of ``start`` (start), by breadth.

    With ``enough``, no level is expanded once the levels before it hold that many rows.
    """
    tables = KeyTables(edges.sparkSession, "levels")
    edges = tables.cut(edges.select("a", "b").distinct(), "edges")
    first = start.select("start", F.col("start").alias("node"), F.lit(0).alias("level")).distinct()
    grown = Growing(tables, "seen", first.schema)
    front, held = grown.add(first), 0
    for level in range(1, depth + 1):
        if enough is not None:
            held += front.count()
            if held >= enough:
                break
        found = front.join(edges, front["node"] == edges["a"]).select("start", F.col("b").alias("node")).distinct()
        front = grown.add(found.join(grown.read(), ["start", "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
    return grown.read()


def incident(rows: DataFrame, type_iri: str) -> DataFrame:
    """Edges between IRIs of all graphs, in both directions: a, p, b, forward."""
    ends = rows.filter((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri") & (F.col("p") != type_iri)).select("s", "p", "o").distinct()
    there = ends.select(F.col("s").alias("a"), "p", F.col("o").alias("b"), F.lit(True).alias("forward"))
    return there.union(ends.select(F.col("o").alias("a"), "p", F.col("s").alias("b"), F.lit(False).alias("forward")))


def neighbourhood(rows: DataFrame, start: str, type_iri: str, depth: int = 1, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, level) around ``start`` and the edges (a, p, b) among the steps taken.

    ``depth`` is held between 1 and 5.  Nodes are admitted by level, then by IRI,
    up to ``most``; edges from an expanded node to one left out are kept.
    """
    depth = min(5, max(1, depth))
    edges = incident(rows, type_iri)
    seeds = rows.sparkSession.createDataFrame([(start,)], "start string")
    reached = levels(edges, seeds, depth, most).select("node", "level")
    nodes = cut(reached.orderBy("level", "node").limit(most))
    steps = edges.join(nodes.filter(F.col("level") < depth).select(F.col("node").alias("a")), "a", "left_semi")
    one = F.when(F.col("forward"), F.struct("a", "p", "b")).otherwise(F.struct(F.col("b").alias("a"), "p", F.col("a").alias("b")))
    return nodes, steps.select(one.alias("e")).select("e.*").distinct()


def shortest_path(rows: DataFrame, start: str, goal: str, type_iri: str, hops: int = 5) -> DataFrame | None:
    """Steps (step, a, p, b, forward) of a shortest undirected path, None if there is
    none within ``hops`` (held between 1 and 8); no step if both ends are one node.

    Two searches, from either end, go on level by level until one meets the other.
    The one whose last level has fewer edges goes next, so a node with very many
    edges is expanded only if the other side has even more.
    """
    hops = min(8, max(1, hops))
    spark = rows.sparkSession
    schema = "step int, a string, p string, b string, forward boolean"
    if start == goal:
        return spark.createDataFrame([], schema)
    tables = KeyTables(spark, "path")
    edges = tables.cut(incident(rows, type_iri), "edges")
    kind = "node string, from_ string, p string, forward boolean, level int"
    width = lambda front: edges.join(front.select(F.col("node").alias("a")), "a", "left_semi").count()
    sides = []
    for end in (start, goal):
        first = spark.createDataFrame([(end, None, None, None, 0)], kind)
        grown = Growing(tables, "seen", first.schema)
        front = grown.add(first)
        sides.append({"grown": grown, "front": front, "size": width(front), "level": 0})
    meeting = None
    while meeting is None and sides[0]["level"] + sides[1]["level"] < hops:
        own, other = sorted(sides, key=lambda side: side["size"])
        own["level"] += 1
        ends = own["front"].select(F.col("node").alias("a"))
        best = edges.join(ends, "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "p", "forward")).alias("m"))
        fresh = best.join(own["grown"].read().select("node"), "node", "left_anti")
        own["front"] = own["grown"].add(fresh.select("node", F.col("m.a").alias("from_"), "m.p", "m.forward", F.lit(own["level"]).alias("level")))
        if own["front"].isEmpty():
            return None
        own["size"] = width(own["front"])
        # the other side's earlier levels were met before, so what both have seen now lies on its last one
        meeting = own["front"].select("node").join(other["grown"].read().select("node"), "node", "left_semi").agg(F.min("node")).first()[0]
    if meeting is None:
        return None

    def back(side: dict) -> list[tuple]:
        """The steps from the meeting to the side's end: node, the one before it, p and forward."""
        seen, node, out = side["grown"].read(), meeting, []
        while True:  # at most eight look-ups
            r = seen.filter(F.col("node") == node).first()
            if r["from_"] is None:
                return out
            out.append((node, r["from_"], r["p"], r["forward"]))
            node = r["from_"]

    path = [(a, p, b, forward) for b, a, p, forward in reversed(back(sides[0]))]
    path += [(a, p, b, not forward) for a, b, p, forward in back(sides[1])]
    return spark.createDataFrame([(k + 1, *step) for k, step in enumerate(path)], schema)


def describe(rows: DataFrame, node: str, depth: int = 1, layout: str = "urn:kg:layout") -> DataFrame:
    """Quads about a node: its own, those of blank nodes below it, and up to ``depth``
    steps of IRIs; all named graphs but the layout."""
    rows = rows.filter(F.col("g").isNotNull() & (F.col("g") != layout))
    first = rows.sparkSession.createDataFrame([(node, depth)], "s string, budget int")
    grown = Growing(KeyTables(rows.sparkSession, "describe"), "seen", first.schema)
    front = grown.add(first)
    while True:
        step = rows.filter(F.col("o_kind").isin("iri", "bnode")).join(front, "s")
        budget = F.when(F.col("o_kind") == "bnode", F.col("budget")).otherwise(F.col("budget") - 1)
        made = step.select(F.col("o").alias("s"), budget.alias("budget")).filter("budget > 0").groupBy("s").agg(F.max("budget").alias("budget"))
        old = grown.read().groupBy("s").agg(F.max("budget").alias("old"))
        front = grown.add(made.join(old, "s", "left").filter("old is null or old < budget"))
        if front.isEmpty():
            return rows.join(grown.read().select("s").distinct(), "s", "left_semi")
