"""Quads in a folder: one part for each graph and predicate, replaced graph by graph.

A commit writes the graphs that it changes into a folder of its own, divided by
graph and predicate, and then names them in a manifest; readers take each graph
from the last commit that named it.  A read of some graphs or predicates opens
their parts only, and what a commit does not name is neither read nor written.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import graph_edit
from ..storage import Manifest

#: Name of the graph without a name, among the parts.
DEFAULT = "default:"
_PARTS = ("commit_", "graph_", "p")


def _graph(column: Column) -> Column:
    return F.coalesce(column, F.lit(DEFAULT))


class QuadStore:
    """A store of quads in ``folder``, which may be any folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = Manifest(spark, self.folder, "seq long, commit string, graph string, quads long")

    def current(self) -> DataFrame:
        """graph, seq, commit and quads of each graph that is there; at most a row for each graph."""
        last = self.manifest.read().groupBy("graph").agg(F.max(F.struct("seq", "commit", "quads")).alias("m")).select("graph", "m.*")
        return last.filter("commit is not null")

    def seq(self) -> int:
        """Number of the last commit, 0 before the first."""
        return self.manifest.read().agg(F.max("seq")).first()[0] or 0

    def read(self, graphs: list[str | None] | None = None) -> DataFrame:
        """The quads of all graphs, or of those named (None: the default graph)."""
        there = self.current()
        if graphs is not None:
            there = there.filter(F.col("graph").isin([DEFAULT if g is None else g for g in graphs]))
        commits: dict[str, list[str]] = {}
        for r in there.select("commit", "graph").collect():
            commits.setdefault(r["commit"], []).append(r["graph"])
        empty = graph_edit.of_keys(self.spark.createDataFrame([], "g string, sk string, pk string, ok string"))
        if not commits:
            return empty
        fields = [f for f in empty.schema.fields if f.name not in ("g", "p")]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} string" for c in _PARTS)])
        # one condition on the parts: the planner leaves out the folders of all others
        own = reduce(Column.__or__, [(F.col("commit_") == c) & F.col("graph_").isin(names) for c, names in commits.items()])
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/quads").filter(own)
        return rows.select(F.nullif("graph_", F.lit(DEFAULT)).alias("g"), *[c for c in empty.columns if c != "g"])

    def replace(self, rows: DataFrame, graphs: list[str | None], base: int | None = None) -> int:
        """Make ``rows`` all that the graphs named hold, and return the commit's number.

        A graph without rows is gone afterwards.  Rows of a graph that is not
        named are an error.  ``base`` is the number of the commit that the rows
        were made from: if there is a later one that touched a graph named, it is
        an error, and nothing is changed.
        """
        names = [DEFAULT if g is None else g for g in graphs]
        last = self.seq()
        if base is not None and not self.manifest.read().filter((F.col("seq") > base) & F.col("graph").isin(names)).isEmpty():
            raise ValueError(f"a graph was changed after commit {base}")
        commit = uuid.uuid4().hex[:16]
        wrong = F.raise_error(F.concat(F.lit("not a graph of this commit: "), _graph(F.col("g"))))
        checked = F.when(_graph(F.col("g")).isin(names), _graph(F.col("g"))).otherwise(wrong)
        divided = t.as_set(rows).withColumns({"commit_": F.lit(commit), "graph_": checked}).drop("g")
        # files of even size; a predicate with very many quads has several
        divided.hint("rebalance", "graph_", "p").write.mode("append").partitionBy(*_PARTS).parquet(f"{self.folder}/quads")
        made = {}
        if not divided.isEmpty():
            written = self.spark.read.parquet(f"{self.folder}/quads/commit_={commit}")
            made = {r["graph_"]: r["n"] for r in written.groupBy("graph_").agg(F.count("*").alias("n")).collect()}
        self.manifest.add([(last + 1, commit if n in made else None, n, made.get(n, 0)) for n in names])
        return last + 1

    def change(self, graph: str | None, add: DataFrame | None = None, remove: DataFrame | None = None) -> int:
        """Take quads from one graph and add others; only this graph is read and written."""
        base = self.seq()
        rows = self.read([graph])
        if remove is not None:
            rows = graph_edit.delete(rows, remove)
        if add is not None:
            rows = graph_edit.insert(rows, add.withColumn("g", F.lit(graph).cast("string")).select(*rows.columns))
        return self.replace(rows, [graph], base)

    def sweep(self) -> int:
        """Delete the parts of graphs that no reader takes any more; returns how many."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        old = self.manifest.read().filter("commit is not null").select("commit", "graph").join(self.current().select("commit", "graph"), ["commit", "graph"], "left_anti")
        n = 0
        for r in old.distinct().collect():
            part = path(f"{self.folder}/quads/commit_={r['commit']}/graph_={_escaped(self.spark, r['graph'])}")
            store = part.getFileSystem(self.spark._jsc.hadoopConfiguration())
            n += bool(store.exists(part) and store.delete(part, True))
        return n


def _escaped(spark: SparkSession, name: str) -> str:
    """A part's name as Spark writes it in a path."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
