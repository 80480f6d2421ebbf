"""What a task or the driver holds does not grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import terms as t
from loomgraph.operators.fixpoint import cut
from loomgraph.sources import jsonld, turtle
from tests.test_queries import FOLDER


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_many_keys_are_not_broadcast(spark):
    key = F.concat(F.lit("<https://kg.example/id/customer/"), F.col("id").cast("string"), F.lit(">"))
    many, few = cut(spark.range(300_000).select(key.alias("node"))), cut(spark.range(10).select(key.alias("node")))
    assert "Broadcast" not in _plan(many.join(many.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left_semi"))
    assert "BroadcastHashJoin" in _plan(many.join(few, "node"))


def test_turtle_is_read_bit_by_bit():
    text = "\n".join(f"<urn:x:{i}> <urn:p> {i} ." for i in range(100))
    sizes = [len(x) for x in turtle._Reader(text, t.BASE, "d").batches(30)]
    assert sum(sizes) == 100 and max(sizes) == 30
    block = turtle._Reader("<urn:g> { " + text + " }", t.BASE, "d").batches(30)
    assert [len(x) for x in block] == [30, 30, 30, 10]


def test_turtle_is_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turtle, "FILE_NODES", 10)
    rows = t.quads(spark.range(50), F.concat(F.lit("urn:x:"), F.col("id").cast("string")), [t.literal_object(t.LABEL, F.lit("x"))])
    turtle.write(rows, str(tmp_path / "d"))
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "d").glob("part-*")) <= 10
    assert turtle.read(spark, str(tmp_path / "d")).count() == 50


def test_quads_are_dealt_over_as_many_parts_as_are_asked_for(spark):
    rows = spark.createDataFrame([('{"@id":"urn:x","urn:p":1}',)] * 3, "value string")
    found = jsonld.parse(rows, parts=7)
    assert found.count() == 1 and "hashpartitioning" in _plan(found) and ", 7)" in _plan(found)


def test_a_roundtrip_is_compared_without_a_join(spark):
    from loomgraph.plans.catalogue import QUERIES

    assert "Join" not in _plan(QUERIES["nquads_roundtrip"](spark, FOLDER))
