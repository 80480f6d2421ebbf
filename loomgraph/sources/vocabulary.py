"""Vocabularies as graphs of their own, read from a folder of Turtle files (or folders) named for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from . import turtle


def load(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Quads of ``<folder>/<name>.ttl``, each vocabulary in the graph named for it."""
    return t.union(*[turtle.read(spark, f"{folder}/{name}.ttl", graph=t.VOCAB + name) for name in names])


def loaded(rows: DataFrame) -> DataFrame:
    """(name, n): the vocabularies that are there, and their numbers of quads."""
    return rows.filter(F.col("g").startswith(t.VOCAB)).groupBy(F.substring("g", len(t.VOCAB) + 1, 1 << 30).alias("name")).agg(F.count("*").alias("n"))
