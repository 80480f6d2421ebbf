"""A corpus pipeline over ``documents``: five stages, each an operator of loomgraph.llm.

1. language: documents in which no language is found go.
2. lines: one line of each component of similar lines stays; documents that lose
   all their lines to earlier documents go with them.
3. near_duplicates: one document of each group stays.
4. mix: each source is repeated towards its target weight.
5. encode: each copy is encoded; doc_id, n_tokens and the digests of its ids and
   of the decoded bytes are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, lang_id, line_dedup, mixing, near_dedup
from loomgraph.llm._shared import Tables, boxed, unboxed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = boxed(docs, "doc_id", "text")
    out = line_dedup.dedup_lines(rows)
    # of a document that loses every line that is not blank nothing is left that is not kept elsewhere
    out = unboxed(out.filter((F.col("n_solid") > 0) | (F.col("n_kept") == F.col("n_lines"))), docs.columns, "doc_id", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = boxed(docs, "doc_id", "text", "source")
    return unboxed(mixing.repeat(mixing.mix(rows)), docs.columns, "doc_id", "text", "source")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification, line dedup and byte pairs have no SQL form.
ORACLE_SQL = None
