"""States of a log that are kept aside, so that a later state is made from one of them and the changes since.

A folder of snapshots has a catalogue: a table with a row for each state that was
written (what = ``kept``) and for each one that was given up (``gone``).  What is
there is a query over it, so is what may go; a state without a row is one whose
writing did not end, and is never read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import changelog

_ROW = "name string, seq long, made_at timestamp, what string"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _note(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, _ROW).coalesce(1).write.mode("append").parquet(f"{folder}/catalogue")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """seq, name and made_at of the states that are there; of several with one seq the one that was written last."""
    path, store = _path(spark, folder, "catalogue")
    noted = spark.read.schema(_ROW).parquet(str(path)) if store.exists(path) else spark.createDataFrame([], _ROW)
    there = noted.groupBy("name", "seq").agg(F.min("made_at").alias("made_at"), F.max(F.col("what") == "gone").alias("gone")).filter("not gone")
    return there.groupBy("seq").agg(F.max_by("name", F.struct("made_at", "name")).alias("name"), F.max("made_at").alias("made_at"))


def keep(state: DataFrame, folder: str, seq: int) -> None:
    """Write a state as that after change ``seq``; an earlier one of this number is there until the new one is complete."""
    if seq < 0:
        raise ValueError("changes are numbered from 0 on")
    name = f"{seq}-{uuid.uuid4().hex[:12]}"
    state.write.parquet(f"{folder}/states/{name}")
    _note(state.sparkSession, folder, [(name, seq, datetime.now(timezone.utc), "kept")])


def surplus(states: DataFrame, most: int) -> DataFrame:
    """The rows of a catalogue that are not among the ``most`` newest states."""
    if most < 0:
        raise ValueError("a number of states is at least 0")
    newest = F.row_number().over(Window.orderBy(F.desc("seq")))
    return states.withColumn("nth", newest).filter(F.col("nth") > most).drop("nth")


def give_up(spark: SparkSession, folder: str, states: DataFrame) -> list[int]:
    """Note that states of a catalogue are gone, then delete them; returns their numbers in order."""
    rows = sorted(states.select("seq", "name", "made_at").collect())  # a row for each state that was ever kept, at most
    if rows:
        _note(spark, folder, [(r["name"], r["seq"], r["made_at"], "gone") for r in rows])
    for r in rows:
        path, store = _path(spark, folder, "states", r["name"])
        store.delete(path, True)
    return [r["seq"] for r in rows]


def due(seq: int, now: float, last: tuple[int, float], changes: int | None = None, seconds: float | None = None) -> bool:
    """Whether a state should be kept at change ``seq``, given number and time of the last one (or of the start).

    It should after so many changes, or so many seconds, whichever is asked for and comes first.
    """
    if changes is not None and changes < 1:
        raise ValueError("changes: at least one between two states")
    if seconds is not None and seconds <= 0:
        raise ValueError("seconds: some time between two states")
    return (changes is not None and seq - last[0] >= changes) or (seconds is not None and now - last[1] >= seconds)


def restore(log: DataFrame, key: list[str], folder: str, seq: int) -> DataFrame:
    """The state after change ``seq``, from the newest kept one that is not after it and the changes since."""
    spark = log.sparkSession
    start = catalogue(spark, folder).filter(F.col("seq") <= seq).agg(F.max(F.struct("seq", "name")).alias("s")).select("s.*").first()
    if start["seq"] is None:
        return changelog.restore(log, key, seq)
    return changelog.restore(log, key, seq, spark.read.parquet(f"{folder}/states/{start['name']}"), start["seq"])
