"""The change log as a stream: patches are files, readers follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of a log folder as they arrive, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def notices(log: DataFrame) -> DataFrame:
    """One notice for each patch of a batch: seq, actor, additions, deletions."""
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    return log.groupBy("seq", "actor").agg(n("A").alias("additions"), n("D").alias("deletions"))


def windowed(log: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Changes by time window and op, closed once ``late`` has passed."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n"))


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> None:
    """Append the notices of all that has arrived to ``target``, and return.

    The checkpoint remembers what was read; a batch that is repeated after a
    failure overwrites its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        notices(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = changes(spark, folder, schema).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
