"""Tables in the folder that the driver and every executor share.

Intermediate results are cut from their lineage by writing them as Parquet
below ``spark.checkpoint.dir``, so a lost executor costs a rerun of tasks and
nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Temporary folders of local sessions, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where none is set, a temporary folder is made in local mode only; on a
    cluster the executors could not read it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can read")
        # the setting cannot be changed in a running session, so the folder is kept here
        folder = _OWN.get(spark.sparkContext.applicationId)
        if folder is None:
            folder = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="loomgraph-")
    return folder.rstrip("/")


#: Bytes on disk up to which a table of keys is broadcast; long keys that differ in a few digits take twenty times that in memory.
SMALL = 100_000


def size_on_disk(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def joinable(table: DataFrame, size: int) -> DataFrame:
    """``table``, which takes ``size`` bytes on disk, with a hint to broadcast it in joins if it is small, and else not to.

    Spark goes by the bytes on disk too, but a table of ten megabytes there may
    not fit the driver.
    """
    return table.hint("broadcast" if size <= SMALL else "merge")


def parts_of(rows: DataFrame, each: int = 100_000) -> int:
    """Into how many parts ``rows`` go, ``each`` rows a part.

    Bytes of a compressed file, or of a shuffle, say little of what its rows take in a task, so the rows are counted.
    """
    return max(1, -(-rows.count() // each))


class Tables:
    """Named Parquet tables of one run, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table as read back."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for root in {f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class KeyTables(Tables):
    """Tables of term keys, which joins take by their size on disk; ``size`` is that of all of them."""

    size = 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        table = super().cut(df, name)
        own = size_on_disk(self.spark, f"{self.root}/{self.made:03d}-{name}")
        self.size += own
        return joinable(table, own)


class Growing:
    """A table of term keys that grows by parts: what was written before is never rewritten."""

    def __init__(self, tables: Tables, name: str, schema: StructType) -> None:
        tables.made += 1
        self.spark, self.schema, self.parts, self.size = tables.spark, schema, 0, 0
        self.root = f"{tables.root}/{tables.made:03d}-{name}"

    def add(self, df: DataFrame) -> DataFrame:
        """Append ``df`` and return only its rows, as read back."""
        self.parts += 1
        path = f"{self.root}/{self.parts:04d}"
        df.select(*self.schema.names).write.parquet(path)
        own = size_on_disk(self.spark, path)
        self.size += own
        return joinable(self.spark.read.schema(self.schema).parquet(path), own)

    def read(self) -> DataFrame:
        """All rows added so far."""
        paths = [f"{self.root}/{i:04d}" for i in range(1, self.parts + 1)]
        return joinable(self.spark.read.schema(self.schema).parquet(*paths), self.size)


class Manifest:
    """An append-only table that says which folders of a store are in force.

    A folder is written first and named here when it is complete, so that readers
    see it whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, f"{folder}/manifest", schema

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, rows: DataFrame | list[tuple]) -> None:
        rows = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
        rows.coalesce(1).write.mode("append").parquet(self.path)
