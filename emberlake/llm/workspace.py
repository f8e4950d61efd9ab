"""Tables kept between the steps of an operator, in the folder all executors share."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Frees a query's shuffle files when it ends: what a step has written is read again, never its shuffles.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only: other executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="emberlake-")
        shared_dir.own = found
    return found.rstrip("/")


@contextmanager
def freed(spark: SparkSession):
    """Queries that run in it free their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Workspace:
    """Written tables cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            self._delete(df._workspace_path)

    def clear(self) -> None:
        """Deletes all its tables, when what was made of them has been written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(df: DataFrame, factor: int = 4) -> int:
    """How many groups to deal packed rows to: grows with the cluster's partitions and with the input's."""
    spark = df.sparkSession
    return max(factor * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def slices_by_size(df: DataFrame, each: int = 8 << 20, least: int = 64) -> int:
    """How many groups to deal a table's contents to, by its size alone: about `each` bytes of its files in a group."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:  # unknown
        size = 4 * each * df.rdd.getNumPartitions()
    return max(least, -(-size // each))

