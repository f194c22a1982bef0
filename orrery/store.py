"""Tables written to the folder that driver and executors share.

Iterative plans cut their lineage here. A written Parquet table is compressed, keeps column
pruning, and outlives the executor that wrote it, so a lost executor costs a re-read and no
recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new local one only where it is unset and all of Spark is one process."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Scratch:
    """The tables of one run of an operator. They go when the application ends, or by `drop`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, at = _fs(spark, self.base)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def write(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        """Write df as Parquet, with the writer's options, and read it back: the plan above this starts at the files.

        Spark is asked to delete the shuffle files of this write when it is done; the session's own setting holds again after it.
        """
        path = f"{self.base}/{table}"
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        fs, at = _fs(self.spark, f"{self.base}/{table}")
        fs.delete(at, True)
