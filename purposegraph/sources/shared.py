"""Intermediate tables in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; only where executors are threads of this process may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/purposegraph-{spark.sparkContext.applicationId}"


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """How many parts of about bytes_each the input makes, by Catalyst's size estimate (for file scans the files' bytes).

    Where Spark has no estimate, the session's number of shuffle partitions. Sizes tasks only.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // bytes_each))


class Scratch:
    """Parquet tables written on the way to a result. close() deletes those that no result reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        """df written and read back: lineage ends there, and lost executors cost no more than their tasks."""
        path = f"{folder(self.spark)}/{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes these tables."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths = [p for p in self.paths if p not in names]

    def close(self, keep: int = 0) -> None:
        """Deletes all but the last `keep` tables."""
        self.drop(*self.paths[: len(self.paths) - keep])
