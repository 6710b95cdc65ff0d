"""A store of the keys that have been answered: bucketed by key, appended to, and asked by anti join without being shuffled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, batch long"


class KeyCache:
    """Keys under a folder, in a fixed number of buckets that the folder's name keeps, so any session opens it again by its path.

    `missing` joins new prompts with the stored keys bucket by bucket: only the prompts are shuffled, however large the store
    is. `add` appends a batch's keys; the files of a bucket grow in number until `compact` makes one of them. A batch that is run
    again after a failure finds its own keys not in its way: keys count as cached for later batches only, and are added once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.root = spark, path.rstrip("/")
        versions = self._folders()
        self.buckets = int(versions[-1].split("-")[1]) if versions else buckets
        self._open(versions[-1] if versions else f"{0:08d}-{buckets}")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folders(self) -> list[str]:
        """Names of the complete versions, the latest last: a version is complete once a file named like it and `.done` lies beside it."""
        _, fs, where = self._fs()
        names = {s.getPath().getName() for s in fs.listStatus(where)} if fs.exists(where) else set()
        return sorted(n for n in names if f"{n}.done" in names)

    def _open(self, version: str) -> None:
        jvm, fs, _ = self._fs()
        self.version, self.location = version, f"{self.root}/{version}"
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(self.location))
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.location}.done"), True).close()
        self.name = self._declare(self.location)

    def _declare(self, location: str) -> str:
        name = f"keys_{uuid.uuid4().hex}"
        place = location.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return name

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, prompts: DataFrame, batch: int | None = None) -> DataFrame:
        """Prompts whose key is not cached, or was cached by this very batch. Null keys are never cached."""
        known = self.keys()
        if batch is not None:
            known = known.where(~F.col("batch").eqNullSafe(F.lit(batch)))
        # the merge hint keeps the buckets; a broadcast of keys is not wanted at any size
        return prompts.join(known.select("key").hint("merge"), "key", "left_anti")

    def add(self, rows: DataFrame, batch: int | None = None) -> None:
        """Appends the distinct keys of rows that aren't there yet. One task writes a bucket, so each batch adds a file for each bucket."""
        new = rows.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
        new = new.join(self.keys().select("key").hint("merge"), "key", "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        new.repartition(self.buckets, "key").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """The same keys as one file for each bucket, in a new version; another number of buckets may be chosen as the store grows.
        Readers of the old version go on until it is deleted, which `compact` does last."""
        jvm, fs, _ = self._fs()
        old_name, old, rows = self.name, self.location, self.keys()
        self.buckets = buckets or self.buckets
        version = f"{int(self.version.split('-')[0]) + 1:08d}-{self.buckets}"
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{version}")
        fs.delete(fresh, True)  # what a compaction that failed has left
        fs.mkdirs(fresh)
        name = self._declare(f"{self.root}/{version}")
        rows.repartition(self.buckets, "key").write.insertInto(name)
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{version}.done"), True).close()
        self.spark.catalog.refreshTable(name)
        self.version, self.location, self.name = version, f"{self.root}/{version}", name
        self.spark.sql(f"DROP TABLE {old_name}")
        for gone in (f"{old}.done", old):
            fs.delete(jvm.org.apache.hadoop.fs.Path(gone), True)

    def close(self) -> None:
        """Forgets the table's name; the keys stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
