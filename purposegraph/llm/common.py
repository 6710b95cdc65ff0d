"""Shared-folder tables, sizing from plan statistics, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import parts_for as parts_for

#: Lower-cases A-Z only, on UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words as the contracts define them, for Java's regular expressions.
WORD = r"[^ \t-\r]+"
#: Rows of one Arrow batch are handled in slices of about so many bytes of text.
SLICE_BYTES = 4 << 20


#: What stash() and blocks.stored() have written, in order: paths and names of catalog tables.
_made: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: the session's spark.checkpoint.dir. One of our own only where that is unset and the
    executors are threads of this process; elsewhere each would write to its own disk, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/purposegraph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


def stash(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables have been stashed so far, for sweep()."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables stashed from mark `since` on; call when no result that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for kind, name in _made[since:]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    del _made[since:]


def spare(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(column: str) -> Column:
    """The column of exactly that name, whatever is in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(df: DataFrame, *made: str) -> list[str]:
    """df's columns but for those that results replace."""
    taken = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in taken]


def as_row(columns: list[str]) -> Column:
    """The columns as one struct, out of the way of whatever else a table is to hold."""
    return F.struct(*[named(c) for c in columns]) if columns else F.struct(F.lit(True).alias("none"))


def from_row(columns: list[str], row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def let(value: Column, body) -> Column:
    """Binds an expression to a lambda variable, so that it is computed once per row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def trim() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can: workers of many stages live side by side."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def slices(texts: list, limit: int = SLICE_BYTES):
    """(from, to) ranges of about limit characters; a longer text is a slice of its own."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


#: Ids that are broadcast at most: 16 MB of longs.
FEW_IDS = 2_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids (a stashed table of one long), to be broadcast if they are at most FEW_IDS, so that what they are joined to isn't
    moved; beyond that the join shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): for every vertex of an undirected edge list, the smallest vertex of its component.

    Smallest-label propagation with pointer jumping, so long chains take a logarithmic number of rounds.
    Each round is two joins of stored tables (hot vertices are split by adaptive skew joins) and its labels
    are written to the shared folder. Nothing but the number of changed labels comes to the driver.
    """
    one = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    both = stash(one.union(one.select("y", "x")).distinct())
    labels = stash(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("l")))
    while True:
        near = both.join(labels, both.y == labels.v).groupBy("x").agg(F.min("l").alias("m"))
        hooked = stash(near.join(labels, near.x == labels.v).select("v", F.least("l", "m").alias("l"), F.col("l").alias("old")))
        up = hooked.select(F.col("v").alias("pv"), F.col("l").alias("pl"))
        jumped = stash(hooked.join(up, F.col("l") == F.col("pv")).select("v", F.least("l", "pl").alias("l"), "old"))
        changed = jumped.where("l <> old").limit(1).count()
        labels = jumped.select("v", "l")
        if not changed:
            return labels.select("v", F.col("l").alias("root"))
