"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stash
from .minhash import MULTIPLIERS, mixed

#: Vectors of one block that are compared at once.
BLOCK = 1024


class Hasher:
    """Keys of normalised vectors in several tables; each joins quantised random projections floor((a.x + b) / width).

    With width 1.6 two vectors at cosine 0.98 (distance 0.2) agree in one projection with probability 0.90, in all
    12 of a table with 0.28, and in none of 40 tables with 2e-6.
    """

    def __init__(self, dims: int, tables: int, projections: int, width: float, seed: int = 11):
        draw = np.random.default_rng([seed, dims])
        self.tables, self.width = tables, width
        self.a = draw.standard_normal((dims, tables * projections))
        self.b = draw.uniform(0, width, tables * projections)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) 64-bit keys."""
        cells = np.floor((unit @ self.a + self.b) / self.width).astype(np.int64).astype(np.uint64).reshape(len(unit), self.tables, -1)
        out = np.broadcast_to(np.arange(self.tables, dtype=np.uint64) * MULTIPLIERS[6], cells.shape[:2]).copy()
        for k in range(cells.shape[2]):
            out = mixed(out + cells[:, :, k] * MULTIPLIERS[k % 8] + np.uint64(k))
        return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows over their length, scaled first so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def hashed(rows: DataFrame, tables: int, projections: int, width: float, kind: str = "<f8") -> DataFrame:
    """(vec_id, cls, label, vec, keys): cls names label and vector, null where the vector links with nothing; vec has numbers of that kind, which holds them exactly."""

    def run(batches):
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            labels, vectors = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            good = [x is not None and y is not None and len(y) > 0 and None not in y and all(map(math.isfinite, y)) and any(y) for x, y in zip(labels, vectors, strict=True)]
            cls: list = [None] * len(labels)
            vecs: list = [None] * len(labels)
            keys: list = [None] * len(labels)
            by_size: dict[int, list[int]] = {}
            for i, ok in enumerate(good):
                if ok:
                    by_size.setdefault(len(vectors[i]), []).append(i)
            for dims, at in by_size.items():
                if dims not in hashers:
                    hashers[dims] = Hasher(dims, tables, projections, width)
                x = np.array([vectors[i] for i in at], dtype=np.float64) + 0.0
                for i, v, k in zip(at, x, hashers[dims].keys(unit_rows(x)), strict=True):
                    name = f"{labels[i]}|{dims}".encode()
                    salt = np.uint64(xxhash.xxh3_64_intdigest(name))
                    cls[i], vecs[i], keys[i] = xxhash.xxh3_128_digest(name + b"|" + v.tobytes()), v.astype(kind).tobytes(), mixed(k ^ salt).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), batch.column(1), pa.array(vecs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "cls", "label", "vec", "keys"])

    return rows.mapInArrow(run, "vec_id long, cls binary, label string, vec binary, keys array<long>")


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return x @ y.T >= least


def compared(members: DataFrame, least: float, kind: str = "<f8") -> DataFrame:
    """(a, b, links) from the cells of buckets: links of vector a found here, counting copies, and a spanning edge (a, b).

    members: (key, cell, side, table, rep, m, vec, keys, label), sorted by (key, cell) within partitions; side tells which of a
    cell's two blocks a row is in, 0 for both. A pair counts only in the first table that brings it together.
    """

    def cell(rows: list) -> list[tuple[int, int, int]]:
        labels: dict[str, int] = {}
        rep = np.array([r[0] for r in rows])
        weight = np.array([r[1] for r in rows])
        x = unit_rows(np.stack([np.frombuffer(r[2], kind) for r in rows]).astype(np.float64))
        label = np.array([labels.setdefault(r[6], len(labels)) for r in rows])
        keys = np.stack([r[3] for r in rows])
        side = np.array([r[4] for r in rows])
        table = rows[0][5]
        links = np.zeros(len(rows), dtype=np.int64)
        root = np.arange(len(rows))
        near = np.empty((len(rows), len(rows)), dtype=bool)
        for lo in range(0, len(rows), BLOCK):
            near[lo : lo + BLOCK] = _linked(x[lo : lo + BLOCK], x, least)
        np.fill_diagonal(near, False)
        near &= label[:, None] == label[None, :]  # keys hold the label's hash only
        if side.any():  # two different blocks: only pairs across
            near &= side[:, None] != side[None, :]
        for i in np.flatnonzero(near.any(axis=1)):
            js = np.flatnonzero(near[i])
            root[i] = min(root[i], js[0])
            fresh = js if not table else js[~(keys[js, :table] == keys[i, :table]).any(axis=1)]
            links[i] = weight[fresh].sum()
        # smallest labels spread over the block until they settle: spanning edges only
        while True:
            lower = root.copy()
            for i in np.flatnonzero(near.any(axis=1)):
                lower[i] = min(root[i], root[near[i]].min())
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        return [(int(rep[i]), int(rep[root[i]]), int(links[i])) for i in range(len(rows)) if links[i] or root[i] != i]

    def run(batches):
        group: tuple | None = None
        rows: list = []
        out: list[tuple[int, int, int]] = []

        def flush():
            if len(rows) > 1:
                out.extend(cell(rows))
            rows.clear()

        def batch_of():
            cols = list(zip(*out, strict=True)) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

        for batch in batches:
            k, c, side, table, rep, m, vec, keys, label = (batch.column(i) for i in range(9))
            flat = keys.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            for i, (kk, cc, s, t, r, mm, name) in enumerate(zip(*(col.to_pylist() for col in (k, c, side, table, rep, m, label)), strict=True)):
                if (kk, cc) != group:
                    flush()
                    group = (kk, cc)
                rows.append((r, mm, vec[i].as_py(), flat[i], s, t, name))
            if out:
                yield batch_of()
        flush()
        yield batch_of()

    return members.mapInArrow(run, "a long, b long, links long")


def near_duplicates(rows: DataFrame, least: float = 0.98, tables: int = 40, projections: int = 12, width: float = 1.6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links at cosine >= least in doubles among rows of one label.

    Rows with equal label and vector are one class with a count, so thousands of copies are one vector in the tables.
    Each bucket is cut into blocks of 1,024 classes, and every two blocks of it meet in a cell of their own, so a
    bucket of any size is compared whole by many tasks of bounded size; a cell gives counts and spanning edges,
    never all pairs. Keys of all tables travel along, so that a pair is counted in one table only.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing.
    Vectors of different length aren't compared. Rows that share a vec_id are one vertex for components; their
    own copies count as links. A null vec_id links with nothing, has no component and is kept.
    """
    source = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    seen = stash(hashed(source, tables, projections, width, kind))
    full = seen.where("cls is not null and vec_id is not null")
    counted = stash(full.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    firsts = full.withColumnRenamed("vec_id", "id").withColumnRenamed("cls", "c").dropDuplicates(["id", "c"])
    classes = stash(counted.join(firsts, (F.col("rep") == F.col("id")) & (F.col("cls") == F.col("c"))).select("cls", "rep", "m", "vec", "keys", "label"))
    spread = classes.select("cls", F.posexplode("keys").alias("table", "key"))
    buckets = stash(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    placed = spread.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi"), F.when(F.col("block") == o, 0).when(F.col("block") < o, 1).otherwise(2).alias("side")))
    cells = placed.select("cls", "table", "key", F.explode(met).alias("x")).select("cls", "table", "key", (F.col("x.lo").cast("long") * 2**31 + F.col("x.hi")).alias("cell"), F.col("x.side").alias("side"))
    with_vectors = cells.join(classes, "cls").select("key", "cell", "side", "table", "rep", "m", "vec", "keys", "label")
    dealt = with_vectors.repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = stash(compared(dealt, least, kind))
    links = stash(found.groupBy("a").agg(F.sum("links").alias("links")))
    labels = components(found)
    per_class = counted.join(links, counted["rep"] == links["a"], "left").join(labels, counted["rep"] == labels["v"], "left")
    per_class = stash(per_class.select(F.col("cls").alias("c"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    joined = seen.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cls")).alias("cls")).join(per_class, F.col("cls") == F.col("c"), "left")
    return joined.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
