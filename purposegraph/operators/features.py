"""Text and graph features of items, triples, and translation embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vx


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, features): the element-wise mean of each key's vectors. Sums by element are combined before the shuffle, so a hot key is cheap."""
    at = df.select(F.col(key).alias("key"), F.posexplode(vector).alias("i", "x"))
    means = at.groupBy("key", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("features"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, idx): distinct values numbered from 1, by the first three hex digits of their md5, then value; 0 stands for unknown.

    Values are numbered within the 4,096 cells of their md5 and offset by the cells before, so no task sorts them all.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("__c", F.substring(F.md5(F.col("value").cast("string")), 1, 3))
    cells = values.groupBy("__c").agg(F.count("*").alias("n"))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(cells.select("__c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__b")))  # 4,096 rows at most
    own = F.row_number().over(Window.partitionBy("__c").orderBy("value"))
    return values.withColumn("__own", own).join(offsets, "__c").select("value", (F.col("__b") + F.col("__own")).cast("long").alias("idx"))


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    """df with the column's number, 0 where unknown."""
    known = vocab.select(F.col("value").alias(column), F.col("idx").alias(out))
    return df.join(known, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def with_features(df: DataFrame, key: str, features: DataFrame, size: int) -> DataFrame:
    """df with its key's features, zeros where there are none."""
    return df.join(features.select(F.col("key").alias(key), "features"), key, "left").withColumn("features", vx.filled(F.col("features"), size))


def with_known(edges: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(edges with their key's vector, keys without one): a missing vector is reported, not guessed."""
    have = vectors.select(F.col("key").alias(key), "features")
    return edges.join(have, key), edges.join(have, key, "left_anti").select(key).distinct()


def triples(edges: DataFrame) -> DataFrame:
    """(head, relation, tail): one for each edge (asin_1, asin_2, eventuality, relations) and relation; repeated ones stay."""
    return edges.select(F.col("asin_1").alias("head"), F.explode(F.map_keys("relations")).alias("relation"), F.col("asin_2").alias("tail"), "eventuality")


def above(edges: DataFrame, plausible: float, typical: float | None = None) -> DataFrame:
    """Edges whose plausibility, and typicality if given, reach the thresholds."""
    out = edges.where(F.col("plausibility") >= plausible)
    return out if typical is None else out.where(F.col("typicality") >= typical)


def negatives(numbered: DataFrame, entities: int, seed: int = 42) -> DataFrame:
    """numbered triples (h, r, t) with (nh, nt): head or tail, by a hashed coin, replaced by a hashed entity. The same for the same seed."""
    pick = F.pmod(F.xxhash64(F.lit(seed), "h", "r", "t"), F.lit(entities)).cast("int")
    coin = F.pmod(F.xxhash64(F.lit(seed + 1), "h", "r", "t"), F.lit(2)) == 0
    return numbered.withColumn("nh", F.when(coin, pick).otherwise(F.col("h"))).withColumn("nt", F.when(coin, F.col("t")).otherwise(pick))


def text_vectors(texts: DataFrame, text: str, size: int = 384, embed=None) -> DataFrame:
    """(key, features): texts as vectors. embed: a picklable function from a list of texts to vectors, run on Arrow batches of 512 at most;
    by default hashed words with signs, normalised."""

    def hashed(batch: list[str]) -> list[np.ndarray]:
        out = []
        for t in batch:
            v = np.zeros(size)
            for w in (t or "").lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                v[h % size] += 1 if h & (1 << 31) else -1
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else v)
        return out

    work = embed or hashed

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(float, v)) for v in work(part.column(0).to_pylist())], pa.list_(pa.float64()))], names=["key", "features"])

    return texts.select(F.col(text).cast("string").alias("key")).distinct().mapInArrow(run, "key string, features array<double>")


class Translation:
    """TransE by stochastic gradient: minimises max(0, margin + |h + r - t| - |h' + r - t'|), entities kept at length 1.

    fixed: vectors that are given and not trained, as those of texts; pairs: whether a head is the mean of two entities.
    """

    def __init__(self, entities: int, relations: int, size: int = 100, rate: float = 0.01, margin: float = 1.0, seed: int = 42):
        draw = np.random.default_rng(seed)
        bound = 6 / np.sqrt(size)
        self.e = draw.uniform(-bound, bound, (entities, size))
        self.r = draw.uniform(-bound, bound, (relations, size))
        self.r /= np.abs(self.r).sum(axis=1, keepdims=True)
        self.rate, self.margin, self.draw = rate, margin, draw
        self.changed: np.ndarray | slice = slice(None)  # entities whose length may not be 1

    def renormalise(self, rows: np.ndarray | slice = slice(None)) -> None:
        e = self.e[rows]
        self.e[rows] = e / np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-12)

    def step(self, h: np.ndarray, r: np.ndarray, t: np.ndarray, second: np.ndarray | None = None, text: np.ndarray | None = None) -> float:
        """One batch; second: the heads' partners; text: tails given as vectors. Returns the mean loss. Takes time by the batch, not by the entities."""
        self.renormalise(self.changed)
        entities = len(self.e)
        nh, nt = h.copy(), None if t is None else t.copy()
        wrong = self.draw.integers(0, entities, len(h))
        if text is None and self.draw.random() < 0.5:
            nt = wrong
        else:
            nh = wrong

        def gap(a, b):
            head = self.e[a] if second is None else (self.e[a] + self.e[second]) / 2
            return head + self.r[r] - (self.e[b] if text is None else text)

        good, bad = gap(h, t), gap(nh, nt)
        loss = np.maximum(0, np.abs(good).sum(axis=1) - np.abs(bad).sum(axis=1) + self.margin)
        live = (loss > 0)[:, None]
        up, down = np.sign(good) * live * self.rate, np.sign(bad) * live * self.rate
        share = 1.0 if second is None else 0.5
        np.subtract.at(self.e, h, up * share)
        np.add.at(self.e, nh, down * share)
        np.subtract.at(self.r, r, up - down)
        if text is None:
            np.add.at(self.e, t, up)
            np.subtract.at(self.e, nt, down)
        else:
            np.subtract.at(self.e, second, (up - down) * share)
        self.changed = np.unique(np.concatenate([x for x in (h, nh, t, nt, second) if x is not None]))
        return float(loss.mean())


def train_translation(numbered: DataFrame, entities: int, relations: int, group: str, size: int = 100, epochs: int = 10, batch: int = 1024, seed: int = 42) -> DataFrame:
    """(group, kind, idx, vector, loss): a TransE model for each group of triples (h, r, t), groups side by side as tasks; loss is the mean of the last epoch.

    With columns second and text, heads are the means of h and second and tails are the given vectors text, of that size. One
    model is trained by one task, as its parameters are shared; a group's triples must fit there. Steps follow the triples.
    """
    textual = {"second", "text"} <= set(numbered.columns)

    def run(table: pa.Table) -> pa.Table:
        h, r = (table.column(c).to_numpy() for c in ("h", "r"))
        t = None if textual else table.column("t").to_numpy()
        second = table.column("second").to_numpy() if textual else None
        text = np.array(table.column("text").to_pylist(), dtype=np.float64) if textual else None
        pick = lambda x, at: None if x is None else x[at]
        model = Translation(entities, relations, size, seed=seed)
        losses: list[float] = []
        for _ in range(epochs):
            losses.clear()
            order = model.draw.permutation(len(h))
            for lo in range(0, len(h), batch):
                at = order[lo : lo + batch]
                losses.append(model.step(h[at], r[at], pick(t, at), pick(second, at), pick(text, at)))
        model.renormalise()
        name, loss = table.column("g")[0].as_py(), float(np.mean(losses)) if losses else 0.0
        n, values = entities + relations, np.concatenate([model.e, model.r]).ravel()
        kinds = pa.array(["entity", "relation"]).take(pa.array(np.repeat([0, 1], [entities, relations])))
        idx, vector = np.concatenate([np.arange(entities), np.arange(relations)]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(values))
        return pa.table({"g": pa.repeat(name, n), "kind": kinds, "idx": pa.array(idx, pa.int32()), "vector": vector, "loss": np.full(n, loss)})

    ready = numbered.select(F.col(group).cast("string").alias("g"), "h", "r", *(("second", "text") if textual else ("t",)))
    return ready.groupBy("g").applyInArrow(run, "g string, kind string, idx int, vector array<double>, loss double")
