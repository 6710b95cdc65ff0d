"""Rating networks: user and item vectors with frozen item features through a rectified network, a linear part, or a dot product."""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """users, items: how many; size: of their vectors; features: of the frozen ones; hidden: sizes of the rectified layers, none for a dot product alone; wide: whether a linear part is added."""

    users: int
    items: int
    size: int = 32
    features: int = 0
    hidden: tuple[int, ...] = (64, 32)
    wide: bool = True


class Network:
    """Trained by Adam on squared errors, with dropout before every layer. Parameters are in `p`, by name."""

    def __init__(self, shape: Shape, frozen: np.ndarray | None = None, rate: float = 1e-3, dropout: float = 0.0, seed: int = 42):
        self.shape, self.rate, self.dropout = shape, rate, dropout
        self.draw = np.random.default_rng(seed)
        self.frozen = np.zeros((shape.items, shape.features)) if frozen is None else frozen
        widths = [2 * shape.size + shape.features, *shape.hidden, 1]
        self.layers = len(widths) - 1 if shape.hidden else 0
        self.p = {"user": self.draw.normal(0, 0.1, (shape.users, shape.size)), "item": self.draw.normal(0, 0.1, (shape.items, shape.size)), "bias": np.zeros(1)}
        for k in range(self.layers):
            self.p[f"w{k}"], self.p[f"b{k}"] = self.draw.normal(0, np.sqrt(2 / widths[k]), (widths[k], widths[k + 1])), np.zeros(widths[k + 1])
        if shape.wide:
            self.p["wide"] = self.draw.normal(0, 0.01, widths[0])
        self.moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in self.p.items()}
        self.live = {k: np.zeros(0, dtype=np.int64) for k in ("user", "item")}  # rows that a batch has held; the others have no moments and stay as drawn
        self.steps = 0

    def _drop(self, x: np.ndarray, train: bool) -> np.ndarray:
        return (self.draw.random(x.shape) >= self.dropout) / (1 - self.dropout) if train and self.dropout else np.ones_like(x)

    def _forward(self, users: np.ndarray, items: np.ndarray, train: bool):
        x = np.concatenate([self.p["user"][users], self.p["item"][items], self.frozen[items]], axis=1)
        out = np.full(len(users), self.p["bias"][0])
        inputs, masks, h = [], [], x
        for k in range(self.layers):
            mask = self._drop(h, train)
            inputs.append(h * mask)
            masks.append(mask)
            h = inputs[-1] @ self.p[f"w{k}"] + self.p[f"b{k}"]
            h = np.maximum(h, 0) if k < self.layers - 1 else h
        if self.layers:
            out = out + h[:, 0]
        else:
            out = out + (self.p["user"][users] * self.p["item"][items]).sum(axis=1)
        mask = self._drop(x, train)
        if self.shape.wide:
            out = out + (x * mask) @ self.p["wide"]
        return out, x, inputs, masks, mask

    def predict(self, users: np.ndarray, items: np.ndarray) -> np.ndarray:
        return self._forward(users, items, False)[0]

    def gradients(self, users: np.ndarray, items: np.ndarray, ratings: np.ndarray, train: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """(mean squared error, its gradient by parameter)."""
        out, x, inputs, masks, mask = self._forward(users, items, train)
        error = out - ratings
        slope = 2 * error / len(error)
        g = {k: np.zeros(v.shape) for k, v in self.p.items()}
        g["bias"][0] = slope.sum()
        into = np.zeros_like(x)
        if self.layers:
            back = slope[:, None]
            for k in reversed(range(self.layers)):
                g[f"w{k}"], g[f"b{k}"] = inputs[k].T @ back, back.sum(axis=0)
                back = back @ self.p[f"w{k}"].T * masks[k]
                back = back * (inputs[k] > 0) if k else back
            into += back
        n = self.shape.size
        if self.shape.wide:
            g["wide"] = (x * mask).T @ slope
            into += slope[:, None] * self.p["wide"] * mask
        if not self.layers:
            into[:, :n] += slope[:, None] * self.p["item"][items]
            into[:, n : 2 * n] += slope[:, None] * self.p["user"][users]
        np.add.at(g["user"], users, into[:, :n])
        np.add.at(g["item"], items, into[:, n : 2 * n])
        return float((error * error).mean()), g

    def step(self, users: np.ndarray, items: np.ndarray, ratings: np.ndarray) -> float:
        loss, g = self.gradients(users, items, ratings)
        self.steps += 1
        self.live = {"user": np.union1d(self.live["user"], users), "item": np.union1d(self.live["item"], items)}
        for k, v in self.p.items():
            rows = self.live.get(k, slice(None))
            m, s = (x[rows] for x in self.moments[k])
            m += 0.1 * (g[k][rows] - m)
            s += 0.001 * (g[k][rows] * g[k][rows] - s)
            self.moments[k][0][rows], self.moments[k][1][rows] = m, s
            v[rows] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)
        return loss

    def packed(self) -> bytes:
        """What training has changed: the rows that batches have held, and all of the layers. The rest follows from shape and seed."""
        out = io.BytesIO()
        np.savez(out, **{k: v[self.live[k]] if k in self.live else v for k, v in self.p.items()}, **{f"live_{k}": v for k, v in self.live.items()})
        return out.getvalue()

    def load(self, data: bytes) -> Network:
        """packed() of a network of the same shape and seed, over this one's rows."""
        got = dict(np.load(io.BytesIO(data)))
        for k, v in got.items():
            if k in self.live:
                self.p[k][got[f"live_{k}"]] = v
            elif k in self.p:
                self.p[k] = v
        return self


def drawn(ratings: DataFrame, steps: int, batch: int, runs: int, seed: int = 42) -> DataFrame:
    """(run, step, user, item, rating): batches of about `batch` ratings, drawn with replacement, for every run.

    Each rating is drawn steps * batch / n times on average, the whole part of it surely, and dealt to random steps, so what a
    run reads is steps * batch rows whatever the table's size.
    """
    n = ratings.count()
    share = steps * batch / max(n, 1)
    # by hashes, so that a task that runs again draws the same
    times = F.floor(F.lit(share) + F.pmod(F.xxhash64(F.lit(seed), "run", "user", "item", "rating"), F.lit(1 << 20)) / (1 << 20)).cast("int")
    per_run = ratings.select("user", "item", "rating", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("times", times).where("times > 0")
    return per_run.select("run", "user", "item", "rating", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("run", F.pmod(F.xxhash64(F.lit(seed + 1), "run", "user", "item", "rating", "copy"), F.lit(steps)).cast("int").alias("step"), "user", "item", "rating")


def train(ratings: DataFrame, shape: Shape, frozen: np.ndarray | None = None, steps: int = 1000, batch: int = 1024, every: int = 500, runs: int = 5, rate: float = 1e-3, dropout: float = 0.0, seed: int = 42) -> DataFrame:
    """(run, step, model): every run's parameters after each `every` steps and at the end. ratings: (user, item, rating), numbered.

    Runs are tasks side by side. A run's batches stream through its task in order, so it holds a batch and the model,
    which must fit there. Rows with nulls are no ratings.
    """

    def run(batches):
        net, now, held = None, None, []

        def learn():
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return net.step(*rows)

        def shown(k: int, at: int):
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([net.packed()], pa.binary())], names=["run", "step", "model"])

        for b in batches:
            k, at, users, items, values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            edges = np.flatnonzero((np.diff(k) != 0) | (np.diff(at) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(k)], strict=True):
                if hi > lo and (int(k[lo]), int(at[lo])) != now:
                    if held:
                        learn()
                        if now[0] != k[lo]:
                            yield shown(now[0], steps)
                        elif now[1] // every != at[lo] // every:
                            yield shown(now[0], (now[1] // every + 1) * every)
                    if now is None or now[0] != k[lo]:
                        net = Network(shape, frozen, rate, dropout, seed + int(k[lo]))
                    now = (int(k[lo]), int(at[lo]))
                held.append((users[lo:hi], items[lo:hi], values[lo:hi].astype(np.float64)))
        if held:
            learn()
            yield shown(now[0], steps)

    ready = drawn(ratings.dropna(subset=["user", "item", "rating"]).select("user", "item", "rating"), steps, batch, runs, seed)
    return ready.repartition(runs, "run").sortWithinPartitions("run", "step").select("run", "step", "user", "item", "rating").mapInArrow(run, "run int, step int, model binary")


def history(models: DataFrame, shape: Shape, valid: DataFrame, test: DataFrame, frozen: np.ndarray | None = None, seed: int = 42) -> DataFrame:
    """(run, step, valid, test): the error of every stored model on both tables, root mean squared over ratings that aren't zero.

    Models are few (runs * steps / every); what training has changed in them, at most steps * batch rows, travels to the ratings with the
    function. The rows that no batch has held are drawn again in each task, for one run at a time. seed: that of train.
    """
    stored: dict[int, list[tuple[int, bytes]]] = {}
    for r in models.collect():
        stored.setdefault(r["run"], []).append((r["step"], bytes(r["model"])))

    def errors(k: int, snapshots: list[tuple[int, bytes]]):
        def run(batches):
            net = Network(shape, frozen, seed=seed + k)
            drawn_ = {x: v.copy() for x, v in net.p.items() if x not in net.live}
            ever = {x: np.zeros(0, dtype=np.int64) for x in net.live}
            for _, data in snapshots:
                got = np.load(io.BytesIO(data))
                ever = {x: np.union1d(v, got[f"live_{x}"]) for x, v in ever.items()}
            before = {x: net.p[x][v] for x, v in ever.items()}
            for b in batches:
                kind, users, items, values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                rows = []
                for at, data in snapshots:
                    net.p.update(drawn_)
                    for x, v in ever.items():
                        net.p[x][v] = before[x]
                    net.load(data)
                    for x in (0, 1):
                        m = (kind == x) & (values != 0)
                        if m.any():
                            off = net.predict(users[m], items[m]) - values[m]
                            rows.append((k, at, x, float(off @ off), int(m.sum())))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["run", "step", "kind", "squares", "n"])

        return run

    both = valid.select(F.lit(0).alias("kind"), "user", "item", F.col("rating").cast("double").alias("rating")).unionByName(test.select(F.lit(1).alias("kind"), "user", "item", F.col("rating").cast("double").alias("rating")))
    schema = "run int, step int, kind int, squares double, n long"
    parts = [both.dropna().mapInArrow(errors(k, snapshots), schema) for k, snapshots in sorted(stored.items())]
    sums = (reduce(DataFrame.unionByName, parts) if parts else both.sparkSession.createDataFrame([], schema)).groupBy("run", "step")
    error = lambda x: F.sqrt(F.sum(F.when(F.col("kind") == x, F.col("squares"))) / F.sum(F.when(F.col("kind") == x, F.col("n"))))
    return sums.agg(error(0).alias("valid"), error(1).alias("test"))
