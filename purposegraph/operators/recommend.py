"""Rating prediction: error measures over runs, and trainable baselines on pyspark.ml."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import networks


def rmse(predicted: DataFrame, prediction: str = "prediction", actual: str = "rating") -> DataFrame:
    """Root of the mean squared error over rows whose actual value isn't zero."""
    return predicted.where(F.col(actual) != 0).agg(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(actual), 2))).alias("rmse"))


def test_at_best(history: DataFrame) -> DataFrame:
    """(run, step, valid, test): of each run the test error at the least validation error, the first on ties."""
    return history.groupBy("run").agg(F.min(F.struct("valid", "step", "test")).alias("x")).select("run", "x.step", "x.valid", "x.test")


def over_runs(best: DataFrame) -> DataFrame:
    """Mean and population deviation of the runs' test errors."""
    return best.agg(F.avg("test").alias("mean"), F.stddev_pop("test").alias("std"))


def report(best: DataFrame) -> DataFrame:
    """One row (results, mean, std): the runs' test errors in order of runs, with their mean and population deviation. Runs are few by design."""
    results = F.transform(F.array_sort(F.collect_list(F.struct("run", "test"))), lambda x: x["test"])
    return best.agg(results.alias("results"), F.avg("test").alias("mean"), F.stddev_pop("test").alias("std"))


def train_factors(ratings: DataFrame, rank: int = 32, iterations: int = 10, seed: int = 42):
    """Matrix factorisation of (user, item, rating) with numbered users and items; unknown ones predict nothing."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, maxIter=iterations, regParam=0.1, seed=seed, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop").fit(ratings)


def train_wide_deep(train: DataFrame, valid: DataFrame, test: DataFrame, users: int, items: int, frozen=None, hidden: tuple[int, ...] = (64, 32), size: int = 32, **settings) -> DataFrame:
    """(run, step, valid, test): a wide and deep network on numbered (user, item, rating), frozen item features beside the trained vectors; settings as for networks.train."""
    shape = networks.Shape(users, items, size, 0 if frozen is None else frozen.shape[1], hidden)
    return networks.history(networks.train(train, shape, frozen, **settings), shape, valid, test, frozen, settings.get("seed", 42))


def train_collaborative(train: DataFrame, valid: DataFrame, test: DataFrame, users: int, items: int, hidden: tuple[int, ...] = (100, 64, 32), size: int = 32, **settings) -> DataFrame:
    """(run, step, valid, test): neural collaborative filtering without a linear part; no hidden layers mean the dot product of the vectors."""
    shape = networks.Shape(users, items, size, 0, hidden, wide=False)
    return networks.history(networks.train(train, shape, **settings), shape, valid, test, seed=settings.get("seed", 42))


def grid(**choices) -> list[dict]:
    """All combinations of hyper-parameter choices."""
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def batches(rows: DataFrame, key, size: int, seed: int = 42) -> DataFrame:
    """rows with a batch number, in hashed order within buckets: shuffled batches of about `size` without a global sort."""
    n = F.count("*")
    total = rows.agg(n.alias("n")).first()["n"]
    return rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(1, -(-total // size)))).cast("int"))
