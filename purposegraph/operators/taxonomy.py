"""The is-a taxonomy (concept, instance, freq): likelihoods, top concepts, instances, chains, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.shared import Scratch

METHODS = ("likelihood", "pmi")


def with_scores(taxonomy: DataFrame, method: str = "likelihood") -> DataFrame:
    """taxonomy with score: freq over the instance's total; for pmi that over the concept's total too (no logarithm).

    Repeated (concept, instance) rows stay rows of their own. Totals are joined from pre-aggregated tables
    rather than taken over windows, so a concept with a third of all rows is no single task.
    """
    if method not in METHODS:
        raise NotImplementedError(method)
    of_instance = taxonomy.groupBy("instance").agg(F.sum("freq").alias("__i"))
    out = taxonomy.join(of_instance, "instance")
    if method == "likelihood":
        return out.withColumn("score", F.col("freq") / F.col("__i")).drop("__i")
    of_concept = taxonomy.groupBy("concept").agg(F.sum("freq").alias("__c"))
    return out.join(of_concept, "concept").withColumn("score", F.col("freq") / F.col("__c") / F.col("__i")).drop("__i", "__c")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the given total order, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def conceptualize(taxonomy: DataFrame, k: int, method: str = "likelihood") -> DataFrame:
    """The k best-scored concepts of every instance; ties by concept."""
    return top(with_scores(taxonomy, method), ["instance"], [F.desc("score"), F.asc("concept")], k)


def instantiate(taxonomy: DataFrame, k: int | None = None) -> DataFrame:
    """Instances of every concept by descending freq, ties by instance; the k first if k is given."""
    ranked = taxonomy.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("freq"), F.asc("instance"))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def best_concept(taxonomy: DataFrame) -> DataFrame:
    """(instance, concept): the likeliest concept of each instance. A pre-aggregated minimum, no window."""
    first = F.min(F.struct((-F.col("freq")).alias("f"), F.col("concept").alias("c")))
    return taxonomy.groupBy("instance").agg(first.alias("b")).select("instance", F.col("b.c").alias("concept"))


def chains(taxonomy: DataFrame, starts: DataFrame, length: int = 5) -> DataFrame:
    """(instance, depth, concept): the chain of likeliest concepts above each start, cycles included; depth 0 is the start itself.

    A start that is a concept itself is the first of the at most length concepts; another one stands before them. A start
    that is no concept and has none has no chain.
    """
    step = best_concept(taxonomy)
    concepts = taxonomy.select(F.col("concept").alias("c0")).distinct()
    rows = starts.select("instance").distinct().join(concepts, F.col("instance") == F.col("c0"), "left")
    at = F.col("instance")
    for depth in range(1, length + 1):
        nxt = step.select(F.col("instance").alias("__at"), F.col("concept").alias(f"c{depth}"))
        rows = rows.join(nxt, at == F.col("__at"), "left").drop("__at")
        at = F.col(f"c{depth}")
    most = F.when(F.col("c0").isNotNull(), length - 1).otherwise(length)
    links = F.filter(F.array(*[F.struct(F.lit(d).alias("depth"), F.when(F.lit(d) <= most, F.col(f"c{d}")).alias("concept")) for d in range(1, length + 1)]), lambda x: x["concept"].isNotNull())
    start = F.when(F.col("c0").isNotNull() | F.col("c1").isNotNull(), F.array(F.struct(F.lit(0).alias("depth"), F.col("instance").alias("concept")))).otherwise(F.array().cast("array<struct<depth:int,concept:string>>"))
    return rows.select("instance", F.explode(F.concat(start, links)).alias("x")).select("instance", "x.depth", "x.concept")


def long_chains(taxonomy: DataFrame, starts: DataFrame, length: int, cycles: bool = True) -> DataFrame:
    """chains for any length: as many joins as the logarithm of the length.

    Paths of 2 ** j likeliest concepts are made of two of 2 ** (j - 1), joined where the first ends, and stored, so the plan
    doesn't double; it stops when no path is full any more. Only what is some instance's likeliest concept has a stored path;
    an instance's chain is that of its concept, one longer. cycles=False ends a chain before the first concept that it has
    already held.
    """
    scratch = Scratch(taxonomy.sparkSession)
    best = scratch.table(best_concept(taxonomy))
    inner = best.select(F.col("concept").alias("instance")).distinct()
    # joins of stored paths are merges: repeated strings make small files, whose size would have Spark send them to the driver
    paths, full = scratch.table(best.join(inner.hint("merge"), "instance").select("instance", F.array("concept").alias("path"))), 1
    while full < length - 1 and (full == 1 or paths.where(F.size("path") == full).limit(1).count()):
        upper = paths.select(F.col("instance").alias("__end"), F.col("path").alias("__on"))
        end = F.when(F.size("path") == full, F.element_at("path", -1))  # null where a path has ended: no partner
        joined = paths.withColumn("__at", end).join(upper.hint("merge"), F.col("__at") == F.col("__end"), "left")
        paths, full = scratch.table(joined.select("instance", F.concat("path", F.coalesce("__on", F.array().cast("array<string>"))).alias("path"))), 2 * full
    scratch.drop(*scratch.paths[1:-1])
    concepts = taxonomy.select(F.col("concept").alias("c0")).distinct()
    above_ = paths.select(F.col("instance").alias("__first"), F.col("path").alias("__on"))
    rows = starts.select("instance").distinct().join(concepts, F.col("instance") == F.col("c0"), "left").join(best.hint("merge"), "instance", "left").where("c0 IS NOT NULL OR concept IS NOT NULL")
    rows = rows.join(above_.hint("merge"), F.col("concept") == F.col("__first"), "left")
    none = F.array().cast("array<string>")
    whole = F.when(F.col("concept").isNotNull(), F.concat(F.array("concept"), F.coalesce("__on", none))).otherwise(none)
    above = F.slice(whole, 1, F.when(F.col("c0").isNotNull(), length - 1).otherwise(length))
    chain = F.concat(F.array("instance"), above)
    if not cycles:
        again = lambda c: F.exists(F.transform(c, lambda x, i: F.array_position(c, x) <= i), lambda x: x)
        first = lambda c: F.array_position(F.transform(c, lambda x, i: F.array_position(c, x) <= i), F.lit(True))
        chain = tx.let(chain, lambda c: F.when(again(c), F.slice(c, 1, F.greatest(first(c).cast("int") - 1, F.lit(0)))).otherwise(c))
    return rows.select("instance", F.posexplode(chain).alias("depth", "concept"))


def sizes(taxonomy: DataFrame) -> DataFrame:
    """(concepts, instances): numbers of distinct ones."""
    return taxonomy.agg(F.countDistinct("concept").alias("concepts"), F.countDistinct("instance").alias("instances"))
