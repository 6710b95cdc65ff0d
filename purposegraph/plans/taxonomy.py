"""Queries over the taxonomy of part names, types and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taxonomy as ops
from ..sources.shared import Scratch
from .tables import TAXONOMY_SQL, TWO_LEVEL_SQL, part_taxonomy, table, two_level_taxonomy


def taxonomy_likelihood_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.conceptualize(part_taxonomy(spark, sf_dir), 3).select("instance", "concept", "freq", F.round("score", 6).alias("score"), "rank")


def taxonomy_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_scores(part_taxonomy(spark, sf_dir), "pmi").select("instance", "concept", "freq", F.round("score", 9).alias("score"))


def taxonomy_instantiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.instantiate(part_taxonomy(spark, sf_dir), 5).select("concept", "instance", "freq", "rank")


def taxonomy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = two_level_taxonomy(spark, sf_dir)
    return ops.chains(tax, tax.select("instance").distinct())


def taxonomy_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sizes(two_level_taxonomy(spark, sf_dir))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as concepts of the parts they deliver and parts as concepts of their suppliers, by quantity: chains in it go on until they turn in a circle."""
    line = table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    sums = Scratch(spark).table(line.groupBy(part.alias("p"), supplier.alias("s")).agg(F.sum("l_quantity").cast("long").alias("freq")))  # read six times
    return sums.select(F.col("s").alias("concept"), F.col("p").alias("instance"), "freq").unionByName(sums.select(F.col("p").alias("concept"), F.col("s").alias("instance"), "freq"))


def taxonomy_long_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = _trade(spark, sf_dir)
    return ops.long_chains(tax, tax.select("instance").distinct(), 40)


def taxonomy_simple_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains up to the first concept that they have held already: at most as long as there are concepts, 64 here."""
    tax = _trade(spark, sf_dir)
    rows = ops.long_chains(tax, tax.select("instance").distinct(), 64, cycles=False)
    return rows.groupBy("instance").agg(F.max("depth").cast("int").alias("depth"), F.max_by("concept", "depth").alias("top"))


QUERIES = {f.__name__: f for f in (taxonomy_likelihood_topk, taxonomy_pmi, taxonomy_instantiate, taxonomy_chain, taxonomy_long_chain, taxonomy_simple_chain, taxonomy_sizes)}
_TRADE_SQL = """
        sums AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, CAST(sum(l_quantity) AS BIGINT) AS freq FROM lineitem GROUP BY 1, 2),
        taxonomy AS (SELECT s AS concept, p AS instance, freq FROM sums UNION ALL SELECT p, s, freq FROM sums),
        best AS (SELECT instance, concept FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY freq DESC, concept) AS r FROM taxonomy) WHERE r = 1)"""
ORACLES = {
    "taxonomy_likelihood_topk": f"""
        WITH {TAXONOMY_SQL},
        scored AS (SELECT *, freq / sum(freq) OVER (PARTITION BY instance) AS s FROM taxonomy),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY s DESC, concept) AS r FROM scored)
        SELECT instance, concept, freq, round(s, 6) AS score, CAST(r AS INT) AS rank FROM ranked WHERE r <= 3""",
    "taxonomy_pmi": f"""
        WITH {TAXONOMY_SQL}
        SELECT instance, concept, freq, round(freq / sum(freq) OVER (PARTITION BY concept) / sum(freq) OVER (PARTITION BY instance), 9) AS score
        FROM taxonomy""",
    "taxonomy_instantiate": f"""
        WITH {TAXONOMY_SQL},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY freq DESC, instance) AS r FROM taxonomy)
        SELECT concept, instance, freq, CAST(r AS INT) AS rank FROM ranked WHERE r <= 5""",
    "taxonomy_chain": f"""
        WITH RECURSIVE {TWO_LEVEL_SQL},
        best AS (SELECT instance, concept FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY freq DESC, concept) AS r FROM taxonomy) WHERE r = 1),
        chain AS (
            SELECT DISTINCT instance, 0 AS depth, instance AS concept, instance IN (SELECT concept FROM taxonomy) AS own FROM taxonomy
            UNION ALL SELECT c.instance, c.depth + 1, b.concept, own FROM chain c JOIN best b ON c.concept = b.instance WHERE c.depth < CASE WHEN own THEN 4 ELSE 5 END)
        SELECT instance, depth, concept FROM chain""",
    "taxonomy_long_chain": f"""
        WITH RECURSIVE {_TRADE_SQL},
        chain AS (
            SELECT instance, 0 AS depth, instance AS concept FROM best
            UNION ALL SELECT c.instance, c.depth + 1, b.concept FROM chain c JOIN best b ON c.concept = b.instance WHERE c.depth < 39)
        SELECT instance, depth, concept FROM chain""",
    "taxonomy_simple_chain": f"""
        WITH RECURSIVE {_TRADE_SQL},
        chain AS (
            SELECT instance, 0 AS depth, [instance] AS held FROM best
            UNION ALL SELECT c.instance, c.depth + 1, list_append(held, b.concept) FROM chain c JOIN best b ON held[-1] = b.instance WHERE c.depth < 63 AND NOT list_contains(held, b.concept))
        SELECT instance, max(depth) AS depth, arg_max(held[-1], depth) AS top FROM chain GROUP BY instance""",
    "taxonomy_sizes": f"""
        WITH {TWO_LEVEL_SQL}
        SELECT count(DISTINCT concept) AS concepts, count(DISTINCT instance) AS instances FROM taxonomy""",
}
