"""The driver's tables as the engine's inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generation as ops
from ..operators.parsing import Annotated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part types as concepts of part names, counted."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_type").alias("concept"), F.col("p_name").alias("instance")).agg(F.count("*").alias("freq"))


def two_level_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_taxonomy, and brands as concepts of types."""
    part = table(spark, sf_dir, "part")
    upper = part.groupBy(F.col("p_brand").alias("concept"), F.col("p_type").alias("instance")).agg(F.count("*").alias("freq"))
    return part_taxonomy(spark, sf_dir).unionByName(upper)


#: The same in SQL, as the body of a WITH clause.
TAXONOMY_SQL = "taxonomy AS (SELECT p_type AS concept, p_name AS instance, count(*) AS freq FROM part GROUP BY p_type, p_name)"
TWO_LEVEL_SQL = (
    "taxonomy AS (SELECT p_type AS concept, p_name AS instance, count(*) AS freq FROM part GROUP BY p_type, p_name "
    "UNION ALL SELECT p_brand, p_type, count(*) FROM part GROUP BY p_brand, p_type)"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of parts ordered together, the smaller key first."""
    return ops.pairs(lines(spark, sf_dir))


def category_pairs(spark: SparkSession, sf_dir: str, category: str) -> DataFrame:
    """Those of pairs() of which one part at least is of the category, and both are known."""
    return ops.pairs(lines(spark, sf_dir), items(spark, sf_dir).select("asin", (F.col("top_cate") == category).alias("wanted")))


def with_items(spark: SparkSession, sf_dir: str, found: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs of lines() with their items, in as many tasks as the pairs were found in."""
    return ops.with_items(found, meta, ops.pair_parts(lines(spark, sf_dir)))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"), F.col("p_type").alias("top_cate"))


PAIRS_SQL = "pairs AS (SELECT DISTINCT a.l_partkey AS item_a, b.l_partkey AS item_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
WITH_ITEMS_SQL = (
    PAIRS_SQL + ", full_pairs AS (SELECT item_a, item_b, a.p_name AS title_a, a.p_type AS top_cate_a, b.p_name AS title_b, b.p_type AS top_cate_b "
    "FROM pairs JOIN part a ON a.p_partkey = item_a JOIN part b ON b.p_partkey = item_b)"
)
#: Words of a sentence stand for its tokens, in lower case; tags follow from words and suffixes, tried in this order.
TAG_WORDS = (("the", "DT"), ("a", "DT"), ("of", "IN"), ("in", "IN"), ("to", "TO"), ("and", "CC"))
TAG_RULES = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("able", "JJ"), ("es", "NNS"))
#: Words that depend on the next other word, and how.
MODIFIERS = (("DT", "det"), ("JJ", "amod"), ("RB", "advmod"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parses of parsed() as rows."""
    return parsed(spark, sf_dir).rows()


def parsed(spark: SparkSession, sf_dir: str) -> Annotated:
    """(sid, tokens, pos_tags, dependencies) of all documents: lower-case runs of letters in stretches between stops, of two words and more.

    Determiners, adjectives and adverbs depend on the next word of another kind; the other words depend on the last such
    word before them ("next"); what is left behind the last of them depends on the word before it ("dep"). An Arrow map, as an
    annotator would be: words, tags and edges are found for all sentences of a batch together, on the batch's bytes.
    """
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), r"[.!?\n]+")).alias("part", "s"))
    letters = bytes(c if 97 <= c <= 122 or c == 10 else 32 for c in range(256))
    depends = dict(MODIFIERS)
    names = list(dict.fromkeys([*(t for _, t in TAG_WORDS), *(t for _, t in TAG_RULES), "NN"]))
    tags, relations = pa.array(names), pa.array([*depends.values(), "next", "dep"])
    own_tags = np.array([n not in depends for n in names])
    modifies = np.array([list(depends).index(n) if n in depends else 0 for n in names])

    def tagged(words: pa.Array) -> np.ndarray:
        """Places in names: a known word's tag, else that of the first suffix it has."""
        out = np.full(len(words), names.index("NN"))
        for end, name in reversed(TAG_RULES):
            out[pc.ends_with(words, end).to_numpy(zero_copy_only=False)] = names.index(name)
        known = pc.fill_null(pc.index_in(words, pa.array([w for w, _ in TAG_WORDS])), -1).to_numpy(zero_copy_only=False)
        return np.where(known < 0, out, np.array([names.index(t) for _, t in TAG_WORDS])[known])

    def run(batches):
        for batch in batches:
            text = np.frombuffer(b"\n".join(batch.column(1).cast("binary").to_pylist()).translate(letters), dtype=np.uint8)
            letter = text > 32
            line = np.cumsum(text == 10, dtype=np.int32)  # of each byte
            starts = np.flatnonzero(letter & np.append(True, ~letter)[:-1])
            size = np.bincount(line[starts], minlength=batch.num_rows)
            kept = np.flatnonzero(size > 1)
            inside = letter & (size > 1)[line]
            starts = starts[inside[starts]]
            offsets = np.append((np.cumsum(inside) - 1)[starts], inside.sum()).astype(np.int32)
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text[inside]))
            at, which = np.arange(len(words)), tagged(words)
            ends = np.concatenate([[0], np.cumsum(size[kept])])
            begin, end = np.repeat(ends[:-1], size[kept]), np.repeat(ends[1:], size[kept])
            own = own_tags[which]
            after = np.minimum.accumulate(np.where(own, at, len(at))[::-1])[::-1]
            before = np.concatenate([[-1], np.maximum.accumulate(np.where(own, at, -1))[:-1]])[: len(at)]
            led, last = ~own & (after < end), ~own & (after >= end)
            gov = np.where(own, before, np.where(led, after, at - 1))
            some = np.flatnonzero(gov >= begin)
            rel = np.where(own, len(MODIFIERS), np.where(last, len(MODIFIERS) + 1, modifies[which]))
            arcs = pa.StructArray.from_arrays([pa.array((gov - begin)[some], pa.int32()), pa.DictionaryArray.from_arrays(pa.array(rel[some], pa.int32()), relations), pa.array((at - begin)[some], pa.int32())], names=["gov", "rel", "dep"])
            arc_ends = np.searchsorted(some, ends)
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((ends, words), (ends, pa.DictionaryArray.from_arrays(pa.array(which, pa.int32()), tags)), (arc_ends, arcs))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), *lists], names=["sid", "tokens", "pos_tags", "dependencies"])

    rows = pieces.select(F.concat_ws(":", "doc_id", "part").alias("sid"), "s").where(F.length("s") > 2)
    return Annotated(rows, run, "sid string, tokens array<string>, pos_tags array<string>, dependencies array<struct<gov:int,rel:string,dep:int>>")


CASES = " ".join(f"WHEN t = '{w}' THEN '{n}'" for w, n in TAG_WORDS) + " " + " ".join(f"WHEN t LIKE '%{s}' THEN '{n}'" for s, n in TAG_RULES)
_DEPEND = ", ".join(f"'{t}'" for t, _ in MODIFIERS)
#: The same by joins and windows over words.
SENTENCES_SQL = rf"""
    pieces AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\n]+')) AS s, generate_subscripts(regexp_split_to_array(lower(text), '[.!?\n]+'), 1) - 1 AS part FROM documents),
    sentences AS (SELECT doc_id || ':' || part AS sid, regexp_extract_all(s, '[a-z]+') AS tokens FROM pieces WHERE len(regexp_extract_all(s, '[a-z]+')) > 1),
    nodes AS (SELECT sid, t, CASE {CASES} ELSE 'NN' END AS label, i - 1 AS v FROM (SELECT sid, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM sentences)),
    placed AS (
        SELECT sid, label, v, min(v) FILTER (label NOT IN ({_DEPEND})) OVER (PARTITION BY sid ORDER BY v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
            max(v) FILTER (label NOT IN ({_DEPEND})) OVER (PARTITION BY sid ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM nodes),
    edges AS (
        SELECT sid, after AS u, CASE label {" ".join(f"WHEN '{t}' THEN '{r}'" for t, r in MODIFIERS)} END AS label, v FROM placed WHERE label IN ({_DEPEND}) AND after IS NOT NULL
        UNION ALL SELECT sid, v - 1, 'dep', v FROM placed WHERE label IN ({_DEPEND}) AND after IS NULL AND v > 0
        UNION ALL SELECT sid, before, 'next', v FROM placed WHERE label NOT IN ({_DEPEND}) AND before IS NOT NULL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored assertions."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.when(F.col("quality") == 1, "v").otherwise("i").alias("label"), (F.col("n_chars") % 1000 / 1000.0).alias("score"))


SCORED_SQL = "scored AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'v' ELSE 'i' END AS label, n_chars % 1000 / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating, split): a customer's mean quantity of a part."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    return rows.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating"), F.min(F.col("o_orderkey") % 10).cast("int").alias("split"))


RATINGS_SQL = "ratings AS (SELECT o_custkey AS \"user\", l_partkey AS item, avg(l_quantity) AS rating, CAST(min(o_orderkey % 10) AS INT) AS split FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
