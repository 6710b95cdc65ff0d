"""Ranked lexical search: TPUT (three-phase uniform threshold) over postings partitioned by term."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash
from .terms import chunks, collected, numbered, split, term_column

#: Terms of items that are searched for at once: what is broadcast, some 10 MB. More make further rounds over the texts.
SEARCH_TERMS = 100_000
#: Parts that the terms' lists fall into.
PARTS = 32
LISTS = "block long, part int, ids array<long>, term array<int>, at array<int>, tf array<int>, n array<int>"
CUT = "block long, term array<int>, at array<int>, score array<long>"
BOUNDS = "item int, block long, at array<int>, lower array<long>, upper array<long>"


@dataclass(frozen=True)
class Query:
    """A chunk of items: their ids and terms' numbers, and the terms in the numbers' order."""

    ids: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]


@dataclass(frozen=True)
class Weights:
    """What scores are made of: documents with terms, all their terms, and the weight of each term."""

    docs: int
    total: int
    weight: np.ndarray

    def score(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        term, tf, n = (a.astype(np.int64) for a in (term, tf, n))
        m = 100 - 50 + (50 * n * self.docs) // self.total
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ints(batch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def query_of(items: list) -> Query:
    numbers: dict[bytes, int] = {}
    terms = [np.array(sorted({numbers.setdefault(t.encode(), len(numbers)) for t in r["terms"]}), dtype=np.int64) for r in items]
    return Query([r["item_id"] for r in items], terms, numbers)


def posted(docs: DataFrame, query: Query) -> DataFrame:
    """The lists of the query's terms: for each block of documents and part of the terms one row of postings, sorted by term.

    A posting is the document's place in its block, the term's count there and the document's number of terms. The rows
    of part -1 have the documents' ids and numbers of terms instead.
    """
    width = -(-len(query.numbers) // PARTS) or 1

    def run(batches):
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch, lo, hi, texts in collected(batches, 1):
            block += 1
            ids, keys = batch.column(0).slice(lo, hi - lo), []
            sizes = np.zeros(len(texts), dtype=np.int32)
            for k, t in enumerate(texts):
                words = split(t)
                sizes[k] = len(words)
                term = numbered(words, query.numbers)
                keys.append(term[term >= 0] * len(texts) + k)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            term, at = np.divmod(key, len(texts))
            edges = np.searchsorted(term, np.arange(0, PARTS + 1) * width)
            rows = [(-1, ids.to_pylist(), [], [], [], sizes)]
            rows += [(p, [], term[a:b].astype(np.int32), at[a:b].astype(np.int32), tf[a:b].astype(np.int32), sizes[at[a:b]]) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
            columns = [pa.array([block] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))]
            columns += [pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in range(2, 6)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "ids", "term", "at", "tf", "n"])

    return docs.mapInArrow(run, LISTS)


def weighed(lists: DataFrame, query: Query) -> Weights:
    """Statistics over all documents: two sums, and a count for each of the query's terms."""
    n = F.aggregate("n", F.struct(F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("total")), lambda a, x: F.struct((a["docs"] + (x > 0).cast("long")).alias("docs"), (a["total"] + x).alias("total")))
    sums = lists.where("part = -1").select(n.alias("x")).agg(F.sum("x.docs").alias("docs"), F.sum("x.total").alias("total")).first()
    terms = len(query.numbers)

    def counted(batches):
        df = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for i in range(len(batch)):
                df += np.bincount(ints(batch, "term", i), minlength=terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term])], names=["term", "df"])

    docs = sums["docs"] or 0
    weights = np.zeros(terms, dtype=np.int64)
    for r in lists.where("part >= 0").select("term").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[r["term"]] = weight(docs, r["df"])
    return Weights(docs, sums["total"] or 1, weights)


def best_of(term: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each term."""
    order = np.lexsort((-score, term))
    starts = np.flatnonzero(np.diff(term[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def heads(lists: DataFrame, weights: Weights, k: int) -> DataFrame:
    """(term, block, at, score): the k highest postings of each list; each task sends k of a term at most."""

    def run(batches):
        kept = [np.zeros(0, dtype=np.int64)] * 4
        for batch in batches:
            for i in range(len(batch)):
                term, at = ints(batch, "term", i).astype(np.int64), ints(batch, "at", i).astype(np.int64)
                score = weights.score(term, ints(batch, "tf", i), ints(batch, "n", i))
                some = np.flatnonzero(score > 0)
                some = some[best_of(term[some], score[some], k)]
                new = [term[some], np.full(len(some), batch.column("block")[i].as_py()), at[some], score[some]]
                kept = [np.concatenate(c) for c in zip(kept, new, strict=True)]
            best = best_of(kept[0], kept[3], k)
            kept = [c[best] for c in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array(kept[1]), pa.array(kept[2], pa.int32()), pa.array(kept[3])], names=["term", "block", "at", "score"])

    sent = lists.where("part >= 0").select("block", "term", "at", "tf", "n").mapInArrow(run, "term int, block long, at int, score long")
    return top(sent, "term", [F.desc("score"), F.col("block"), F.col("at")], k)


def top(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each `by`, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def kth(values: DataFrame, items: int, k: int) -> np.ndarray:
    """The k-th highest score of each item, 1 where there are fewer: no document below it is among the best k."""
    out = np.ones(items, dtype=np.int64)
    for r in top(values, "item", [F.desc("score")], k).where(F.col("rank") == k).select("item", "score").collect():  # a row for each item
        out[r["item"]] = max(1, r["score"])
    return out


def starts_of(term: np.ndarray, terms: int) -> np.ndarray:
    return np.searchsorted(term, np.arange(terms + 1))


def cut(lists: DataFrame, weights: Weights, least: np.ndarray) -> DataFrame:
    """What the second phase fetches: from each list the postings of at least the least threshold of its items, from the highest on."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(len(batch)):
                term = ints(batch, "term", i)
                score = weights.score(term, ints(batch, "tf", i), ints(batch, "n", i))
                some = np.flatnonzero(score >= least[term])
                some = some[np.lexsort((-score[some], term[some]))]
                out.append((term[some], ints(batch, "at", i)[some], score[some]))
            columns = [batch.column("block"), *[pa.array([o[c] for o in out], pa.list_(pa.int32())) for c in (0, 1)], pa.array([o[2] for o in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "term", "at", "score"])

    return lists.where("part >= 0").select("block", "term", "at", "tf", "n").mapInArrow(run, CUT)


def joined(table: pa.Table, *names: str) -> list[np.ndarray]:
    """The rows' lists one after another, in order of terms; a term's postings lie in one row."""
    columns = [table.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def bounded(fetched: DataFrame, query: Query, highest: np.ndarray, floor: np.ndarray) -> DataFrame:
    """(item, block, at, lower, upper): documents that can reach the item's floor by what has been fetched.

    An item of m terms takes postings of at least floor / m. lower is their sum; for each of the item's lists that the
    document wasn't met in, upper adds what a posting there can have at most: less than floor / m, and no more than the list's highest.
    """
    terms = len(highest)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        term, at, score = joined(table, "term", "at", "score")
        start = starts_of(term, terms)
        size = int(at.max()) + 1 if len(at) else 0
        found = []
        for item, own in enumerate(query.terms):
            rest = np.minimum((floor[item] - 1) // max(1, len(own)), highest[own])
            lower, met = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            for t, r in zip(own.tolist(), rest.tolist(), strict=True):
                a, b = start[t], start[t + 1]
                b = a + int(np.searchsorted(-score[a:b], -r, side="left"))  # those above what is left out
                lower[at[a:b]] += score[a:b]  # a document is once in a list
                met[at[a:b]] += r
            upper = lower + rest.sum() - met
            some = np.flatnonzero((lower > 0) & (upper >= floor[item]))
            if len(some):
                found.append((item, some, lower[some], upper[some]))
        columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())), *[pa.array([f[c] for f in found], pa.list_(pa.int64())) for c in (2, 3)]]
        return pa.table(columns, names=["item", "block", "at", "lower", "upper"])

    return fetched.groupBy("block").applyInArrow(run, BOUNDS)


def looked_up(lists: DataFrame, candidates: DataFrame, query: Query, weights: Weights, floor: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): exact scores of the candidates (item, block, at), looked up in all the item's lists; of each block the best k and ties."""
    terms = len(weights.weight)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(left) and len(right):
            part = left.column("part").to_numpy()
            ids = left.column("ids")[int(np.flatnonzero(part == -1)[0])].as_py()
            term, at, tf, n = joined(left.filter(pa.array(part >= 0)), "term", "at", "tf", "n")
            score, start = weights.score(term, tf, n), starts_of(term, terms)
            for item, places in zip(right.column("item").to_pylist(), right.column("at").to_pylist(), strict=True):
                total, wanted = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
                wanted[places] = True
                for t in query.terms[item].tolist():
                    a, b = start[t], start[t + 1]
                    hit = wanted[at[a:b]]
                    total[at[a:b][hit]] += score[a:b][hit]
                some = np.flatnonzero(total >= floor[item])
                if len(some) > k:
                    some = some[total[some] >= np.partition(total[some], -k)[-k]]
                out[0].extend([item] * len(some))
                out[1].extend(ids[i] for i in some.tolist())
                out[2].extend(total[some].tolist())
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["item", "doc_id", "score"])

    return lists.groupBy("block").cogroup(candidates.select("block", "item", "at").groupBy("block")).applyInArrow(run, "item int, doc_id long, score long")


def searched(docs: DataFrame, query: Query, k: int) -> DataFrame:
    spark = docs.sparkSession
    lists = stash(posted(docs, query))
    weights = weighed(lists, query)
    of_items = spark.createDataFrame([(i, int(t)) for i, own in enumerate(query.terms) for t in own], "item int, term int")  # bounded by the chunk
    first = stash(heads(lists, weights, k).drop("rank"))
    highest = np.zeros(len(query.numbers), dtype=np.int64)
    for r in first.groupBy("term").agg(F.max("score").alias("score")).collect():
        highest[r["term"]] = r["score"]
    # phase 1: sums over the lists' heads give a lower bound of the k-th best
    floor = kth(first.join(of_items, "term").groupBy("item", "block", "at").agg(F.sum("score").alias("score")), len(query.ids), k)
    # phase 2: one threshold for all lists of an item
    least = np.full(len(query.numbers), np.iinfo(np.int64).max)
    for item, own in enumerate(query.terms):
        least[own] = np.minimum(least[own], (floor[item] - 1) // max(1, len(own)) + 1)
    bounds = stash(bounded(cut(lists, weights, least), query, highest, floor))
    best = bounds.select("item", F.explode(F.slice(F.sort_array("lower", asc=False), 1, k)).alias("score"))
    floor = np.maximum(floor, kth(best, len(query.ids), k))
    # phase 3: exact scores of what can still be among the best k
    floors = spark.createDataFrame([(i, int(f)) for i, f in enumerate(floor)], "item int, floor long")
    both = F.filter(F.arrays_zip("at", "upper"), lambda x: x["upper"] >= F.col("floor"))
    candidates = bounds.join(floors, "item").select("item", "block", F.transform(both, lambda x: x["at"]).alias("at")).where(F.size("at") > 0)
    scored = looked_up(lists, candidates, query, weights, floor, k)
    ranked = top(scored, "item", [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
    names = spark.createDataFrame([(i, None if x is None else int(x)) for i, x in enumerate(query.ids)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents (doc_id, text) of the highest score above 0, equal scores by doc_id.

    Terms are as in terms.py; the score is the weighted, saturated and length-normalised count of the item's terms, in
    whole numbers. A document's terms are counted once into lists by term, cut into blocks of documents, so that a term that
    all documents hold is no hot key. First the lists' heads give a lower bound of the k-th score, then all lists are
    read down to that bound over the item's number of terms, and what can still be among the best by bounds is looked up
    exactly. Nothing is left out: the bounds are sure, and lists are never cut by number. SEARCH_TERMS terms of items are
    searched for at once, which bounds what is broadcast; more items make further passes over the texts.

    Null texts have no terms. Rows with equal ids are documents of their own, null ids come last among equal scores. Items of one id are one item with
    the terms of all; those without terms, or without a document that scores, have no rows. Further columns are dropped.
    """
    terms = items.select("item_id", F.explode(term_column(F.col("text"))).alias("t")).groupBy("item_id").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    out = None
    for part in chunks(terms, F.size("terms"), SEARCH_TERMS):
        found = searched(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), query_of(part.collect()), k)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
