"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Cache, coded
from .common import LOWER, components, few, slices, spare, stash

#: Shingles are spread over so many places, which two permutations of them order.
PLACES = 1 << 20
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str], cache: Cache) -> list[np.ndarray]:
    """The 64-bit hash of every word of each text, A-Z lower-cased."""
    items, flat, sizes = coded([t.encode().translate(LOWER).split() for t in texts])
    table = np.array(cache.values_of(items, lambda new: list(map(xxhash.xxh3_64_intdigest, new))), dtype=np.uint64)
    return np.split(table[flat], np.cumsum(sizes)[:-1])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(n, width)
    total = np.full(n - size + 1, size if n < width else 0, dtype=np.uint64)
    for k in range(size):
        m = MULTIPLIERS[k % 8] * np.uint64(2 * (k // 8) + 1)
        total += mixed(words[k : n - size + 1 + k] * m + np.uint64(k)) * m
    return np.unique(mixed(total))


class Circulant:
    """K signature coordinates from two permutations: one scatters the shingles, the other, shifted by k, is minimised for coordinate k.

    A shingle's K values are K neighbours in the second permutation, so a signature is a minimum over windows.
    """

    def __init__(self, k: int, seed: int = 7):
        self.k = k
        around = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([around, around[:k]]), k)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        # the first permutation acts on places; scrambled hash bits are a uniform placing already, the multiplication by an odd number permutes it
        at = (hashes * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(44)
        out = np.full(self.k, PLACES, dtype=np.uint32)
        for lo in range(0, len(at), 4096):
            np.minimum(out, self.windows[at[lo : lo + 4096]].min(axis=0), out=out)
        return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of the signature; the band's number is part of it."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64) * MULTIPLIERS[7]
    for k in range(rows.shape[1]):
        total = mixed(total + rows[:, k] * MULTIPLIERS[k % 8] + np.uint64(k))
    return total.view(np.int64)


def sketches(docs: DataFrame, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, cls, bands): cls is a 128-bit hash of the shingle set, null for an empty one. A map without shuffle."""

    def run(batches):
        sign, cache = Circulant(bands * rows), Cache()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sets, keys = [], []
            for lo, hi in slices(texts):
                sets += [shingles(w, width) for w in word_hashes(texts[lo:hi], cache)]
            keys = [band_keys(sign.signature(s), bands) if len(s) else None for s in sets]
            cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            n = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "bands"])

    source = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, cls binary, bands array<long>")


def sets_of(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(rep, set): the sorted shingle hashes as bytes."""

    def run(batches):
        cache = Cache()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                sets = [shingles(w, width).tobytes() for w in word_hashes(texts[lo:hi], cache)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sets, pa.binary())], names=["rep", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "rep long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet 100 * intersection >= percent * union."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def rooted(rows: DataFrame, column: str, steps: list[DataFrame]) -> DataFrame:
    """rows with column replaced by its root, step by step; steps have (v, root)."""
    for step in steps:
        new = step.select(F.col("v").alias("__v"), F.col("root").alias("__r"))
        rows = rows.join(new, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__r", column)).drop("__v", "__r")
    return rows


def sharing_rare(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members (rep, root, n) of different roots that can reach percent by the place of a shared shingle in both. Exact.

    With shingles in a joint order, by their number of members and then by hash, no common shingle of a pair stands before
    its first one, so the sets share at most what is left of each from there on. A set of n shingles of which r are left from
    a shingle on can thus reach percent only with sets of at most (100 + percent) / percent * r - n (its cap). A passage that
    any number of sets share stands behind what is each one's own, so its shingles leave too little. Before the join each entry is held
    against the smallest set, and the largest cap, that its shingle has under another root; both are sums by (shingle, root).
    Shingles of one member come first and need no rows.
    """

    def run(batches):
        for batch in batches:
            size = [len(x.as_buffer()) // 8 for x in batch.column(4)]
            at = np.repeat(np.arange(batch.num_rows), size)
            flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(4)]) if size else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(at)) for i in range(4)], pa.array(flat)], names=["rep", "root", "n", "own", "shingle"])

    # a doc_id that came with several texts has several sets, each of its own
    mine = (F.col("rep") == F.col("r")) & (F.length("set") == 8 * F.col("n"))
    full = members.join(sets.withColumnRenamed("rep", "r"), mine).select("rep", "root", "n", F.xxhash64("set").alias("own"), "set")
    tokens = stash(full.mapInArrow(run, "rep long, root long, n long, own long, shingle long"))
    known = stash(tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("rep", "own")
    rest = F.count("*").over(own) - F.row_number().over(own.orderBy("df", "shingle")) + 1
    cap = F.floor((100 + percent) * F.col("rest") / percent) - F.col("n")
    entries = tokens.join(known, "shingle").withColumn("rest", rest).withColumn("cap", cap).where(100 * F.col("cap") >= percent * F.col("n"))
    early = stash(entries.select("shingle", "rep", "root", "n", "cap"))
    by_root = stash(early.groupBy("shingle", "root").agg(F.min("n").alias("lo"), F.max("cap").alias("hi")))
    ends = by_root.groupBy("shingle").agg(F.min(F.struct("lo", "root")).alias("lo1"), F.max(F.struct("hi", "root")).alias("hi1"), F.count("*").alias("roots")).where("roots > 1")
    other = by_root.join(ends, "shingle").groupBy("shingle", "lo1", "hi1").agg(F.min(F.when(F.col("root") != F.col("lo1.root"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("root") != F.col("hi1.root"), F.col("hi"))).alias("hi2"))
    smallest = F.when(F.col("root") != F.col("lo1.root"), F.col("lo1.lo")).otherwise(F.col("lo2"))
    widest = F.when(F.col("root") != F.col("hi1.root"), F.col("hi1.hi")).otherwise(F.col("hi2"))
    able = stash(early.join(other, "shingle").where((smallest <= F.col("cap")) & (widest >= F.col("n"))).select("shingle", "rep", "root", "n", "cap"))
    x, y = able.alias("x"), able.alias("y")
    apart = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.cap")) & (F.col("y.n") <= F.col("x.cap"))
    return x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(apart).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 75, bands: int = 48, rows: int = 5, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when their sets of distinct width-word shingles reach percent Jaccard, confirmed on full
    sets; component_id is the smallest doc_id reachable. With 48 bands of 5 coordinates a pair right at 0.75 is
    missed with probability 2e-6, closer ones far less often.

    Equal sets are one class, represented by its smallest doc_id, so copies cost nothing further. In each bucket of
    a band every member is compared with the bucket's smallest member rather than with all others; a bucket whose
    members then lie in one component needs no more. What is left of other buckets gets another such round without
    the members already compared with all. Then its pairs across components are compared, but for those that can't
    reach percent by their sizes and the places of their shared shingles (sharing_rare, exact), so that documents which
    share a frequent passage make no pairs. No possible link between components is left unchecked, and a large group
    of near copies costs a few comparisons a member. Each round works on the components of the last one.

    Null texts and texts without words have no shingles and link with nothing. Rows with the same doc_id are one
    vertex. Rows without doc_id link with nothing, have no component and are kept.
    """
    seen = stash(sketches(docs, text, width, bands, rows))
    full = seen.where("cls is not null and doc_id is not null")
    classes = stash(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    reps = stash(classes.select("rep", "cls").join(full.select("doc_id", F.col("cls").alias("c"), "bands", "n_shingles").dropDuplicates(["doc_id", "c"]), (F.col("rep") == F.col("doc_id")) & (F.col("cls") == F.col("c"))).select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")))
    shared = stash(reps.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("size")).where("size > 1"))
    members = stash(reps.join(shared.select("key"), "key").distinct())
    wanted = few(stash(members.select("rep").distinct()))
    sets = stash(sets_of(docs.join(wanted, docs["doc_id"] == wanted["rep"], "left_semi"), text, width).distinct())

    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("root") != F.col("pivot_root"))
    left, tried, steps = members.select("key", "rep", "n", F.col("rep").alias("root")), None, []

    def merged(pairs: DataFrame) -> DataFrame:
        """(v, r): the new root of every root that the links among pairs (a, b) move, roots by the steps so far."""
        links = stash(verified(pairs, sets, percent))
        return components(rooted(rooted(links, "a", steps), "b", steps))

    for _ in range(rounds):
        pivots = stash(left.groupBy("key").agg(F.min(F.struct("rep", "n", "root")).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("m"), F.col("p.root").alias("pivot_root")))
        pairs = left.join(pivots, "key").where(fits).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        pairs = stash(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        steps.append(merged(pairs))
        left = stash(rooted(left, "root", steps[-1:]))
        # a bucket is settled when all its members lie in one component
        split = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("rep").alias("pivot")).where("lo < hi").select("key", "pivot")
        left = stash(left.join(split, "key").where("rep <> pivot").select("key", "rep", "n", "root"))
    rest = sharing_rare(stash(left.select("rep", "root", "n").distinct()), sets, percent)
    steps.append(merged(stash(rest.join(tried, ["a", "b"], "left_anti"))))
    roots = stash(rooted(classes.select(F.col("cls").alias("c"), F.col("rep").alias("root")), "root", steps))
    linked = seen.select("doc_id", "n_shingles", "cls").join(roots, F.col("cls") == F.col("c"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, unchanged. Settings and nulls as for near_duplicates."""
    name = spare(docs, "gone")
    gone = stash(near_duplicates(docs.select("doc_id", F.col(f"`{text}`").alias("text")), **settings).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(few(gone), docs["doc_id"] == F.col(name), "left_anti")
