"""Line dedup by pairwise alignment: shared runs of lines find overlapping documents, patience diff aligns them, common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, from_row, named, others, stash


def _unique(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    """Line to place, of the lines that occur once in [lo, hi)."""
    at: dict[int, int] = {}
    again = set()
    for i in range(lo, hi):
        if lines[i] in at:
            again.add(lines[i])
        at[lines[i]] = i
    return {x: i for x, i in at.items() if x not in again}


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by first, whose seconds rise: patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ends.append(i)
        else:
            tops[pile], ends[pile] = j, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two line sequences, rising in both.

    Equal ends are matched first, then lines unique in both parts anchor the alignment by their longest rising
    subsequence, and so on between anchors. The parts are kept on a stack, so depth is no limit.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            matched.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            matched.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        first, second = _unique(a, alo, ahi), _unique(b, blo, bhi)
        anchors = _longest_rising(sorted((i, second[x]) for x, i in first.items() if x in second))
        if not anchors:
            continue
        pa_, pb_ = alo, blo
        for i, j in anchors:
            todo.append((pa_, i, pb_, j))
            matched.append((i, j))
            pa_, pb_ = i + 1, j + 1
        todo.append((pa_, ahi, pb_, bhi))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, th, lines, words): a 128-bit hash of the text, its lines' 64-bit hashes and numbers of words. A map without shuffle."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            split = [t.split("\n") for t in texts]
            th = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
            hashes = [[xxhash.xxh3_64_intdigest(x.strip().encode()) - (1 << 63) for x in s] for s in split]
            words = [[len(x.split()) for x in s] for s in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(th, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=["doc_id", "th", "lines", "words"])

    source = docs.select(F.col("doc_id").cast("long"), named(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, th binary, lines array<long>, words array<int>")


def runs(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """Ranges [from, to) of lines: the shortest with min_words words from each line on, and up to each line; no empty lines at their ends.

    Whatever stretch of lines has so many words is made of the runs within it, but for empty lines at its ends. No line
    is in more than 2 * min_words runs, save the empty ones inside, so all runs together are linear in the text.
    """
    filled = [i for i, n in enumerate(words) if n]
    out = set()
    for order, sign in ((filled, 1), (filled[::-1], -1)):
        total = end = 0
        for k, i in enumerate(order):
            while end < len(order) and total < min_words:
                total += words[order[end]]
                end += 1
            if total < min_words:
                break
            last = order[end - 1]
            out.add((i, last + 1) if sign > 0 else (last, i + 1))
            total -= words[i]
    return out


def runs_of(texts: DataFrame, min_words: int) -> DataFrame:
    """(th, first, run): 64-bit hashes of the runs of every text, once each."""

    def run(batches):
        for batch in batches:
            th, first, hashes = [], [], []
            for t, f, lines, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                packed = np.array(lines, np.int64)
                found = {xxhash.xxh3_64_intdigest(packed[lo:hi].tobytes()) - (1 << 63) for lo, hi in runs(words, min_words)}
                th.extend([t] * len(found))
                first.extend([f] * len(found))
                hashes.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.binary()), pa.array(first, pa.int64()), pa.array(hashes, pa.int64())], names=["th", "first", "run"])

    return texts.select("th", "first", "lines", "words").mapInArrow(run, "th binary, first long, run long")


def common(mine: list[int], words: list[int], other: list[int], min_words: int) -> list[int]:
    """The places in mine, in order, that stretches of at least min_words words cover that other has too, wherever they stand there.

    Patience diff finds what rises in both without repeats. Runs of mine that it leaves (moved passages, and those without a
    line that occurs once) are looked up among other's runs.
    """
    cut: set[int] = set()
    for _, j, n in patience(other, mine):
        if sum(words[j : j + n]) >= min_words:
            cut.update(range(j, j + n))
    theirs = set(other)
    shared = np.concatenate([[0], np.cumsum([x in theirs for x in mine])]) if mine else np.zeros(1)
    done = np.concatenate([[0], np.cumsum([i in cut for i in range(len(mine))])]) if mine else shared
    left = [(lo, hi) for lo, hi in runs(words, min_words) if shared[hi] - shared[lo] == hi - lo > done[hi] - done[lo]]
    if left:
        known = dict(zip(mine, words, strict=True))
        a, b = np.array(mine, np.int64), np.array(other, np.int64)
        # a line that mine lacks ends a run of other, which then equals none of mine
        held = {b[lo:hi].tobytes() for lo, hi in runs([known.get(x, min_words) for x in other], min_words)}
        for lo, hi in left:
            if a[lo:hi].tobytes() in held:
                cut.update(range(lo, hi))
    return sorted(cut)


def aligned(pairs: DataFrame, min_words: int) -> DataFrame:
    """(th, cut): for pairs (th, lines, words, other lines) the places in lines that common blocks of at least min_words words cover."""

    def run(batches):
        for batch in batches:
            cuts = [common(mine, words, other, min_words) for mine, words, other in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.int32()))], names=["th", "cut"])

    return pairs.mapInArrow(run, "th binary, cut array<int>")


def cuts(docs: DataFrame, text: str = "text", min_block_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(texts, cut places): (th, first, n_words) of every distinct text, and (th, cut) of those that lose lines to earlier texts.

    Neighbouring lines that reach min_block_words words show an overlap, whatever the length of each. Each text is paired
    with the first holder of each such run, not with all holders: a common block is made of runs, and each of them is in
    its first holder, so nothing is lost, and pairs grow with occurrences whatever the run's frequency. Equal texts are one,
    known by its smallest doc_id, which is also the order of texts.
    """
    late = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    rows = stash(lines_of(docs, text))
    texts = stash(rows.groupBy("th").agg(F.min(late).alias("first"), F.min(F.struct("lines", "words")).alias("x")).select("th", "first", "x.*"))
    at = stash(runs_of(texts, min_block_words))
    holders = stash(at.groupBy("run").agg(F.min(F.struct("first", "th")).alias("h"), F.count("*").alias("n")).where("n > 1").select("run", F.col("h.th").alias("other")))
    pairs = stash(at.join(holders, "run").where("th <> other").select("th", "other").distinct())
    mine = texts.select("th", "lines", "words")
    other = texts.select(F.col("th").alias("other"), F.col("lines").alias("others"))
    both = pairs.join(mine, "th").join(other, "other").select("th", "lines", "words", "others")
    found = stash(aligned(both, min_block_words).where(F.size("cut") > 0))
    places = found.groupBy("th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))
    n_words = F.aggregate("words", F.lit(0), lambda a, x: a + x)
    return stash(texts.select("th", "first", n_words.alias("n_words"))), stash(places)


def dedup_lines(docs: DataFrame, text: str = "text", min_block_words: int = 20) -> DataFrame:
    """docs with text freed from lines that an earlier document has too, and n_lines and n_removed.

    A document is aligned by patience diff with the first holder of each of its runs of neighbouring lines that reach
    min_block_words words (lines compared without outer white space); blocks of neighbouring common lines with at
    least so many words in all are deleted from the later one, by doc_id, also where they are moved or repeated. A later copy of a whole text of so many words loses all its lines. Shorter
    blocks stay, so clean documents are untouched. Null stays null (no lines removed); rows without doc_id come
    last; rows equal in doc_id and text are treated alike. Columns that clash with a result are replaced.
    """
    texts, places = cuts(docs, text, min_block_words)
    keep = others(docs, "n_lines", "n_removed", text)
    rows = docs.select(as_row(keep).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("late"), named(text).cast("string").alias("text"))
    table = stash(texts.join(places, "th", "left").select(F.col("th").alias("key"), "first", F.col("n_words").alias("words"), "cut"))
    tagged = with_hash(rows)
    joined = tagged.join(table, F.col("th") == F.col("key"), "left")
    copy = (F.col("late") > F.col("first")) & (F.col("words") >= min_block_words)
    lines = F.split(F.col("text"), "\n", -1)
    n = F.size(lines)
    gone = F.coalesce(F.size("cut"), F.lit(0))
    # a cut list is sorted; lines between cuts are sliced out, so long texts take linear time
    edges = F.concat(F.array(F.lit(-1)), F.col("cut"), F.array(n))
    left = F.flatten(F.transform(F.sequence(F.lit(1), F.size("cut") + 1), lambda i: F.slice(F.col("lines"), F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1)))
    new = F.when(F.col("text").isNull(), None).when(copy, F.lit("")).when(gone == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    removed = F.when(F.col("text").isNull(), 0).when(copy, n).otherwise(gone).cast("long")
    made = joined.withColumn("lines", lines).select("row", new.alias("new"), n_lines.alias("n_lines"), removed.alias("n_removed"))
    out = dict(zip(keep, from_row(keep), strict=True)) | {text: F.col("new").alias(text)}
    return made.select(*[out[c] for c in docs.columns if c in out], "n_lines", "n_removed")


def with_hash(rows: DataFrame) -> DataFrame:
    """rows with th, the hash of lines_of, in one batch-wise map."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            th = [xxhash.xxh3_128_digest(t.as_buffer()) if t.is_valid else xxhash.xxh3_128_digest(b"") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(th, pa.binary())], names=[*batch.schema.names, "th"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("th", T.BinaryType())]))
