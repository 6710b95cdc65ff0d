"""Best-fit packing of token pieces into sequences by exact-complement hashing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import Cache, Merges, WordLevel, coded, gathered
from .common import as_row, from_row, named, others, slices, stash

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", ids: bool = False) -> DataFrame:
    """Every document's ids with end_id behind them, cut into pieces of capacity ids; the last may be shorter.

    A map without shuffle. Null text counts as empty: one piece of one id. With ids the pieces' ids come too.
    """
    schema = T._parse_datatype_string(PIECES + (", ids array<int>" if ids else ""))

    def run(batches):
        merges, split, cache = Merges(path), WordLevel(path), Cache()

        def encode(words):
            counts, flat = merges.run([w.encode() for w in words])
            return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if words else []

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], [], []]
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                words = [split.words(t) for t in texts[lo:hi]]
                other = [i for i, w in enumerate(words) if w is None]
                whole = dict(zip(other, split.tokenizer.encode_batch([texts[lo + i] for i in other], add_special_tokens=False), strict=True)) if other else {}
                items, flat, sizes = coded([w or [] for w in words])
                each = cache.values_of(items, encode)
                counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
                table = np.fromiter((x for e in each for x in e), dtype=np.int64, count=int(counts.sum()))
                every = gathered(flat, counts, table).astype("<u4") if len(flat) else np.empty(0, "<u4")
                ends = np.concatenate([[0], np.cumsum(counts[flat])])[np.concatenate([[0], np.cumsum(sizes)])] if len(flat) else np.zeros(len(sizes) + 1, np.int64)
                for i in range(hi - lo):
                    mine = np.array(whole[i].ids, dtype="<u4") if i in whole else every[ends[i] : ends[i + 1]]
                    mine = np.append(mine, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(mine), capacity)):
                        part = mine[start : start + capacity]
                        for column, value in zip(out, (doc_ids[lo + i], piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if ids else None), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))[: 5 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=schema.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), named(text).cast("string").alias("text")).mapInArrow(run, schema)


class Lengths:
    """How many pieces of each length are left, with an index by bit of the lengths in stock."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.bits, self.mirror = capacity, dict(counts), 0, 0
        for n in counts:
            self._mark(n, True)

    def _mark(self, n: int, there: bool) -> None:
        for name, bit in (("bits", 1 << n), ("mirror", 1 << (self.capacity - n))):
            setattr(self, name, getattr(self, name) | bit if there else getattr(self, name) & ~bit)

    def largest(self, limit: int, used: dict[int, int]) -> int:
        """The largest length up to limit in stock beyond what is used; 0 if none."""
        bits = self.bits & ((2 << limit) - 1)
        while bits:
            n = bits.bit_length() - 1
            if self.left[n] > used.get(n, 0):
                return n
            bits ^= 1 << n
        return 0

    def enough(self, more: tuple[int, ...], used: dict[int, int]) -> bool:
        return all(self.left.get(n, 0) >= used.get(n, 0) + more.count(n) for n in more)

    def pair(self, total: int, used: dict[int, int], most: int) -> tuple[int, int] | None:
        """Two lengths that sum to total, the larger one as large as can be but at most most."""
        shift = self.capacity - total
        hits = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift) & ((2 << min(most, total - 1)) - 1)
        while hits:
            a = hits.bit_length() - 1
            if 2 * a < total:
                return None
            if self.enough((a, total - a), used):
                return a, total - a
            hits ^= 1 << a
        return None

    def complement(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that fill the gap exactly."""
        if self.enough((gap,), used):
            return (gap,)
        if two := self.pair(gap, used, gap):
            return two
        bits = self.bits & ((1 << max(gap - 1, 0)) - 1)
        while bits:
            a = bits.bit_length() - 1
            if 3 * a < gap:
                return None
            if self.enough((a,), used) and (two := self.pair(gap - a, used, a)) and self.enough((a, *two), used):
                return (a, *two)
            bits ^= 1 << a
        return None

    def take(self, n: int, many: int) -> None:
        self.left[n] -= many
        if not self.left[n]:
            self._mark(n, False)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, times in a sequence, first sequence, offset) that seat all pieces.

    Works on the histogram of lengths alone, at most capacity entries whatever the number of documents. A
    sequence starts from the largest length in stock; its gap is filled exactly by one, two or three lengths
    where some do, else by the best-fitting (largest) one, and so on. The same filling is then used as often
    as the stock allows, so every filling uses up a length.
    """
    stock, slots, sequence = Lengths(counts, capacity), [], 0
    ranks = dict.fromkeys(counts, 0)
    while stock.bits:
        used: dict[int, int] = {}
        gap = capacity
        while gap:
            more = stock.complement(gap, used) if used else None
            if more is None:
                one = stock.largest(gap, used)
                if not one:
                    break
                more = (one,)
            for n in more:
                used[n] = used.get(n, 0) + 1
                gap -= n
        many = min(stock.left[n] // k for n, k in used.items())
        offset = 0
        for n, k in used.items():
            slots.append((n, ranks[n], ranks[n] + many * k, k, sequence, offset))
            ranks[n] += many * k
            stock.take(n, many * k)
            offset += n * k
        sequence += many
    return slots


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, length and others; lengths 1 to capacity) with sequence_id and offset.

    Every piece gets its rank among those of its length from counts by (length, salt), so that a length that a
    third of all pieces have is dealt over many tasks; ties go by doc_id, piece and checksum, and rows equal in
    all of them are interchangeable. Only the histogram of lengths (capacity rows at most) is collected. The
    plan's slots are joined by length and rank. Empty input gives an empty result; columns that clash with a result are
    replaced; pieces with a null length are no pieces and go.
    """
    keep = others(pieces, "sequence_id", "offset")
    kept = stash(pieces.select("doc_id", "piece", "length", "ids_crc32", as_row(keep).alias("row")).where("length is not null"))
    counts = {r[0]: r[1] for r in kept.groupBy("length").count().collect()}
    slots = plan(counts, capacity)
    salts = max(1, int(sum(counts.values()) ** 0.5))
    salted = kept.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stash(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__own", F.row_number().over(own)).join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__own") - 1)
    spark = pieces.sparkSession
    table = spark.createDataFrame(slots, "__length long, __from long, __to long, __k long, __sequence long, __offset long")
    # the plan is at most a few slots for each of the capacity lengths, however many documents there are
    table = F.broadcast(table) if len(slots) <= 200_000 else table
    at = F.col("__rank") - F.col("__from")
    return (
        ranked.join(table, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
        .withColumn("sequence_id", F.col("__sequence") + F.floor(at / F.col("__k")))
        .withColumn("offset", F.col("__offset") + F.pmod(at, F.col("__k")) * F.col("length"))
        .select(*from_row(keep), "sequence_id", "offset")
    )
