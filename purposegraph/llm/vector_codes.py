"""Vector code compression: codebooks of parts, whose nearest entries are found by a VA-file's filter and exact integer distances."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

#: Integer components are held within this, so that no sum of squares leaves 64 bits; it is 524,288 in the vectors' own unit.
MOST = 1 << 27
#: Bits of an entry's coordinate in the filter, and vectors that are filtered at once.
CELL_BITS, ROWS = 4, 2048


def integers(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors have so many components, their integer components floor(256 x))."""
    fits = np.fromiter((n == dims for n in vectors.value_lengths().to_pylist()), dtype=bool, count=len(vectors))
    flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return fits, np.clip(np.floor(flat * 256), -MOST, MOST).astype(np.int64).reshape(-1, dims)


class Cells:
    """A part's codebook, its entries' coordinates quantised to 2**CELL_BITS cells between their least and greatest.

    The cells' borders enclose every entry, so the distance from a coordinate to the near and far border of an entry's
    cell bounds its distance to the entry from below and above. For each vector these are looked up in a table of its
    squared distances to all cells of each coordinate; entries whose lower bound exceeds the least upper one can't be the
    nearest, and only the others are measured.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = 1 << CELL_BITS
        low, high = entries.min(axis=0), entries.max(axis=0)
        self.borders = low + (high - low + 1) * np.arange(n + 1)[:, None] // n  # (cells + 1, dims), rising
        self.cell = np.stack([np.searchsorted(self.borders[1:-1, d], entries[:, d], side="right") for d in range(entries.shape[1])], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row, the lower entry on ties; how many entries were measured."""
        near_low, far = x[:, None, :] - self.borders[None, :-1], x[:, None, :] - self.borders[None, 1:]
        near = np.maximum(np.maximum(-near_low, far), 0) ** 2
        far = np.maximum(np.abs(near_low), np.abs(far)) ** 2
        lower = upper = 0
        for d in range(x.shape[1]):
            lower = lower + near[:, self.cell[:, d], d]
            upper = upper + far[:, self.cell[:, d], d]
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])  # in order of rows, then entries
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(exact, starts)
        first = np.flatnonzero(exact == np.repeat(best, np.diff(np.append(starts, len(row)))))
        first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
        return entry[first], best, len(row)


def assigned(x: np.ndarray, books: list[Cells], step: int = ROWS):
    """(codes, squared distances), a column for each part, of the rows of x; slice by slice."""
    width = x.shape[1] // len(books)
    for lo in range(0, len(x), step):
        rows = x[lo : lo + step]
        got = [b.nearest(rows[:, k * width : (k + 1) * width]) for k, b in enumerate(books)]
        yield rows, np.stack([g[0] for g in got], axis=1), np.stack([g[1] for g in got], axis=1)


def fitted(vectors: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """The parts' codebooks (entries, width) after so many rounds from `first`; sums and counts of each entry come to the driver."""
    dims, width = first.shape[1], first.shape[1] // parts
    books = [first[:, k * width : (k + 1) * width] for k in range(parts)]
    for _ in range(rounds):

        def sums(batches, books=books):
            cells, n = [Cells(b) for b in books], len(books[0])
            total, count = np.zeros((parts, n, width), dtype=np.int64), np.zeros((parts, n), dtype=np.int64)
            for batch in batches:
                for rows, codes, _ in assigned(integers(batch.column(0), dims)[1], cells):
                    for k in range(parts):
                        count[k] += np.bincount(codes[:, k], minlength=n)
                        np.add.at(total[k], codes[:, k], rows[:, k * width : (k + 1) * width])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        at = [F.sum(F.get("total", i)).alias(f"s{i}") for i in range(width)]
        books = [b.copy() for b in books]
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *at).collect():  # parts * entries rows
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of the rows whose vector is not null and has only finite components.

    Components become floor(256 x); vectors are cut into `parts` equal parts, each with a codebook that starts as that
    part of the `entries` smallest keys (ties by the vector) and takes `rounds` rounds of assignment to the nearest entry and floored
    means. code: two hex digits for each part; error: the squared distances summed; label_error: error over equal labels, nulls
    together. Each round is one pass whose sums are gathered in every task; only parts * entries sums come to the driver.
    Null keys come last in the order of keys; equal rows are rows of their own. The number of components is that of the
    first vector in that order whose number is a positive multiple of `parts`; vectors with another number keep a null code and
    error. Fewer than `entries` vectors make smaller codebooks; without any, codes are null and the digest is that of an empty string. Components beyond
    2**27 are held at it. Entries are written in two hex digits, so there are at most 256. Further columns are dropped.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256")
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(x.isNotNull() & ~bad)
    cut = good.where((F.size(x) > 0) & (F.size(x) % parts == 0))
    order = [F.col("key").asc_nulls_last(), F.col("vector")]
    size = next((len(r["vector"]) for r in cut.orderBy(*order).limit(1).collect()), 0)
    start = cut.where(F.size(x) == size).orderBy(*order).limit(entries).select("vector").collect() if size else []
    first = np.clip(np.floor(np.array([r["vector"] for r in start]).reshape(len(start), size) * 256), -MOST, MOST).astype(np.int64)
    books = fitted(cut.where(F.size(x) == size), first, parts, rounds) if size else []
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()

    def coded(batches):
        cells = [Cells(b) for b in books]
        for batch in batches:
            codes: list = [None] * len(batch)
            errors: list = [None] * len(batch)
            fits, numbers = integers(batch.column(2), size) if size else ((), ())
            at = iter(np.flatnonzero(fits).tolist())
            for _, code, far in assigned(numbers, cells):
                for text, e in zip(code.astype(np.uint8), far.sum(axis=1).tolist(), strict=True):
                    i = next(at)
                    codes[i], errors[i] = text.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["key", "label", "code", "error"])

    schema = T.StructType([good.schema["key"], good.schema["label"]]).add("code", "string").add("error", "long")
    out = stash(good.mapInArrow(coded, schema))
    of_label = out.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    shown = out.join(of_label, F.col("label").eqNullSafe(F.col("l")))
    return shown.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
