"""Blocks of documents with their own word lists, and exchanges of what the words need between blocks and parts of the vocabulary.

A block holds some megabytes of text as numbers of its distinct words. Each distinct word of a block is sent once to the
part of the vocabulary that its hash falls in, where all blocks' requests for it meet, and the answers come back in the
order of the requests. A word of any frequency is one entry for each block, so none makes a hot task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import new_path, parts_for

#: Text of one block, in characters.
BLOCK_CHARS = 6 << 20
#: Input bytes for each part of the vocabulary, and for each bucket of blocks.
PART_BYTES = 8 << 20
#: Buckets of a stored table at most, far below what Spark allows (spark.sql.sources.bucketing.maxBuckets); beyond, a bucket holds more blocks.
MOST_BUCKETS = 4096


def squeezed(values) -> bytes:
    """Numbers from 0 on as zstd over byte planes of the narrowest type."""
    a = np.ascontiguousarray(values)
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    numbers = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    planes = np.empty((width, len(a)), dtype=np.uint8)
    for i in range(width):  # some times faster than a transposed copy
        planes[i] = numbers[:, i]
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes)


def expanded(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    numbers = np.empty((planes.shape[1], width), dtype=np.uint8)
    for i in range(width):
        numbers[:, i] = planes[i]
    return numbers.reshape(-1).view(f"<u{width}").astype(np.uint64 if width == 8 else np.int64, copy=False)


def packed(items: list[bytes]) -> bytes:
    """Byte strings, one after another with their lengths, compressed."""
    sizes = squeezed(np.fromiter(map(len, items), dtype=np.int64, count=len(items)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(items))


def unpacked(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    sizes = expanded(data[4 : 4 + n])
    body = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    ends = np.cumsum(sizes)
    return [body[b - s : b] for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)]


def fields(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unfields(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def ranked(flat: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """(items by descending frequency, flat renumbered so): frequent items get small numbers, which compress best."""
    order = np.argsort(-np.bincount(flat, minlength=n_items), kind="stable")
    rank = np.empty(n_items, dtype=np.int64)
    rank[order] = np.arange(n_items)
    return order, rank[flat]


def sorting(keys: np.ndarray) -> np.ndarray:
    """np.argsort(keys, kind="stable") of 64-bit numbers from 0 on: a sort of numbers that have as much of a key as there is room for, and below it its place.
    Sorts take a third of the time of argsorts; where keys are told apart by their lowest bits alone, it is an argsort."""
    keys = keys.astype(np.uint64, copy=False)
    room = np.uint64(64 - int(keys.max()).bit_length() if len(keys) else 0)
    below = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(((keys << room) & ~below) | np.arange(len(keys), dtype=np.uint64)) & below).view(np.int64)
    got = keys[order]
    return order if (got[1:] >= got[:-1]).all() else np.argsort(keys, kind="stable")


def grouped(parts: np.ndarray):
    """(part, places of its items) for each part, in order of parts; with np.argsort(parts, kind="stable") as the joint order."""
    order = np.argsort(parts, kind="stable")
    edges = np.flatnonzero(np.diff(parts[order])) + 1
    for places in np.split(order, edges) if len(order) else []:
        yield int(parts[places[0]]), places


def collected(batches, doc_column: int = 0, text_column: int = 1):
    """Lists (ids, texts) of about BLOCK_CHARS characters, across batches; a longer text is a block with what came before it."""
    ids: list = []
    texts: list[str] = []
    total = 0
    for batch in batches:
        for i, t in zip(batch.column(doc_column).to_pylist(), batch.column(text_column).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            total += len(texts[-1]) + 64
            if total >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def stored(blocks: DataFrame, buckets: int) -> DataFrame:
    """blocks as a table in the shared folder, bucketed by block, so that joins by block don't move it again. sweep() drops it."""
    spark = blocks.sparkSession
    path = new_path(spark)
    name = f"purposegraph_{path.rpartition('/')[2]}"
    blocks.write.option("compression", "uncompressed").option("path", path).bucketBy(min(buckets, MOST_BUCKETS), "block").sortBy("block").saveAsTable(name)
    common._made.insert(len(common._made) - 1, ("table", name))
    return spark.table(name)


def parts_of(docs: DataFrame) -> int:
    return parts_for(docs, PART_BYTES)


def exchanged(requests: DataFrame, answer, parts: int) -> DataFrame:
    """(block, part, blob): answers to requests (part, block, blob). answer: list of blobs of a part to the list of its answers."""

    def run(table: pa.Table) -> pa.Table:
        blobs = answer([b.as_py() for b in table.column("blob")])
        return pa.table({"block": table.column("block"), "part": table.column("part"), "blob": pa.array(blobs, pa.binary())})

    return requests.repartition(max(1, parts), "part").groupBy("part").applyInArrow(run, "block long, part int, blob binary")


def answered(table: DataFrame, buckets: int, *answers: DataFrame, first: int = 0) -> DataFrame:
    """table (block, ...) with a column a0, a1, ... (from `first` on) for each of answers: its blobs for the block in order of parts, never more than there are parts.

    table comes from stored(); the answers are dealt by block over as many partitions as it has buckets, so that it is
    joined where it lies and only answers move.
    """
    out = table
    for i, a in enumerate(answers, first):
        per_block = a.repartition(min(buckets, MOST_BUCKETS), "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "blob"))).alias("x"))
        out = out.join(per_block.select("block", F.col("x.blob").alias(f"a{i}")), "block", "left")
    return out
