"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteLevel, Cache, Merges, coded, sums
from .common import named, others, slices, spare


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) instead of the text.

    A map without shuffle: each slice of a batch is split into pre-tokens, its distinct ones that the worker has
    not met lately are merged together as ragged arrays, and a text's count is the sum over its pre-tokens.
    Null text counts as empty (0 bytes, 0 tokens). Other columns are carried along; one that clashes with a
    result column is replaced. Memory is bounded by the slice and the fixed cache, not by the data.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = others(docs, *made, text)
    source = docs.select(*map(named, keep), named(text).cast("string").alias(spare(docs, "text")))
    schema = docs.select(*map(named, keep)).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        merges, split, cache = Merges(path), ByteLevel(path, pattern), Cache()

        def count(words):
            counts = merges.run([w.encode() for w in words], keep_ids=False)[0].tolist()
            return [1 if w in split.special else n for w, n in zip(words, counts, strict=True)]

        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            n_bytes, n_tokens = [], []
            for lo, hi in slices(texts):
                words, flat, sizes = coded([split.words(t) for t in texts[lo:hi]])
                counts = np.array(cache.values_of(words, count), dtype=np.int64)
                n_tokens += sums(counts[flat], sizes).tolist()
                n_bytes += [len(t) if t.isascii() else len(t.encode()) for t in texts[lo:hi]]
            n = np.array(n_tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], names=[*keep, *made])

    return source.mapInArrow(run, schema)
