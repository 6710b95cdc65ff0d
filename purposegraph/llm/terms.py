"""Terms of texts: letters, digits and whatever lies beyond ASCII, A-Z lower-cased; and items of a query set in chunks of a stated size."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_CHARS

#: On UTF-8 bytes: letters are lower-cased, digits and bytes of characters beyond ASCII stay, all else becomes a blank.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same for Java's regular expressions, after lower-casing.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_column(text: Column) -> Column:
    """The terms of a text in their order; none of a null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), F.lit(TERM), F.lit(0))


def split(text: bytes | None) -> list[bytes]:
    return text.translate(TO_TERMS).split() if text else []


def numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    """The words' numbers, -1 for others."""
    return np.fromiter(map(numbers.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def collected(batches, text_column: int):
    """(batch, from, to, texts as bytes) of about BLOCK_CHARS bytes at most, within a batch; a longer text is alone."""
    for batch in batches:
        texts = batch.column(text_column).cast("binary").to_pylist()
        lo = total = 0
        for i, t in enumerate(texts):
            total += len(t or b"")
            if total >= BLOCK_CHARS:
                yield batch, lo, i + 1, texts[lo : i + 1]
                lo, total = i + 1, 0
        if lo < len(texts):
            yield batch, lo, len(texts), texts[lo:]


def chunks(items: DataFrame, size: Column, most: int):
    """Parts of items (with item_id) of about `most` in the sum of size, whatever the table's size; one item is never cut."""
    total = items.agg(F.sum(size)).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
