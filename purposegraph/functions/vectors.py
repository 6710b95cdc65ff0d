"""Functions on arrays of numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    exps = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(exps, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def arg_max(a: Column) -> Column:
    """The first 0-based place of the largest number."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def norm(a: Column, p: int = 2) -> Column:
    return total(F.transform(a, F.abs)) if p == 1 else F.sqrt(total(F.transform(a, lambda x: x * x)))


def normalised(a: Column, p: int = 2) -> Column:
    """a over its norm; a zero vector stays."""
    return let(norm(a, p), lambda n: F.transform(a, lambda x: F.when(n == 0, x).otherwise(x / n)))


def combined(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def translation_distance(head: Column, relation: Column, tail: Column, p: int = 1) -> Column:
    """The norm of head + relation - tail."""
    return norm(combined(combined(head, relation, lambda x, y: x + y), tail, lambda x, y: x - y), p)


def pair_distance(first: Column, second: Column, relation: Column, text: Column, p: int = 1) -> Column:
    """The norm of (first + second) / 2 + relation - text."""
    return translation_distance(combined(first, second, lambda x, y: (x + y) / 2), relation, text, p)


def margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), positive - negative + margin)


def filled(a: Column, size: int) -> Column:
    """a, or zeros where it is null."""
    return F.coalesce(a, F.array_repeat(F.lit(0.0), size))
