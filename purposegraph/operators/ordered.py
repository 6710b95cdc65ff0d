"""Total orders over tables of any size: running numbers, exact slices, and the n smallest rows of a hashed order."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Scratch

DIGITS = 4  # hexadecimal digits told apart at a time: at most 65,536 cells come to the driver
KEY = 32  # digits of an md5


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """df with a long that numbers its rows from 0 in the given order, without gaps over all of df.

    Rows are parted by ranges of the order, sorted and stored once, so that numbers don't change when tasks are repeated; a
    range's first number is the sum of the sizes of the ranges before it. Nulls come first. The order should be total: rows equal
    in it fall into one range and are numbered in any order. A column of df called `name` is replaced; an empty df stays empty.
    """
    ranged = df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = Scratch(df.sparkSession).table(ranged).withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    first = rows.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return rows.join(first, "__range").withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__first")).drop("__at", "__range", "__first")


def row_slice(df: DataFrame, order: list, index: int, size: int) -> DataFrame:
    """Rows [index * size, (index + 1) * size) of the order: exact slices that don't depend on how df is partitioned."""
    return numbered(df, order, "__number").where((F.col("__number") >= index * size) & (F.col("__number") < (index + 1) * size)).drop("__number")


def smallest(df: DataFrame, hashed: Column, n: int, at_once: int = 100_000) -> DataFrame:
    """Exactly n rows (all if fewer): those of the smallest `hashed`, an md5 in hexadecimal; ties by the md5 of the whole row.

    No sort of the table and no task of n rows. Rows are counted by the next digits of the order, the cell that holds the nth
    row is found from at most 65,536 counts, and only this cell is looked into further, until it has at most `at_once` rows. What
    lies below is a filter. Digits that all rows of the cell share are skipped, so a key with a third of all rows takes one
    step more. Rows equal in all columns count as often as they occur. Reads df once for each step, mostly two; store df if it is dear.
    """
    columns = df.columns
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
    rows = df.withColumn("__h", hashed)
    border, path, left, below = rows, "", n, []
    while True:
        if len(path) == KEY:  # one key: what follows is told apart by whole rows
            border = border.withColumn("__w", whole)
        done = len(path) if len(path) < KEY else len(path) - KEY
        digits = F.col("__h") if len(path) < KEY else F.col("__w")
        cells = border.groupBy(F.substring(digits, done + 1, DIGITS).alias("c")).agg(F.count("*").alias("n"), F.min(digits).alias("lo"), F.max(digits).alias("hi")).orderBy("c").collect()
        if sum(r["n"] for r in cells) <= left:
            below.append(border.select(*[f"`{c}`" for c in columns]))
            break
        for cell in cells:
            if cell["n"] > left:
                break
            left -= cell["n"]
        shared = cell["lo"][: max(done + DIGITS, len(os.path.commonprefix([cell["lo"], cell["hi"]])))]
        below.append(border.where(digits < shared[: done + DIGITS]).select(*[f"`{c}`" for c in columns]))
        path = path[: len(path) - done] + shared
        border = border.where(digits.startswith(shared))
        if left == 0:
            break
        if cell["n"] <= at_once or len(path) == 2 * KEY:
            below.append(_first(border.withColumn("__w", whole), columns, left))
            break
    out = below[0]
    for more in below[1:]:
        out = out.unionByName(more)
    return out


def _first(border: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n first rows by (__h, __w), equal rows as one with their number, written out again at the end."""
    once = border.groupBy("__h", "__w").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__h", "__w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = once.withColumn("before", before).where(F.col("before") < n).withColumn("n", F.least("n", F.lit(n) - F.col("before")))
    step = 1 << 16
    blocks = some.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step).cast("long"))).alias("b"))
    each = blocks.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("n") - F.col("b") * step))))
    return each.select(*[F.col("row")[c].alias(c) for c in columns])
