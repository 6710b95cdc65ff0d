"""Spans of regular expressions with positions in code points, from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def let_(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def before(lengths: Column, add=lambda a, x: a + x) -> Column:
    """The running sum (or whatever add makes) of the numbers before each one, from 0 on.

    In runs of about the square root of their number: each run's total, the totals' running sum, then the sums inside
    runs, as an array that grows is copied with each number it gets.
    """

    def of(x: Column) -> Column:
        run = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))

        def sums(runs: Column) -> Column:
            grow = lambda a, v: F.concat(a, F.array(add(F.element_at(a, -1), v)))
            totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), add))
            starts = F.aggregate(totals, F.array(F.lit(0)), grow)
            return let_(starts, lambda first: F.flatten(F.transform(runs, lambda r, k: F.slice(F.aggregate(r, F.array(F.get(first, k)), grow), 1, F.size(r)))))

        cut = let_(run, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int")), lambda k: F.slice(x, k * n + 1, n)))
        return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let_(cut, sums))

    return let_(lengths, of)


def last_before(spans: Column, place: Column) -> Column:
    """The last of the spans, sorted by start, that starts before the place; null without one. Bisected, in as many steps as any array needs."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["lo"] + a["hi"], 1)
        low = F.get(spans, middle)["s"] < place
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(low, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(middle).alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return let_(F.aggregate(steps, start, step)["lo"], lambda n: F.when(n > 0, F.get(spans, n - 1)))


def meets(x: Column, *lists: Column) -> Column:
    """x overlaps a span of one of the lists, each sorted by start and without overlaps in itself."""
    out = F.lit(False)
    for spans in lists:
        out = out | F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(last_before(spans, x["e"])["e"] > x["s"], F.lit(False)))
    return out


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def joined(text: Column, part: str, joints: str) -> Column:
    """text with each joint between two part characters replaced by a control character, one for one, so that a run of joined parts is one character class.

    Java's expressions recurse once per round of a repeated group and overflow on long texts; classes don't. The first
    joint becomes U+0001, the second U+0002; both are U+0003 where the text itself has them.
    """
    out = F.translate(text, "\x01\x02", "\x03\x03")
    for k, joint in enumerate(joints):
        out = F.regexp_replace(out, f"(?<=[{part}])[{joint}](?=[{part}])", chr(1 + k))
    return out


def pieces(text: Column, pattern: str, hint: str, joints: str = "", marked: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (s, e, m, last, next): end exclusive; what lies before, from the match before it on, and behind.

    hint: a cheap pattern without which there is none. The matches, and the stretches between them, have known lengths, whose running
    sum gives the places. marked: the text as the pattern wants it, with joined()'s characters for the joints, which m has again.
    """
    kind = "array<struct<s:int,e:int,m:string,last:string,next:string>>"
    real = lambda c: F.translate(c, "\x01\x02"[: len(joints)], joints) if joints else c

    def spans(t: Column) -> Column:
        def placed(x: Column) -> Column:
            lengths = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["p"], i)))

            def made(starts: Column) -> Column:
                begin = lambda i: F.get(starts, i) + F.length(F.get(x["p"], i))
                last = lambda i: F.substring(F.concat(F.coalesce(F.get(x["m"], i - 1), F.lit("")), F.get(x["p"], i)), -20, 20)
                following = lambda i: F.substring(F.concat(F.substring(F.get(x["p"], i + 1), 1, 1), F.substring(F.coalesce(F.get(x["m"], i + 1), F.lit("")), 1, 1)), 1, 1)
                return F.transform(x["m"], lambda m, i: F.struct(begin(i).alias("s"), (begin(i) + F.length(m)).alias("e"), real(m).alias("m"), real(last(i)).alias("last"), real(following(i)).alias("next")))

            return F.when(F.size(x["m"]) == 0, F.array().cast(kind)).otherwise(let_(before(lengths), made))

        both = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("p"))
        return let_(both, placed)

    return F.when(text.rlike(hint), spans(text) if marked is None else let_(marked, spans)).otherwise(F.array().cast(kind))


def found(text: Column, pattern: str, kind: str, hint: str, joints: str = "", marked: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (kind, s, e, m). See pieces()."""
    return F.transform(pieces(text, pattern, hint, joints, marked), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined in the spans' order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


#: Characters of the stretches that a text is cut into where parts of it are wanted, so that none is counted from its beginning.
STRETCH = 512


def hidden(text: Column, spans: Column, mark=lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))) -> Column:
    """text with each span replaced by its mark. Spans in any order; one that begins inside an earlier one is dropped with it."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """The characters from a to b, b exclusive."""
        i, j = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
        part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        within = F.substring(part(i), a % STRETCH + 1, b - a)
        across = F.concat(F.substring(part(i), a % STRETCH + 1, F.lit(STRETCH)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(part(j), F.lit(1), b % STRETCH))
        return F.when(b <= a, "").when(i == j, within).otherwise(across)

    def replaced(xs: Column) -> Column:
        reach = F.transform(xs, lambda x: x["e"])

        def shown(x: Column) -> Column:
            with_last = F.transform(xs, lambda v, k: F.struct(v.alias("x"), F.get(x["reach"], k).alias("from")))
            free = F.filter(with_last, lambda v: v["x"]["s"] >= v["from"])
            texts = F.transform(free, lambda v: F.concat(cut(x["parts"], v["from"], v["x"]["s"]), mark(v["x"]["kind"])))
            return F.concat(F.array_join(texts, ""), cut(x["parts"], x["end"], F.length(text)))

        both = F.struct(before(reach, lambda a, v: F.greatest(a, v)).alias("reach"), F.array_max(reach).alias("end"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("parts"))
        return let_(both, shown)

    return F.when(F.size(spans) == 0, text).otherwise(let_(order, replaced))
