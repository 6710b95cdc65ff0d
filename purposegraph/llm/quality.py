"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_row, from_row, let, named, others, stash

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule's vote on the statistics: true for good, false for bad, null to abstain."""

    name: str
    vote: Callable[[], Column]
    #: At first, how often it votes bad on documents without its fault.
    false_alarm: float = 0.002


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _band(value: Column, good_to: float, bad_from: float) -> Column:
    return F.when(value <= good_to, True).when(value >= bad_from, False)


#: A rule votes bad on clear faults, good on their clear absence, and abstains between or where its evidence is thin.
RULES = (
    Rule("symbols", lambda: _band(_share("n_symbols", "n_words"), 0.05, 0.3)),
    Rule("repeats", lambda: _band(_share("n_repeat_words", "n_words"), 0.1, 0.4)),
    Rule("upper", lambda: F.when(F.col("word_chars") >= 40, _band(_share("n_upper", "word_chars"), 0.2, 0.5))),
    Rule("dup_lines", lambda: F.when(F.col("n_lines") >= 3, _band(_share("n_dup_lines", "n_lines"), 0.1, 0.5)), 0.01),
    Rule("length", lambda: F.when(F.col("n_words") < 20, False).when(F.col("n_words") >= 100, True)),
    Rule("word_length", lambda: F.when(F.col("n_words") >= 20, _band(F.abs(_share("word_chars", "n_words") - 6.0), 3.0, 8.0)), 0.03),
)
#: At first, how often a rule votes good, votes bad and abstains on documents with its fault.
FAULT = (0.02, 0.93, 0.05)


#: What statistics() adds.
STATISTICS = ("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_upper")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    A map without shuffle over whole texts; null text has no words. Words in repeated 3-word windows: the windows'
    hashes are sorted with their places, places next to an equal hash are sorted again, and the union of [place,
    place + 2] is measured, so a text of n words costs n log n. Columns of docs that clash with a result are replaced.
    """
    whole = F.coalesce(named(text).cast("string"), F.lit(""))

    def length_without(pattern: str) -> Column:
        return F.length(F.regexp_replace(whole, pattern, "")).cast("long")

    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(1)))

    def union(h: Column) -> Column:
        some = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(repeated(s), covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0).cast("long"))

    def repeated(s: Column) -> Column:
        twins = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twins, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def per_words(w: Column) -> Column:
        n = F.size(w)
        runs = F.when(n >= 4, let(windows(w), union)).otherwise(F.lit(0).cast("long"))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), runs.alias("n_repeat_words"))

    def per_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    keep = others(docs, *STATISTICS, text)
    made = F.struct(
        let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), per_words).alias("w"), let(F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \t-\r]")), per_lines).alias("l"),
        length_without(r"[^#*$%&|<>]+").alias("n_symbols"), length_without(r"[^A-Z]+").alias("n_upper"),
    )
    return docs.select(as_row(keep).alias("row"), made.alias("made")).select(*from_row(keep), "made.w.*", "made.l.*", "made.n_symbols", "made.n_upper")


Votes = tuple[bool | None, ...]
Triple = tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    """Share of documents with each rule's fault, and the rules' rates of voting good, bad and abstaining without it and with it."""

    shares: list[float]
    clean: list[Triple]
    fault: list[Triple]

    @property
    def good(self) -> float:
        return 1 - sum(self.shares)

    def odds(self) -> list[Triple]:
        """For each rule and outcome, the odds of its fault against good."""
        return [tuple(s / self.good * f / c for f, c in zip(fs, cs, strict=True)) for s, fs, cs in zip(self.shares, self.fault, self.clean, strict=True)]


def _outcome(vote: bool | None) -> int:
    return 2 if vote is None else int(not vote)


def fit(patterns: list[tuple[Votes, int]], rules=RULES, prior: float = 0.85, rounds: int = 40, strength: float = 0.05) -> Model:
    """The model by expectation-maximisation over vote patterns with counts, at most 3 to the power of the rules of them whatever the corpus.

    A document is good or has the fault that one of the rules looks for; faults need not come together, so a
    single trusted rule can outvote the rest. Given that, rules vote independently. The first rates count as
    strength times all documents.
    """
    model = Model([(1 - prior) / len(rules)] * len(rules), [(0.9 - r.false_alarm, r.false_alarm, 0.1) for r in rules], [FAULT] * len(rules))
    first, total = model, sum(n for _, n in patterns)
    held = max(strength * total, 1.0)
    for _ in range(rounds):
        odds = model.odds()
        clean = [[held * x for x in t] for t in first.clean]
        fault = [[held * x for x in t] for t in first.fault]
        shares = [held * s for s in first.shares]
        for votes, n in patterns:
            each = [o[_outcome(v)] for o, v in zip(odds, votes, strict=True)]
            for j, (o, v) in enumerate(zip(each, votes, strict=True)):
                p = o / (1 + sum(each))
                shares[j] += n * p
                fault[j][_outcome(v)] += n * p
                clean[j][_outcome(v)] += n * (1 - p)
        model = Model([s / (total + held) for s in shares], [tuple(x / sum(t) for x in t) for t in clean], [tuple(x / sum(t) for x in t) for t in fault])
    return model


def _votes(stats: DataFrame, rules=RULES) -> DataFrame:
    votes = {f"vote_{r.name}": r.vote() for r in rules}
    return stats.select(*[named(c) for c in others(stats, *votes)], *[v.alias(n) for n, v in votes.items()])


def learn(stats: DataFrame, rules=RULES) -> Model:
    """The model fitted on all rows of statistics; only their counts by vote pattern, at most 3 ** len(rules), come to the driver."""
    names = [f"vote_{r.name}" for r in rules]
    counted = _votes(stats, rules).groupBy(*names).agg(F.count("*").alias("n")).collect()
    return fit(sorted(((tuple(r[n] for n in names), r["n"]) for r in counted), key=str), rules)


def verdict(stats: DataFrame, model: Model, threshold: float = 0.5, rules=RULES) -> DataFrame:
    """stats with the votes, p_good (posterior quality probability), base_failed and kept."""
    against = F.lit(0.0)
    for r, (if_good, if_bad, if_none) in zip(rules, model.odds(), strict=True):
        vote = F.col(f"vote_{r.name}")
        against = against + F.when(vote, if_good).when(~vote, if_bad).otherwise(if_none)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _votes(stats, rules).withColumn("p_good", 1 / (1 + against)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, rules=RULES) -> DataFrame:
    """docs' other columns with the statistics, the votes, p_good (posterior quality probability), base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: not base_failed
    and p_good >= threshold. The statistics are computed once and written to the shared folder. Null and empty
    texts fail the base. An empty table gives an empty result.
    """
    stats = stash(statistics(docs, text))
    return verdict(stats, learn(stats, rules), threshold, rules)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5, rules=RULES) -> DataFrame:
    """The rows of docs that judge keeps, unchanged, whatever their columns are called. Null and empty texts go; rows that are equal fare alike.

    Each text is read once: its statistics are written beside the row to the shared folder, and the verdicts read them there.
    """
    stats = stash(statistics(docs.select(F.struct(*map(named, docs.columns)).alias("whole"), named(text).alias("text"))))
    return verdict(stats, learn(stats.drop("whole"), rules), threshold, rules).where("kept").select(*from_row(docs.columns, "whole"))
