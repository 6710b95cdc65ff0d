"""Benchmark decontamination: texts run through a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, from_row, named, others, stash
from .terms import TO_TERMS, chunks, collected, numbered, split, term_column

#: Words of items in one automaton, which is what is broadcast: some 100 MB at most. More items make further rounds over the texts.
AUTOMATON_WORDS = 200_000
FOUND = "spans array<struct<begin:int,end:int>>, items array<string>"


@dataclass
class Automaton:
    """A suffix automaton of several word sequences: `onward[s]` leads from state s by a word, `link[s]` to its longest shorter suffix.

    A state stands for the substrings that end at the same places of the items, the longest of them `length[s]` words
    long. anchor[s] is the first state on the chain of links from s that holds a substring of `window` words, -1 without
    one; whole[s] the longest short item that is a suffix of s (its state), -1 without one. owners: the numbers of the
    items whose windows are a state's.
    """

    window: int
    onward: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    anchor: list[int] = field(default_factory=list)
    whole: list[int] = field(default_factory=list)
    owners: dict[int, set[int]] = field(default_factory=dict)
    short: dict[int, set[int]] = field(default_factory=dict)

    def _cloned(self, s: int, word: int, target: int) -> int:
        """A copy of target that holds only what s and word make; the links and ways of shorter suffixes now lead to it."""
        self.onward.append(dict(self.onward[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[s] + 1)
        new = len(self.link) - 1
        self.link[target] = new
        while s >= 0 and self.onward[s].get(word) == target:
            self.onward[s][word] = new
            s = self.link[s]
        return new

    def _extended(self, last: int, word: int) -> int:
        """The state of the sequence that ends in `last`, one word longer."""
        there = self.onward[last].get(word)
        if there is not None:  # an earlier item has it
            return there if self.length[there] == self.length[last] + 1 else self._cloned(last, word, there)
        self.onward.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, s = len(self.link) - 1, last
        while s >= 0 and word not in self.onward[s]:
            self.onward[s][word] = new
            s = self.link[s]
        if s >= 0:
            there = self.onward[s][word]
            self.link[new] = there if self.length[there] == self.length[s] + 1 else self._cloned(s, word, there)
        return new

    def built(self, sequences: list[list[int]]) -> Automaton:
        for words in sequences:
            last = 0
            for w in words:
                last = self._extended(last, w)
        for k, words in enumerate(sequences):
            s = 0
            for i, w in enumerate(words):
                s = self.onward[s][w]
                if i + 1 >= self.window:
                    at = s
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    self.owners.setdefault(at, set()).add(k)
            if 0 < len(words) < self.window:
                self.short.setdefault(s, set()).add(k)
        n = len(self.link)
        self.anchor, self.whole = [-1] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.anchor[s] = -1 if self.length[s] < self.window else s if self.length[up] < self.window else self.anchor[up]
            self.whole[s] = s if s in self.short and self.length[s] < self.window else self.whole[up]
        return self

    def run(self, words: list[int]):
        """(spans of words in occurrences of windows, apart and in order; numbers of the items whose windows occur)."""
        state, matched = 0, 0
        spans: list[list[int]] = []
        seen: set[int] = set()
        for i, w in enumerate(words, 1):
            while state and w not in self.onward[state]:
                state = self.link[state]
                matched = self.length[state]
            if w not in self.onward[state]:
                continue
            state = self.onward[state][w]
            matched += 1
            begin = i
            if matched >= self.window:
                begin = i - matched
                seen.add(self.anchor[state])
            short = self._short_at(state, matched)
            while short > 0:
                begin = min(begin, i - self.length[short])
                seen.add(short)
                short = self.whole[self.link[short]]
            if begin < i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, i])
        found: set[int] = set()
        for s in seen:
            found |= (self.owners.get(s) or set()) | (self.short.get(s) or set())
        return spans, found

    def _short_at(self, state: int, matched: int) -> int:
        """The state of the longest short item that ends here: a state's own only if all of it has been matched."""
        s = self.whole[state]
        while s > 0 and self.length[s] > matched:
            s = self.whole[self.link[s]]
        return s


@dataclass
class Screen:
    """The automaton of a chunk of items with its words' numbers and a table of the pairs of words that follow each other in them."""

    names: list[str]
    numbers: dict[bytes, int]
    automaton: Automaton
    pairs: np.ndarray
    shortest: int

    @classmethod
    def of(cls, rows: list[tuple[str, list[str]]], window: int) -> Screen:
        numbers: dict[bytes, int] = {}
        sequences = [[numbers.setdefault(w.encode(), len(numbers)) for w in words] for _, words in rows]
        both = np.array([p for s in sequences for p in zip(s, s[1:], strict=False)], dtype=np.int64).reshape(-1, 2)
        pairs = np.zeros(1 << max(10, int(len(both) * 16).bit_length()), dtype=bool)
        pairs[cls.place(both[:, 0], both[:, 1], len(pairs))] = True
        return cls([n for n, _ in rows], numbers, Automaton(window).built(sequences), pairs, min((len(s) for s in sequences if s), default=window))

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77) & (size - 1)

    def stretches(self, ids: np.ndarray):
        """(from, to): the places that a match can be in: words of items whose neighbours are neighbours in an item too.

        The table of pairs may say yes to a wrong one, which the automaton finds out; it never says no to a right one.
        """
        if not len(ids):
            return
        joined = np.zeros(len(ids), dtype=bool)
        joined[1:] = (ids[1:] >= 0) & (ids[:-1] >= 0) & self.pairs[self.place(ids[:-1], ids[1:], len(self.pairs))]
        starts = np.flatnonzero(~joined)
        ends = np.append(starts[1:], len(ids))
        for a, b in zip(starts[(wide := ends - starts >= min(self.shortest, self.automaton.window))].tolist(), ends[wide].tolist(), strict=True):
            if ids[a] >= 0:
                yield a, b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = 10, keep_text: bool = False) -> DataFrame:
    """docs with n_words, spans (word places, end exclusive, apart and in order), items (ids as strings) instead of, or with keep_text beside, the text.

    A window is `window` neighbouring words of an item; an item with fewer, but not none, is one window. spans cover the
    words of the text inside any occurrence of a window; items lists those with an occurring window, sorted as strings.
    Words are as in terms.py. A map without shuffle: the automaton of the items, at most AUTOMATON_WORDS words of them at
    a time, is broadcast, and each text is streamed through it where its neighbouring words are neighbours in an item.
    Null texts have no words, items with null or no text no windows; rows with equal ids are rows of their own; items of
    one id count once, a null id as the empty string. Other columns are carried along; one that clashes with a result
    column is replaced.
    """
    made = ("n_words", "spans", "items")
    keep = others(docs, *made, "text")
    schema = T.StructType().add("row", docs.select(as_row(keep).alias("row")).schema[0].dataType).add("text", "string").add("n_words", "integer")
    for f in T._parse_datatype_string(FOUND).fields:
        schema.add(f.name, f.dataType)
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), term_column(F.col("text")).alias("words")).where(F.size("words") > 0)
    found = docs.select(as_row(keep).alias("row"), named("text").cast("string").alias("text"), F.lit(None).cast("int").alias("n_words"), *[F.array().cast(f.dataType).alias(f.name) for f in schema.fields[3:]])
    kinds = [pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]

    def through(screen: Screen, with_text: bool):
        def run(batches):
            for batch, lo, hi, raw in collected(batches, 1):
                rows = batch.slice(lo, hi - lo)
                words = [split(t) for t in raw]
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                ends = np.cumsum(sizes + 1)  # a gap after each text
                ids = np.full(int(ends[-1]), -1, dtype=np.int64)
                for k, w in enumerate(words):
                    ids[ends[k] - 1 - len(w) : ends[k] - 1] = numbered(w, screen.numbers)
                spans, owners = rows.column(3).to_pylist(), rows.column(4).to_pylist()
                for a, b in screen.stretches(ids):
                    hits, own = screen.automaton.run(ids[a:b].tolist())
                    if own:
                        k = int(np.searchsorted(ends, a, side="right"))
                        first = int(ends[k] - 1 - sizes[k])
                        spans[k] = spans[k] + [{"begin": a - first + x, "end": a - first + y} for x, y in hits]
                        owners[k] = owners[k] + [screen.names[i] for i in own]
                spans = [[{"begin": x, "end": y} for x, y in merged([(h["begin"], h["end"]) for h in x])] if x else x for x in spans]
                out = [rows.column(0), rows.column(1) if with_text else pa.nulls(len(raw), pa.string()), pa.array(sizes, pa.int32()), pa.array(spans, kinds[0]), pa.array([sorted(set(x)) if x else x for x in owners], kinds[1])]
                yield pa.RecordBatch.from_arrays(out, names=["row", "text", "n_words", "spans", "items"])

        return run

    parts = list(chunks(texts, F.size("words"), AUTOMATON_WORDS)) or [texts]
    for k, part in enumerate(parts):
        screen = Screen.of([(r["item_id"], r["words"]) for r in part.collect()], window)  # bounded by the chunk
        last = k == len(parts) - 1
        found = found.mapInArrow(through(screen, keep_text or not last), schema)
        if not last:
            found = stash(found)
    return found.select(*from_row(keep), *(["text"] if keep_text else []), *made)


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The digest of scan() for each document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    found = scan(docs.select("doc_id", "text"), items, window)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, longest: int = 10, coverage: float = 0.5) -> DataFrame:
    """docs without test items: documents with more than `coverage` of their words in occurrences of windows go, and of the others the spans of `longest` words and more are cut from the text.

    Spans are those of scan(), so with longest = 1 those of short items go too. A cut takes the characters from the first
    to the last word of the span; the text around it stays as it is. Columns are those of docs, text included; nulls stay.
    """
    keep = others(docs, "text")
    found = scan(docs.select(as_row(keep).alias("row"), named("text").cast("string").alias("text")), items, window, keep_text=True)
    share = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["begin"]) / F.greatest(F.col("n_words"), F.lit(1))
    clean = found.where(share <= coverage).withColumn("spans", F.filter("spans", lambda x: x["end"] - x["begin"] >= longest))
    word = re.compile(rb"[^ ]+")

    def cut(text: bytes, spans: list[dict]) -> str:
        places = [m.span() for m in word.finditer(text.translate(TO_TERMS))]
        out, at = [], 0
        for s in spans:
            out.append(text[at : places[s["begin"]][0]])
            at = places[s["end"] - 1][1]
        return b"".join([*out, text[at:]]).decode()

    def run(batches):
        for batch in batches:
            spans = batch.column(2).to_pylist()
            if any(spans):
                texts = [t if not s else cut(t.encode(), s) for t, s in zip(batch.column(1).to_pylist(), spans, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["row", "text"])

    out = clean.select("row", "text", "spans").mapInArrow(run, T.StructType([found.schema["row"], found.schema["text"]]))
    return out.select(*from_row(keep), "text").select(*map(named, docs.columns))
