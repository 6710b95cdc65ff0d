"""Language-model scores from a hierarchical Pitman-Yor bigram model, seated by Gibbs sampling.

The unigram restaurant is the parent that the restaurants of all preceding words share. Customers of a word in a child
restaurant are its training occurrences after that word; its tables there are customers of the word in the parent;
the parent's base measure is uniform over the known words and one unknown.

The discount is 1/2. There the number of ways to seat c customers at t tables, each table of k of them weighing
(1/2)(3/2)...(k - 3/2), has the closed form (2c - t - 1)! / ((t - 1)! (c - t)! 4^(c - t)), so that the Gibbs step is exact for
any number of customers: all customers of a dish get up and are seated anew, by drawing their number of tables from its
conditional distribution given the parent and the other tables of the house. Draws are functions of the hashes of
words, contexts come with their exact sums, so no score depends on how documents are dealt over files, blocks or parts.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answered, collected, exchanged, expanded, fields, grouped, parts_of, ranked, sorting, squeezed, stored, unfields
from .bpe import sums
from .common import LOWER, named, stash, trim
from .minhash import MULTIPLIERS, mixed

#: The end of a text as a word: no word holds a line break. It is also the context of a text's first word.
END = b"\n"
DISCOUNT = 0.5


@dataclass(frozen=True)
class Settings:
    """strength of all restaurants; rounds of sampling (children given the parent, then the parent given the children), the first `burn` of which aren't averaged."""

    strength: float = 1.0
    rounds: int = 3
    burn: int = 0


def uniform(keys: np.ndarray, round_: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys, others in every round."""
    return (mixed(keys + MULTIPLIERS[round_ % 8] * np.uint64(2 * (round_ // 8) + 1)) >> np.uint64(11)) * 2.0**-53


def odds(t: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much likelier t + 1 tables of a dish with c customers are than t; falls with t. a: twice the strength and the house's other tables; b: twice the parent's probability."""
    return (c - t) * (a + t) * b / ((2 * c - 1 - t) * t)


def window(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) numbers of tables: eight deviations and eight tables to both sides of the likeliest; less than 1e-12 of the distribution lies beyond."""
    lo, hi = np.ones(len(c)), c.copy()
    while (open_ := lo < hi).any():  # the first t that t + 1 doesn't beat
        mid = np.floor((lo + hi) / 2)
        more = odds(mid, c, a, b) >= 1
        lo, hi = np.where(open_ & more, mid + 1, lo), np.where(open_ & ~more, mid, hi)
    at = np.clip(lo, 1, c - 2)
    bend = np.log(odds(at, c, a, b)) - np.log(odds(at + 1, c, a, b))
    reach = np.ceil(8 / np.sqrt(np.maximum(bend, 1e-12))) + 8
    return np.maximum(lo - reach, 1), np.minimum(lo + reach, c)


def drawn(c: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables for c > 1, by inversion at u. A dish is a column, summed on its own, so that a draw depends on its own dish alone."""
    first, last = np.ones(len(c)), c.copy()
    wide = np.flatnonzero(c > 32)
    if len(wide):
        first[wide], last[wide] = window(c[wide], a[wide], b[wide])
    n = last - first + 1
    n = np.where(n > 32, 2 ** np.ceil(np.log2(n)), n).astype(np.int64)
    out = np.empty(len(c), dtype=np.int64)
    order = np.argsort(n, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        k = int(n[mine[0]])
        for rows in np.array_split(mine, -(-len(mine) * k // (1 << 15))):
            t = first[rows] + np.arange(k - 1)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                more = odds(t, c[rows], a[rows], b[rows])
                more[t >= last[rows]] = 0
                weight = np.ones((k, len(rows)))
                if k <= 16:
                    np.cumprod(more, axis=0, out=weight[1:])
                else:
                    weight[0] = 0
                    np.cumsum(np.log(more), axis=0, out=weight[1:])
                    weight = np.exp(weight - weight.max(axis=0))
            weight = np.cumsum(weight, axis=0)
            out[rows] = first[rows] + (weight <= u[rows] * weight[-1]).sum(axis=0)
    return out


def seated(customers: np.ndarray, house: np.ndarray, base: np.ndarray, keys: np.ndarray, round_: int, strength: float) -> np.ndarray:
    """The dishes' numbers of tables, drawn from their conditional distributions. house: tables of other dishes; base: the parent's probability."""
    out = np.minimum(customers, 1)
    many = np.flatnonzero(customers > 1)
    for at in np.array_split(many, max(1, len(many) >> 16)):
        if len(at):
            out[at] = drawn(customers[at].astype(np.float64), 2 * strength + house[at], 2 * base[at], uniform(keys[at], round_))
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts in order of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def rows_of(block: int, parts: list[tuple[int, bytes]], payload: bytes | None = None, *, whole: bool = False) -> pa.RecordBatch:
    """Rows (block, part, blob), with whole (block, payload, part, blob) and the payload's row first."""
    first = [None] if payload is not None else []
    columns = [pa.array([block] * (len(first) + len(parts)), pa.int64()), pa.array([payload, *[None] * len(parts)] if first else [None] * len(parts), pa.binary()), pa.array(first + [p for p, _ in parts], pa.int32()), pa.array(first + [b for _, b in parts], pa.binary())]
    names = ["block", "payload", "part", "blob"]
    return pa.RecordBatch.from_arrays(columns, names=names) if whole else pa.RecordBatch.from_arrays([columns[i] for i in (0, 2, 3)], names=[names[i] for i in (0, 2, 3)])


#: A-Z in lower case and white space as spaces, on UTF-8 bytes; and a byte that no UTF-8 has, for END.
PLAIN = bytes(32 if c in b" \t\n\v\f\r" else l for c, l in enumerate(LOWER))
STOP = b"\xff"


def tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct tokens, the number of each token of all texts in order, tokens of each text). Found on the texts' bytes and numbered by Arrow, without an object for each token."""
    text = np.frombuffer(b"".join(t.encode() + b" " + STOP + b" " for t in texts).translate(PLAIN), dtype=np.uint8)
    letter = text != 32
    at = np.flatnonzero(np.diff(letter, prepend=False)).reshape(-1, 2)  # a text ends in a space
    offsets = np.append(0, np.cumsum(at[:, 1] - at[:, 0]))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text[letter])]).dictionary_encode()
    _, ends, body = coded.dictionary.buffers()
    ends, body = np.frombuffer(ends, dtype=np.int64)[: len(coded.dictionary) + 1].tolist(), body.to_pybytes()
    words, flat = [body[a:b] for a, b in itertools.pairwise(ends)], coded.indices.to_numpy().astype(np.int64)
    stop = words.index(STOP)
    words[stop] = END
    return words, flat, np.diff(np.flatnonzero(flat == stop), prepend=-1)


def token_blocks(docs: DataFrame, parts: int, text: str, held) -> DataFrame:
    """(block, payload, part, blob): texts as word numbers, and for each part the block's distinct words with training counts."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for ids, texts in collected(batches):
            words, flat, sizes = tokens(texts)
            order, flat = ranked(flat, len(words))
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)[order]
            # numbered by hash, and so by part: answers of all parts, in order, are in order of numbers; frequent words cost a rank table
            joint = np.argsort(hashes)
            number = np.empty(len(words), dtype=np.int64)
            number[joint] = np.arange(len(words))
            out = np.fromiter(map(held, ids), dtype=bool, count=len(ids))
            counts = np.bincount(number[flat[~np.repeat(out, sizes)]], minlength=len(words))
            missing = np.fromiter((i is None for i in ids), dtype=bool, count=len(ids))
            doc_ids = np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64)
            hashes = hashes[joint]
            payload = fields(squeezed(doc_ids), squeezed(missing), squeezed(out), squeezed(sizes), squeezed(flat), squeezed(number), squeezed(rising(hashes)))
            yield rows_of(block, [(p, fields(squeezed(rising(hashes[at])), squeezed(counts[at]))) for p, at in grouped(part_of(hashes, parts))], payload, whole=True)
            block += 1
            del words, flat, order, hashes, joint, number, payload
            trim()

    source = docs.select(F.col("doc_id").cast("long"), named(text).cast("string").alias("text"))
    return source.mapInArrow(run, "block long, payload binary, part int, blob binary")


def rising(sorted_: np.ndarray) -> np.ndarray:
    """Sorted numbers as the first and the differences."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def unrising(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


class Block:
    """A block's texts as sequences of word numbers, and its distinct pairs of neighbours."""

    def __init__(self, payload: bytes):
        doc_ids, missing, held, self.sizes, flat, number, hashes = unfields(payload)
        self.doc_ids = [None if m else i for i, m in zip(expanded(doc_ids).astype(np.uint64).view(np.int64).tolist(), expanded(missing).tolist(), strict=True)]
        self.held = expanded(held).astype(bool)
        self.sizes = expanded(self.sizes)
        self.words = expanded(number).astype(np.int32)[expanded(flat)]
        self.hashes = unrising(expanded(hashes))
        self.end = int(np.flatnonzero(self.hashes == np.uint64(xxhash.xxh3_64_intdigest(END)))[0])
        self.pairs = np.sort(self.neighbours())
        self.pairs = self.pairs[np.diff(self.pairs, prepend=-1) > 0]
        self.first, self.second = (x.astype(np.int32) for x in np.divmod(self.pairs, max(1, len(self.hashes))))
        self.keys = mixed(self.hashes[self.first] * MULTIPLIERS[0] + mixed(self.hashes[self.second]))
        self.order = sorting(self.keys).astype(np.int32)  # of requests and of answers

    def neighbours(self) -> np.ndarray:
        """Each word with the one before it as one number."""
        keys = np.full(len(self.words), self.end, dtype=np.int64)
        keys[1:] = self.words[:-1]
        return keys * len(self.hashes) + self.words

    @cached_property
    def pair(self) -> np.ndarray:
        """The place of each word's pair. Rounds need pairs alone, so this is found only where texts are scored, by a sort: look-ups all over the pairs take several times as long."""
        met_ = self.neighbours()
        order = sorting(met_)
        out = np.empty(len(order), dtype=np.int32)
        out[order] = np.cumsum(np.diff(met_[order], prepend=-1) > 0) - 1
        return out

    def trained(self) -> np.ndarray:
        """Training occurrences of each pair in the block."""
        met_ = np.sort(2 * self.neighbours() + np.repeat(self.held, self.sizes))
        return np.add.reduceat(1 - (met_ & 1), np.flatnonzero(np.diff(met_ >> 1, prepend=-1)))

    def of_pairs(self, answers: list[bytes], field: int) -> np.ndarray:
        """A field of the answers to pair requests, in the block's own order of pairs."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = joined(answers, field)
        return out


def joined(answers: list[bytes], field: int) -> np.ndarray:
    return np.concatenate([expanded(unfields(a)[field]).astype(np.int64) for a in answers])


def count_words(blobs: list[bytes]) -> list[bytes]:
    """Training counts and places of the words of a part, for every block that asks, and which it is the first to ask for; with the first answer, the part's numbers of known words and tokens."""
    asked = [tuple(map(expanded, unfields(b))) for b in blobs]
    at, mine, total = met([unrising(h) for h, _ in asked], [c for _, c in asked])
    own = np.array([(total > 0).sum(), total.sum()])
    return [fields(squeezed(total[x]), squeezed(rising(x)), squeezed(m), squeezed(own * (i == 0))) for i, (x, m) in enumerate(zip(at, mine, strict=True))]


def count_pairs(blobs: list[bytes]) -> list[bytes]:
    """Training occurrences of the pairs of a part, for every block that asks, and which it is the first to ask for."""
    asked = [tuple(map(expanded, unfields(b))) for b in blobs]
    at, mine, total = met([unrising(h) for h, _ in asked], [c for _, c in asked])
    return [fields(squeezed(total[x]), squeezed(m)) for x, m in zip(at, mine, strict=True)]


def met(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(places in order of hash, whether first asked for here) for each list of hashes, and the sum of the counts at each place."""
    keys = np.concatenate(hashes)
    order = sorting(keys)
    new = np.append(True, np.diff(keys[order]) > 0)[: len(keys)]
    at, first = np.empty(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    first[order[new]] = 1
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    return np.split(at, ends), np.split(first, ends), total


def pair_requests(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, blob): the block's distinct pairs as 64-bit hashes with training counts. A pair's part follows from both words, so no context is a hot one."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(payload.as_py())
                keys, trained = b.keys[b.order], b.trained()[b.order]
                yield rows_of(block, [(p, fields(squeezed(rising(keys[at])), squeezed(trained[at]))) for p, at in grouped(part_of(keys, parts))])
                del b, keys, trained
                trim()

    return blocks.mapInArrow(run, "block long, part int, blob binary")


class House:
    """What a block has been told of its words after a round: customers and tables of each in the parent, tables that it makes as a context, and the parent's totals."""

    def __init__(self, answers: list[bytes], totals_: tuple[int, int], v: int, strength: float):
        served, tables, self.made = (joined(answers, i) for i in range(3))
        customers, tables_all = totals_
        self.parent = (served - DISCOUNT * tables + (strength + DISCOUNT * tables_all) / (v + 1)) / (strength + customers)


def reports(table: DataFrame, parts: int, round_: int, totals_: tuple[int, int], v: int, settings: Settings) -> DataFrame:
    """(block, payload, part, blob): after a round, the tables of the block's pairs as payload, and for each part what its words have and make of those pairs that the block reports.

    table: (block, payload, words, pairs), from round 1 on the last one's house, and from round 2 on its tables. In round 0
    each dish has one table.
    """

    def run(batches):
        for batch in batches:
            for block, payload, words, pairs, *more in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, batch.num_columns)), strict=True):
                b = Block(payload.as_py())
                words, pairs = words.as_py(), pairs.as_py()
                customers, mine = b.of_pairs(pairs, 0), b.of_pairs(pairs, 1)
                tables = np.minimum(customers, 1)
                if more:
                    house = House(more[0].as_py(), totals_, v, settings.strength)
                    before = expanded(more[1].as_py()).astype(np.int64) if len(more) > 1 else tables
                    tables = seated(customers, house.made[b.first] - before, house.parent[b.second], b.keys, round_, settings.strength)
                shown = tables * mine
                served = np.bincount(b.second, weights=shown, minlength=len(b.hashes)).astype(np.int64)
                made = np.bincount(b.first, weights=shown, minlength=len(b.hashes)).astype(np.int64)
                place, first = np.concatenate([unrising(expanded(unfields(a)[1])) for a in words]), joined(words, 2)
                asked = [(p, fields(squeezed(rising(place[at])), squeezed(served[at]), squeezed(made[at]), squeezed(first[at]), squeezed(rising(b.hashes[at][first[at] == 1])))) for p, at in grouped(part_of(b.hashes, parts))]
                yield rows_of(block, asked, squeezed(tables), whole=True)
                del b, customers, mine, tables, shown, asked
                trim()

    return table.mapInArrow(run, "block long, payload binary, part int, blob binary")


def seat_words(v: int, round_: int, last: tuple[int, int] | None, settings: Settings):
    """The answer of a part of the vocabulary: each word's customers and tables in the parent and its tables as a context; with the first, the part's sums of customers and tables."""

    def answer(blobs: list[bytes]) -> list[bytes]:
        asked = [list(map(expanded, unfields(b))) for b in blobs]
        place = [unrising(a[0]).astype(np.int64) for a in asked]
        at = np.concatenate(place)
        n = int(at.max()) + 1
        served, made = (np.bincount(at, weights=np.concatenate([a[i] for a in asked]), minlength=n).astype(np.int64) for i in (1, 2))
        keys = np.zeros(n, dtype=np.uint64)
        for x, a in zip(place, asked, strict=True):
            keys[x[a[3] == 1]] = unrising(a[4])
        tables = np.minimum(served, 1)
        if last is not None:
            # the other words' tables, as of the last round, when each word had at least one
            tables = seated(served, np.full(n, max(last[1] - 1, 0)), np.full(n, 1 / (v + 1)), keys, round_, settings.strength)
        own = np.array([served.sum(), tables.sum()])
        return [fields(squeezed(served[x]), squeezed(tables[x]), squeezed(made[x]), squeezed(own * (i == 0))) for i, x in enumerate(place)]

    return answer


def totals(answers: DataFrame, at: int) -> tuple[int, int]:
    """Sums over all answers of the two numbers in field at."""

    def run(batches):
        for batch in batches:
            got = [expanded(unfields(x.as_py())[at]).tolist() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(g[i]) for g in got], pa.int64()) for i in (0, 1)], names=["x", "y"])

    r = answers.select("blob").mapInArrow(run, "x long, y long").agg(F.sum("x"), F.sum("y")).first()
    return r[0] or 0, r[1] or 0


def held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    """Whether a document is kept from training: crc32 of doc_id as text, mod 7, is 2. Documents without doc_id are."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == remainder


def score(docs: DataFrame, text: str = "text", held=held_out, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens are words with A-Z lower-cased, then one end. base_score adds log10((c + 1) / (N + V + 1)) over tokens;
    score is the model's log10 probability, predictive probabilities averaged over the rounds after the burn-in.

    All dishes begin with one table. In each round every child restaurant is seated given the parent's probabilities and the
    tables in its own house, then the parent given the children's tables. The dishes of a house are seated at once
    given its tables of the round before, whose exact sums all parts exchange between rounds.

    Blocks of texts are stored as word numbers; words and pairs of words meet by hash in parts, every one once for
    each block, however frequent. Words and pairs are known by 64-bit hashes. Null texts have the end alone. doc_id may be
    null (held out) or repeated (rows are scored on their own). An empty table gives an empty result, and a table
    without training documents scores by the uniform base.
    """
    parts = parts_of(docs)
    table = stored(token_blocks(docs, parts, text, held), parts)
    blocks = table.where("payload is not null").select("block", "payload")
    asked = lambda t: t.where("payload is null").select("block", "part", "blob")
    words = stash(exchanged(asked(table), count_words, parts))
    v, n = totals(words, 3)
    pairs = stash(exchanged(pair_requests(blocks, 4 * parts), count_pairs, 4 * parts))
    known = answered(blocks, parts, words, pairs)

    houses: list[DataFrame] = []
    states: list[DataFrame] = []
    sums_: list[tuple[int, int]] = []
    for r in range(settings.rounds + 1):
        now = known if not r else beside(answered(known, parts, houses[-1], first=2), *states[-1:] if r > 1 else ())
        out = stored(reports(now, parts, r, sums_[-1] if r else (0, 0), v, settings), parts)
        states.append(out.where("payload is not null").select("block", F.col("payload").alias("tables")))
        houses.append(stash(exchanged(asked(out), seat_words(v, r, sums_[-1] if r else None, settings), parts)))
        sums_.append(totals(houses[-1], 3))
    kept = range(settings.burn + 1, settings.rounds + 1)
    final = beside(answered(known, parts, *(houses[r] for r in kept), first=2), *(states[r] for r in kept))
    strength, kept_sums = settings.strength, [sums_[r] for r in kept]

    def run(batches):
        for batch in batches:
            for payload, by_word, by_pair, *more in zip(*(batch.column(i) for i in range(1, batch.num_columns)), strict=True):
                b = Block(payload.as_py())
                counts, customers = joined(by_word.as_py(), 0), b.of_pairs(by_pair.as_py(), 0)
                p = np.zeros(len(b.first))
                for house, tables, total in zip(more[: len(kept_sums)], more[len(kept_sums) :], kept_sums, strict=True):
                    h = House(house.as_py(), total, v, strength)
                    p += (customers - DISCOUNT * expanded(tables.as_py()) + (strength + DISCOUNT * h.made[b.first]) * h.parent[b.second]) / (strength + counts[b.first])
                base = np.log10((counts + 1) / (n + v + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.doc_ids, pa.int64()), pa.array(b.held), pa.array(b.sizes), pa.array(sums((counts[b.words] > 0).astype(np.int64), b.sizes)),
                        pa.array(np.full(len(b.sizes), n, dtype=np.int64)), pa.array(exact_sums(base[b.words], b.sizes)), pa.array(exact_sums(np.log10(p / len(kept_sums))[b.pair], b.sizes)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del b, counts, customers, p, h, base
                trim()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return final.mapInArrow(run, schema)


def beside(table: DataFrame, *states: DataFrame) -> DataFrame:
    """table with the tables column of each of states, joined by block where both lie."""
    for i, s in enumerate(states):
        table = table.join(s.withColumnRenamed("tables", f"t{i}"), "block", "left")
    return table


def exact_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run on its own, so that a text's score doesn't depend on its block."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
