"""Byte-pair merging on ragged numpy arrays, and the word splitters of the public tokenizer files."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

NONE = np.int64(1 << 40)
#: Letters and numbers up to U+00FF, as character classes; with them Python's re splits plain texts, faster than Unicode properties do.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Merges:
    """Rank-synchronous merging: in each round every sequence applies its own lowest-rank pair, at all its places at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = self.vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first: dict[int, tuple[int, int]] = {}
        for rank, (x, y) in enumerate(pairs):
            first.setdefault(vocab[x] << 20 | vocab[y], (rank, vocab[x + y]))
        order = sorted(first)
        self.keys = np.array(order, dtype=np.int64)
        self.ranks = np.array([first[k][0] for k in order], dtype=np.int64)
        self.made = np.zeros(len(pairs), dtype=np.int64)
        for rank, new in first.values():
            self.made[rank] = new
        back = {c: b for b, c in enumerate(chars)}
        self.pieces = {i: bytes(back[c] for c in s.removesuffix(end) if c in back) for s, i in vocab.items()}
        for t in spec["added_tokens"]:
            self.pieces[t["id"]] = t["content"].encode()

    def _ranks(self, sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; NONE where none does."""
        key = np.empty(len(sym), dtype=np.int64)
        key[:-1] = sym[:-1] << 20 | sym[1:]
        key[ends] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def run(self, words: list[bytes], keep_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(number of surviving symbols of each word, all their ids in order or None). Empty words have none."""
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        out_seq, out_sym = [], []
        seq = np.flatnonzero(counts)
        size = counts[seq]
        sym = self.inner[flat]
        if len(seq):
            tails = np.cumsum(size) - 1
            sym[tails] = self.last[flat[tails]]
        while len(seq):
            ends = np.cumsum(size) - 1
            starts = ends - size + 1
            rank = self._ranks(sym, ends)
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                counts[seq[over]] = size[over]
                mine = np.repeat(over, size)
                if keep_ids:
                    out_seq.append(np.repeat(seq[over], size[over]))
                    out_sym.append(sym[mine])
                go = ~over
                seq, size, low, sym, rank = seq[go], size[go], low[go], sym[~mine], rank[~mine]
                if not len(seq):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            run = np.ones(len(at), dtype=bool)
            run[1:] = np.diff(at) != 1
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]  # "aaa": leftmost pairs, not overlapping
            sym[at] = self.made[rank[at]]
            owner = np.searchsorted(np.cumsum(size), at, side="right")
            sym = np.delete(sym, at + 1)
            size = size - np.bincount(owner, minlength=len(size))
        if not keep_ids:
            return counts, None
        if not out_seq:
            return counts, np.empty(0, dtype=np.int64)
        where, ids = np.concatenate(out_seq), np.concatenate(out_sym)
        return counts, ids[np.argsort(where, kind="stable")]


class ByteLevel:
    """Splitter of byte_bpe_50k.json: special strings first, then the public pattern.

    Characters from U+0558 on are classed by the library itself, since Unicode versions differ there.
    """

    LATER = regex.compile("[\u0558-\U0010ffff]")
    OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-\xff]")
    PLAIN = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string is an item of its own."""
        if "<|" not in text:
            return self._plain(text)
        out = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.OTHER.search(text):
            return self.PLAIN.findall(text)
        if not self.LATER.search(text):
            return self.pattern.findall(text)
        return [text[x:y] for _, (x, y) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class WordLevel:
    """Splitter of word_bpe_49k.json: normalised lower-case words without white space.

    Texts of plain ASCII and Latin-1 are split here; any other character leaves the text to the library.
    """

    #: The tokenizer file's pattern, for these characters.
    PLAIN = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
    OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def words(self, text: str) -> list[str] | None:
        """Words in order, or None where the library must encode the text."""
        if "<|" in text or self.OTHER.search(text):
            return None
        return self.PLAIN.findall(text.lower())


class Codes(dict):
    """Numbers items in order of first appearance."""

    def __missing__(self, item):
        self[item] = n = len(self)
        return n


def coded(sequences: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct items, the number of each item of all sequences in order, length of each sequence)."""
    sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    codes = Codes()
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(sequences)), dtype=np.int64, count=int(sizes.sum()))
    return list(codes), flat, sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of sizes[i] values; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def gathered(flat: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """All ids of a sequence of items, where item i has counts[i] consecutive ones in ids."""
    n = counts[flat]
    first = np.cumsum(counts) - counts
    return ids[np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Cache(dict):
    """Item to value over a worker's batches; emptied beyond a fixed number of items."""

    LIMIT = 250_000

    def values_of(self, items: list, compute) -> list:
        """The value of each item; compute gets a list of those not held and returns theirs."""
        new = [x for x in items if x not in self]
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = items
        self.update(zip(new, compute(new), strict=True))
        return [self[x] for x in items]
