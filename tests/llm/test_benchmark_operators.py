"""Ranked search, vector codes and decontamination: against brute force and their SQL."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from purposegraph.llm import decontaminate, queries, ranked_search, terms, vector_codes
from tests.oracle import both

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"), (2, "Short one"), (3, None), (4, "?!"), (5, "the"), (None, "a b a b a b a b a b a"), (6, "b a b"),
    (2, "Other text of two"), (7, "é中 ß x1 " * 8), (8, "the quick brown fox jumps over the lazy dog and runs home"),
]
DOCS = [
    (1, None), (2, ""), (3, "I say: the Quick, brown fox; jumps over the lazy dog and runs away. Done"), (3, "short one"), (3, "short one"), (4, "a b a b a b a b a b a b a b a"), (5, "x " * 50_000 + "short ONE"),
    (None, "THE"), (6, "é中 ß x1 " * 5), (7, "quick brown fox jumps over the lazy dog and runs home again"), (8, "quick-brown-fox"), (9, "\x00\x01 é\x85the"), (10, "b a b b a b"), (11, "the quick brown the quick brown"),
]


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(terms.UPPER, terms.LOWERED)))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_vector_codes", "op13_decontaminate"])
def test_matches_sql(spark, sf, name):
    got, want = both(spark, sf, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want


def windows_of(text, k):
    w = words(text)
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def hits(text, items, k):
    w = words(text)
    hit, own = set(), set()
    for item, other in items:
        for g in windows_of(other, k):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    own.add("" if item is None else str(item))
    return len(w), hit, own


@pytest.mark.parametrize("most", [200_000, 15])
@pytest.mark.parametrize("k", [10, 3])
def test_scan_equals_brute_force(tables, monkeypatch, most, k):
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", most)
    docs, items = tables
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(i for s in r["spans"] for i in range(s["begin"], s["end"])), tuple(r["items"])) for r in decontaminate.scan(docs, items, k).collect())
    want = collections.Counter()
    for d, t in DOCS:
        n, hit, own = hits(t, ITEMS, k)
        want[d, n, tuple(sorted(hit)), tuple(sorted(own))] += 1
    assert got == want


def test_automaton_equals_brute_force_on_few_words():
    """Words of a small vocabulary, where suffixes, repeats and short items inside longer ones abound."""
    draw = random.Random(3)
    for _ in range(300):
        k = draw.randint(1, 5)
        sequences = [[draw.randrange(3) for _ in range(draw.randint(0, 9))] for _ in range(draw.randint(1, 5))]
        text = [draw.randrange(4) for _ in range(draw.randint(0, 30))]
        spans, owners = decontaminate.Automaton(k).built(sequences).run(text)
        hit, own = set(), set()
        for j, s in enumerate(sequences):
            n = min(k, len(s))
            for g in {tuple(s[i : i + n]) for i in range(len(s) - n + 1)} if s else ():
                for i in range(len(text) - n + 1):
                    if tuple(text[i : i + n]) == g:
                        hit |= set(range(i, i + n))
                        own.add(j)
        assert {i for a, b in spans for i in range(a, b)} == hit and owners == own
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) or spans == sorted(spans)


def test_decontaminated_texts(spark, tables, empty):
    docs = spark.createDataFrame([(1, "Well. The quick brown fox jumps over the lazy dog and runs away! And so on, said a very long other text of many words", "x"), (2, "the quick brown fox jumps over the lazy dog and runs home", "y"), (3, None, "z"), (4, "short one", None)], "n_words int, text string, spans string")
    got = {r["n_words"]: (r["text"], r["spans"]) for r in decontaminate.decontaminate(docs, tables[1]).collect()}
    assert got[1][0] == "Well. ! And so on, said a very long other text of many words"
    assert set(got) == {1, 3} and got[1][1] == "x" and got[3] == (None, "z")
    assert decontaminate.report(empty[0], tables[1]).count() == 0
    assert decontaminate.report(tables[0], empty[1]).where("contaminated or n_items > 0").count() == 0
    assert decontaminate.decontaminate(tables[0], empty[1]).count() == len(DOCS)


def ranked(docs, items, k):
    counts = [collections.Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = collections.Counter()
    for i, own in asked.items():
        scored = []
        for (d, _), c, n in zip(docs, counts, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out.update((i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1))
    return out


@pytest.mark.parametrize(("k", "most", "block"), [(50, 100_000, 6 << 20), (3, 10, 200), (1, 4, 1)])
def test_search_equals_brute_force(tables, monkeypatch, k, most, block):
    monkeypatch.setattr(ranked_search, "SEARCH_TERMS", most)
    monkeypatch.setattr(terms, "BLOCK_CHARS", block)
    docs, items = tables
    got = collections.Counter(map(tuple, ranked_search.search(docs, items, k).collect()))
    assert got == ranked(DOCS, ITEMS, k)


def test_search_in_random_texts(spark, empty, monkeypatch):
    """Zipf-like words in many small blocks, so that thresholds and bounds cut; equal texts make ties."""
    monkeypatch.setattr(terms, "BLOCK_CHARS", 300)
    draw = random.Random(5)
    name = lambda: f"w{int(draw.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(name() for _ in range(draw.randint(1, 60)))) for i in range(300)]
    docs += [(300 + i, docs[i % 7][1]) for i in range(40)]
    items = [(i, " ".join(name() for _ in range(draw.randint(1, 25)))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert collections.Counter(map(tuple, ranked_search.search(frame, asked, 10).collect())) == ranked(docs, items, 10)
    assert ranked_search.search(empty[0], asked).count() == 0
    assert ranked_search.search(frame, empty[1]).count() == 0


def codes(rows, parts, entries, rounds):
    good = [(k, label, [math.floor(256 * float(np.float32(x))) for x in v]) for k, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def place(v, p):
        return min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = collections.defaultdict(list)
            for _, _, v in good:
                members[place(v, p)[1]].append(cut(v, p))
            for e, own in members.items():
                new[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    done = [(k, label, "".join(f"{place(v, p)[1]:02x}" for p in range(parts)), sum(place(v, p)[0] for p in range(parts))) for k, label, v in good]
    of_label = collections.Counter()
    for _, label, _, e in done:
        of_label[label] += e
    return collections.Counter((k, label, c, e, of_label[label], digest) for k, label, c, e in done)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (2, 64, 1), (8, 1, 3)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    draw = random.Random(7)
    rows = [(i if i else None, draw.choice([None, 1, 2]), [draw.choice([draw.gauss(0, 1), 0.0, -0.5, 1000.0]) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, 1, rows[i][2]) for i in range(20)] + [(3, None, rows[3][2]), (900, 1, None), (901, 1, [1.0] * 7 + [None]), (902, 2, [float("nan")] * 8), (903, 2, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = collections.Counter(map(tuple, vector_codes.compress(frame, parts=parts, entries=entries, rounds=rounds).collect()))
    assert got == codes(rows, parts, entries, rounds)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>, key string, code int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 1, [], "a", 1), (2, 1, [1.0] * 16, "b", 2), (3, 1, [1.0] * 32, "c", 3), (4, None, [1e30] * 16, "d", 4), (5, 1, [2.0] * 10, "e", 5)]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compress(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, None), 2: ("00" * 16, 0), 3: (None, None), 4: ("01" * 16, 0), 5: (None, None)}


def test_filter_leaves_few_entries_and_never_the_nearest():
    draw = np.random.default_rng(2)
    cells = vector_codes.Cells(draw.integers(-400, 400, (64, 4)))
    x = draw.integers(-500, 500, (1000, 4))
    entry, far, measured = cells.nearest(x)
    exact = ((x[:, None] - cells.entries[None]) ** 2).sum(axis=2)
    assert (entry == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert measured < 0.2 * exact.size
