"""Line dedup, near-dedup, embeddings, language-model scores, components, the pipeline: against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from purposegraph.llm import blocks, common, embedding_dedup, line_dedup, minhash, pitman_yor, quality, queries
from tests.oracle import both

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(draw.randint(100, 300), draw.randint(100, 300)) for _ in range(150)] + [(500, k) for k in range(501, 600)]
    got = {r["v"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for e in links for x in e}, links)
    assert got == {v: r for v, r in want.items() if any(v in e and e[0] != e[1] for e in links)}


def test_minhash(spark, sf):
    draw = random.Random(3)
    w = [f"w{i}" for i in range(200)]
    odd = [(10000 + i, " ".join("x" if draw.random() < 0.015 else x for x in w)) for i in range(60)]
    odd += [(20000 + i, " ".join(w[:100] + [f"z{i}_{k}" for k in range(40)])) for i in range(30)]
    odd += [(30000, "a b"), (30001, "A B"), (30002, ""), (30003, None), (None, "a b"), (None, None), (30005, " \n"), (30000, "a b"), (30006, "a b c d e"), (30007, "A b c d E")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    sets = []
    for i, t in rows:
        x = words(t)
        sets.append((i, frozenset(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))) if x else frozenset()))
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots({i for i, _ in sets if i is not None}, links)
    want = {(i, len(x), root.get(i), i is None or root[i] == i) for i, x in sets}
    clash = docs.withColumn("rep", F.lit(1)).withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    assert {tuple(r) for r in minhash.near_duplicates(clash).collect()} == want
    assert minhash.keep_first(clash).columns == clash.columns
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_circulant_signatures_estimate_jaccard():
    sign, draw = minhash.Circulant(240), np.random.default_rng(0)
    x = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = sign.signature(np.unique(x[:320])), sign.signature(np.unique(x[80:]))
    assert abs((a == b).mean() - 0.6) < 0.12


def test_embeddings(spark, sf, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    draw = np.random.default_rng(0)
    b = draw.standard_normal(64)
    odd = [(10000 + i, [float(x) for x in (b + draw.standard_normal(64) * 0.12).astype("f4")], 3) for i in range(100)]
    odd += [(20000 + i, [float(x) for x in b.astype("f4")], 4) for i in range(50)]
    odd += [(30000, None, 1), (30001, [0.0] * 64, 1), (30002, [1.0] * 64, None), (30003, [1.0, 2.0], 1), (30004, [2.0, 4.0], 1), (30005, [math.nan] * 64, 1), (30006, [], 1), (30007, [1.0, None], 1)]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").union(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int"))
    groups, ids, links = collections.defaultdict(list), [], []
    for i, v, label in rows.collect():
        ids.append(i)
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            groups[label, len(v)].append((i, np.array(v, float)))
    for g in groups.values():
        x = np.stack([v for _, v in g])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links += [(g[p][0], g[q][0]) for p, q in zip(*np.nonzero(x @ x.T >= 0.98), strict=True) if p != q]
    n, root = collections.Counter(a for a, _ in links), roots(ids, links)
    assert {tuple(r) for r in embedding_dedup.near_duplicates(rows).collect()} == {(i, n[i], root[i], root[i] == i) for i in ids}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], rows.schema)).count() == 0


@pytest.mark.parametrize("name", ["op8_embedding_dedup", "op10_minhash_dedup"])
def test_matches_sql(spark, sf, name):
    got, want = both(spark, sf, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_patience(seed):
    draw = random.Random(seed)
    for _ in range(100):
        a, b = ([draw.randint(0, 12) for _ in range(draw.randint(0, 15))] for _ in range(2))
        i = j = 0
        for p, q, n in line_dedup.patience(a, b):
            assert n and p >= i and q >= j and a[p : p + n] == b[q : q + n]
            i, j = p + n, q + n
    same = [draw.random() for _ in range(50)]
    assert line_dedup.patience(same, same) == [(0, 0, 50)]


def brute_lines(rows, least_line=8, least_block=20):
    """Cut places by the stated rule: every text against the first holder of each of its longer lines."""
    firsts = {}
    for i, t in sorted(((i if i is not None else 2**63 - 1, t or "") for i, t in rows)):
        firsts.setdefault(t, i)
    keyed = {t: [x.strip() for x in t.split("\n")] for t in firsts}
    holder = {}
    order = sorted(firsts, key=lambda t: (firsts[t], line_dedup.xxhash.xxh3_128_digest(t.encode())))
    for t in order:
        for x in keyed[t]:
            if len(x.split()) >= least_line:
                holder.setdefault(x, t)
    out = {}
    for t in order:
        cut = set()
        for other in {holder[x] for x in keyed[t] if x in holder} - {t}:
            for _, j, n in line_dedup.patience(keyed[other], keyed[t]):
                if sum(len(x.split()) for x in keyed[t][j : j + n]) >= least_block:
                    cut |= set(range(j, j + n))
        out[t] = cut
    result = []
    for i, t in rows:
        lines = (t or "").split("\n")
        if t is None:
            result.append((i, None, 0, 0))
        elif (i if i is not None else 2**63 - 1) > firsts[t] and sum(len(x.split()) for x in lines) >= least_block:
            result.append((i, "", len(lines), len(lines)))
        else:
            result.append((i, "\n".join(x for k, x in enumerate(lines) if k not in out[t]), len(lines), len(out[t])))
    return collections.Counter(result)


def test_line_dedup(spark, sf):
    long, more = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(12))
    odd = [
        (9000, f"a\n{long}\n{more}\nb"), (9001, f"c\n{long}\n{more}\n  d"), (9002, f"{more}\nfoo"), (9003, f"a\n{long}\n{more}\nb"), (9004, None), (9005, ""), (None, f"z\n{long}"),
        (9003, f"a\n{long}\n{more}\nb"), (9006, "e\n" * 3000 + long),
    ]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs.withColumn("th", F.lit(1)).withColumn("n_lines", F.lit("x")))
    assert out.columns == ["doc_id", "text", "th", "n_lines", "n_removed"]
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def every_cut(rows, least=20):
    """Cut places by the whole rule: stretches of lines of at least so many words, without empty ends, that any earlier text holds."""
    seen, out = [], {}
    for i, t in rows:
        mine = [x.strip() for x in t.split("\n")]
        size = [len(x.split()) for x in mine]
        cut = set()
        for other in seen:
            for p in range(len(mine)):
                for q in range(len(other)):
                    n = 0
                    while p + n < len(mine) and q + n < len(other) and mine[p + n] == other[q + n]:
                        n += 1
                    while n and not size[p + n - 1]:
                        n -= 1
                    if n and size[p] and sum(size[p : p + n]) >= least:
                        cut |= set(range(p, p + n))
        seen.append(mine)
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
    return out


def test_line_dedup_of_passages_whose_lines_have_other_first_holders(spark):
    line = lambda k: " ".join(f"p{k}_{j}" for j in range(12))
    passage = "\n".join(map(line, range(5)))
    rows = [(k, f"a{k}\n{line(k)}\nz{k}") for k in range(5)] + [(5, f"b\n{passage}\nbb"), (6, f"c\n{passage}\ncc")]
    rows += [(7, f"d\n{line(1)}\n{line(2)}\nx y\ne"), (8, f"f\n{line(1)}\n{line(2)}\nx y\ng")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == every_cut(rows) and got[6] == "c\ncc" and got[8] == "f\ng"


def test_line_dedup_of_passages_of_short_lines(spark):
    verse = "\n".join(" ".join(f"v{k}_{j}" for j in range(6)) for k in range(10))
    rows = [(0, f"one\n{verse}\ntwo"), (1, f"three\n\n{verse}\nfour"), (2, "five\nv0_0 v0_1 v0_2 v0_3 v0_4 v0_5\nsix")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == every_cut(rows) and got[1] == "three\n\nfour" and got[2] == rows[2][1]


def test_line_dedup_of_repeated_and_moved_passages(spark):
    draw = random.Random(5)
    p, q, r = ("\n".join(" ".join(f"{k}{i}_{j}" for j in range(12)) for i in range(5)) for k in "pqr")
    rows = [(0, f"h\n{p}\nm\n{p}\nt"), (1, f"g\n{p}\nu"), (2, f"a\n{q}\nb\n{r}\nc"), (3, f"d\n{r}\ne\n{q}\nf"), (4, f"i\n{q}\nj\n{q}\nk")]
    rows += [(10 + i, "\n".join(" ".join(f"{draw.choice('xyz')}{n}" for _ in range(n)) if n else "" for n in draw.choices([0, 0, 1, 1, 1, 9, 12], k=draw.randint(10, 40)))) for i in range(60)]
    rows += [(80 + i, "\n".join(draw.choices(["s", "t", "long " * 10, "u v w x y z", "one two three four"], k=30))) for i in range(30)]
    # no empty lines at the ends of stretches: patience may delete them too
    rows = [(i, "\n".join(x for x in t.split("\n") if x)) for i, t in rows]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == every_cut(rows) and (got[1], got[3], got[4]) == ("g\nu", "d\ne\nf", "i\nj\nk")


def test_language_model(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "PART_BYTES", 100_000)
    odd = [(9000, None), (9001, ""), (None, "null id"), (9002, "THE the tHe"), (9002, "dup")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    c = collections.Counter()
    for i, t in rows:
        if not pitman_yor.held_out(i):
            c.update([*words(t), "\n"])
    n, v, want = sum(c.values()), len(c), collections.Counter()
    for i, t in rows:
        w = [*words(t), "\n"]
        want[i, pitman_yor.held_out(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    got = pitman_yor.score(docs).collect()
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    assert pitman_yor.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def seating_weights(c, house, base, strength=1.0):
    """log weights of 1 to c tables, by the closed form."""
    total, out = 0.0, []
    for t in range(1, c + 1):
        total += math.log((strength + 0.5 * (house + t - 1)) * base)
        out.append(total + math.lgamma(2 * c - t) - math.lgamma(t) - math.lgamma(c - t + 1) - 2 * (c - t) * math.log(2))
    return np.array(out)


def test_seating_weights_equal_enumeration():
    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    for n, house, base in ((4, 0, 0.3), (5, 7, 0.02), (6, 2, 0.9)):
        weight = np.zeros(n)
        for p in partitions(list(range(n))):
            w = 1.0
            for k in range(len(p)):
                w *= (1.0 + 0.5 * (house + k)) * base
            for table in p:
                for k in range(1, len(table)):
                    w *= k - 0.5
            weight[len(p) - 1] += w
        closed = np.exp(seating_weights(n, house, base))
        assert np.allclose(closed / closed.sum(), weight / weight.sum())


@pytest.mark.parametrize(("c", "house", "base"), [(2, 0, 0.4), (7, 30, 0.05), (40, 5, 0.3), (600, 900, 0.02), (3000, 0, 0.99), (5000, 100_000, 0.01)])
def test_seating_draws_follow_the_weights(c, house, base):
    n = 4000
    keys = np.random.default_rng(c).integers(0, 1 << 63, n).astype(np.uint64)
    got = pitman_yor.seated(np.full(n, c), np.full(n, house), np.full(n, base), keys, 1, 1.0)
    w = seating_weights(c, house, base)
    p = np.exp(w - w.max())
    p /= p.sum()
    t = np.arange(1, c + 1)
    mean, sd = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
    assert got.min() >= 1 and got.max() <= c and abs(got.mean() - mean) < 4 * sd / math.sqrt(n) + 1e-9
    below = np.array([(got <= x).mean() for x in t])
    assert np.abs(below - np.cumsum(p)).max() < 2.2 / math.sqrt(n)
    # a draw is the dish's own, whatever is seated with it
    assert pitman_yor.seated(np.array([1, c, 0, 9]), np.array([0, house, 3, 1]), np.array([0.1, base, 0.1, 0.2]), keys[[5, 0, 1, 2]], 1, 1.0)[1] == got[0]


def plain_scores(rows, rounds):
    """The model over dictionaries, with the operator's random numbers and the closed form."""
    h = lambda w: np.uint64(minhash.xxhash.xxh3_64_intdigest(w.encode()))
    word_key = lambda w: np.array([h(w)])
    pair_key = lambda u, w: minhash.mixed(word_key(u) * minhash.MULTIPLIERS[0] + minhash.mixed(word_key(w)))

    def draw(c, house, base, key, r):
        p = np.exp((x := seating_weights(c, house, base)) - x.max()).cumsum()
        return 1 + int((p <= pitman_yor.uniform(key, r)[0] * p[-1]).sum())

    texts = [(i, [*words(t), "\n"]) for i, t in rows]
    count, pairs = collections.Counter(), collections.Counter()
    for i, w in texts:
        if not pitman_yor.held_out(i):
            count.update(w)
            pairs.update(zip(["\n", *w[:-1]], w, strict=True))
    v, total = len(count), collections.Counter()
    tables, kept = dict.fromkeys(pairs, 1), []
    parent_tables, all_parent = {}, 0
    for r in range(rounds + 1):
        if r:
            tables = {(u, w): draw(c, made[u] - tables[u, w], parent(w), pair_key(u, w), r) for (u, w), c in pairs.items()}
        served, made = collections.Counter(), collections.Counter()
        for (u, w), t in tables.items():
            served[w] += t
            made[u] += t
        parent_tables = {w: draw(c, all_parent - 1, 1 / (v + 1), word_key(w), r) if r else 1 for w, c in served.items()}
        all_parent, customers = sum(parent_tables.values()), sum(served.values())
        parent = lambda w, s=served, t=parent_tables, a=all_parent, n=customers: (s[w] - 0.5 * t.get(w, 0) + (1 + 0.5 * a) / (v + 1)) / (1 + n)
        if r:
            kept.append((tables, made, parent))
    out = []
    for i, w in texts:
        total = 0.0
        for u, x in zip(["\n", *w[:-1]], w, strict=True):
            total += math.log10(np.mean([(pairs[u, x] - 0.5 * t.get((u, x), 0) + (1 + 0.5 * m[u]) * p(x)) / (1 + count[u]) for t, m, p in kept]))
        out.append((i, round(total, 7)))
    return collections.Counter(out)


def test_language_model_equals_plain_sampling_in_any_layout(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 120 or doc_id = 150").union(spark.createDataFrame([(None, "null id"), (9001, ""), (9002, "a b " * 400)], "doc_id long, text string"))
    want = plain_scores([tuple(r) for r in docs.collect()], pitman_yor.Settings().rounds)
    for part_bytes, block_chars, n in ((8 << 20, 6 << 20, 1), (60_000, 40_000, 3), (9_000, 5_000, 7)):
        monkeypatch.setattr(blocks, "PART_BYTES", part_bytes)
        monkeypatch.setattr(blocks, "BLOCK_CHARS", block_chars)
        got = pitman_yor.score(docs.repartition(n)).collect()
        assert collections.Counter((r["doc_id"], round(r["score"], 7)) for r in got) == want


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stash(stage(spark, docs, sf))
        after[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    kept = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in after["quality_rules"].collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in after["quality_rules"].collect()]
    assert {(r["doc_id"], r["text"]) for r in after["line_dedup"].collect()} == {k[:2] for k in brute_lines(rows)}
    assert {r["doc_id"] for r in after["best_fit_packing"].collect()} == {r["doc_id"] for r in after["personal_data"].collect()} <= {r["doc_id"] for r in after["near_dedup"].collect()}
    assert after["personal_data"].where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_minhash_of_texts_that_share_one_passage(spark):
    draw = random.Random(8)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for i in range(150):
        own = [f"u{i}_{k}" for k in range(draw.choice((5, 14, 18, 22, 26, 30, 40, 60)))]
        texts.append((i, " ".join(passage + own if i % 2 else own + passage)))
    texts += [(200 + i, " ".join(f"q{k}" if draw.random() > 0.012 else f"v{i}_{k}" for k in range(150))) for i in range(80)]
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in texts)}
    links = {(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and 100 * len(x & y) >= 75 * len(x | y)}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    members = spark.createDataFrame([(i, i, len(x)) for i, x in sets.items()], "rep long, root long, n long")
    able = {tuple(r) for r in minhash.sharing_rare(members, minhash.sets_of(docs, "text", 5), 75).collect()}
    assert links <= able and len(able) < 1.2 * len(links) < len(sets) * (len(sets) - 1) / 2
    root = roots(sets, links)
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, rounds=1).collect()} == set(root.items())
