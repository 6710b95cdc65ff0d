import hashlib
import itertools
import json
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from purposegraph.functions import text as tx
from purposegraph.functions import vectors as vx
from purposegraph.functions import vocab
from purposegraph.operators import concepts, extraction, features, generation, matching, mining, networks, parsing, recommend, scoring, subgraphs, taxonomy
from purposegraph.operators.matching import Pattern
from purposegraph.plans.tables import SENTENCES_SQL, sentences
from purposegraph.sources import files
from purposegraph.sources.shared import Scratch
from tests import plain_events

SENTENCE = {
    "sid": "1", "text": "My army will find your boat.", "tokens": ["My", "army", "will", "find", "your", "boat", "."], "lemmas": ["my", "army", "will", "find", "you", "boat", "."],
    "pos_tags": ["PRP$", "NN", "MD", "VB", "PRP$", "NN", "."], "ners": ["O"] * 7, "mentions": [],
    "dependencies": [(1, "nmod:poss", 0), (3, "nsubj", 1), (3, "aux", 2), (3, "dobj", 5), (3, "punct", 6), (5, "nmod:poss", 4)],
}
FIND = Pattern(("NN", "VB", "NN", "MD"), ((1, "nsubj", 0), (1, "dobj", 2), (1, "aux", 3)))


def brute(labels, edges, p):
    graph = matching._bundles((u, x.split(":")[0], v) for u, x, v in edges)
    into = lambda es, v: sum(e[2] == v for e in es)
    out = []
    for m in permutations(range(len(labels)), len(p.labels)):
        if all((x == "NONE" or (labels[m[i]].startswith(x) if x in ("NN", "RB", "JJ") else labels[m[i]] == x)) and into(edges, m[i]) >= into(p.edges, i) for i, x in enumerate(p.labels)) and all(
            (m[u], m[v]) in graph and (x <= graph[m[u], m[v]] or "NONE" in x) for (u, v), x in matching._bundles(p.edges).items()
        ):
            out.append(m)
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_matcher_equals_brute_force(data):
    label = st.sampled_from(["NN", "NNS", "VB", "NONE"])
    arc = lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.sampled_from(["a", "b:x", "NONE"]), st.integers(0, n - 1)), max_size=6)
    n, k = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 3))
    labels, edges = data.draw(st.lists(label, min_size=n, max_size=n)), data.draw(arc(n))
    p = Pattern(tuple(data.draw(st.lists(label, min_size=k, max_size=k))), tuple(data.draw(arc(k))))
    assert matching.matches(labels, edges, p) == brute(labels, edges, p)


def test_extraction_of_the_documented_sentence(spark):
    got = plain_events.extract_sentence(SENTENCE, [FIND], {})
    assert [" ".join(e.words) for e in got] == ["my army will find you boat"]
    e = got[0]
    rendered = [[[g, e.words[g], e.pos_tags[g]], r, [d, e.words[d], e.pos_tags[d]]] for g, r, d in e.dependencies]
    assert e.eid == hashlib.sha1(json.dumps([rendered, e.words, e.pos_tags]).encode()).hexdigest()
    row = dict(SENTENCE) | {"dependencies": [{"gov": g, "rel": r, "dep": d} for g, r, d in SENTENCE["dependencies"]]}
    df = spark.createDataFrame([row, row | {"sid": "2"}], parsing.PARSED)
    merged = extraction.merge(extraction.extract(df, [FIND])).collect()
    assert [(r["eid"], r["frequency"], r["sentences"]) for r in merged] == [(e.eid, 2.0, 2)]
    assert extraction.extract(df, [FIND], skip_words=("boat",)).count() == 0


def test_eid_does_not_depend_on_dependency_order():
    ids = set()
    for seed in range(5):
        s = dict(SENTENCE)
        s["dependencies"] = random.Random(seed).sample(SENTENCE["dependencies"], 6)
        ids |= {e.eid for e in plain_events.extract_sentence(s, [FIND], {})}
    assert len(ids) == 1


def test_dependency_helpers():
    deps = [(8, "cop", 7), (8, "nsubj", 6)]
    assert plain_events.sorted_dependencies(deps) == ([(2, "nsubj", 0), (2, "cop", 1)], {6: 0, 7: 1, 8: 2}, {0: 6, 1: 7, 2: 8})
    assert plain_events.indices(deps) == [6, 7, 8]
    assert plain_events.segments(4, [(2, "compound", 1), (2, "compound", 0), (3, "x", 2)]) == [(2, 0, 1), (3,)]
    assert plain_events.segments(4, [(3, "compound", 0)]) == [(0,), (1,), (2,), (3,)]
    assert plain_events.segments(6, [(1, "compound", 0), (2, "compound:prt", 1), (5, "compound", 4), (5, "compound", 2)]) == [(2, 0, 1), (3,), (5, 4)]


def test_predicates(spark):
    assert matching.prefix_ok([4, 2, 3, 9], 3) and not matching.prefix_ok([4, 2, 3, 9], 4)
    r = spark.range(1).select(
        matching.prefix_holds(F.array(*map(F.lit, [4, 2, 3, 9])), 3).alias("a"), matching.prefix_holds(F.array(*map(F.lit, [4, 2, 3, 9])), 4).alias("b"),
        matching.within_clause(F.array(F.lit(1), F.lit(4)), F.array(F.lit(4))).alias("c"), matching.within_clause(F.array(F.lit(1), F.lit(4)), F.array(F.lit(5))).alias("d"),
    ).first()
    assert tuple(r) == (True, False, False, True)
    assert not matching.must_ok([0, 1], [(1, "IN", 2)]) and matching.must_ok([0, 1], [(1, "x", 2)])
    assert matching.connected(Pattern(("NN", "VB"), ((1, "x", 0),))) and not matching.connected(Pattern(("NN", "CC"), ((1, "x", 0),)))


def test_mining(spark):
    assert mining.leftmost([(0, 0), (3, 2), (5, 3)], 4) == (5, 3) == mining.leftmost([(0, 0), (3, 2), (5, 3)], 9)
    p, q = Pattern(("NN", "VB"), ((1, "x", 0),), 3), Pattern(("VB", "NN"), ((0, "x", 1),), 4)
    assert [k.freq for k in matching.without_isomorphs([p, q])] == [7]
    assert mining.skeleton(Pattern(("DT", "NN", "VB"), ((1, "det", 0), (2, "nsubj", 1)))) == p.__class__(("NN", "VB"), ((1, "nsubj", 0),))
    found = spark.createDataFrame([("a", 0, [0]), ("a", 1, [0]), ("b", 1, [0]), ("c", 1, [0])], "sid string, pattern_id int, mapping array<int>")
    assert [tuple(r) for r in mining.first_match(found, 4, 0.5).collect()] == [(1, 3)]
    assert [tuple(r) for r in mining.first_match(found, 4, 0.5, bound=0).collect()] == [(1, 3)]


def test_pattern_files_round_trip(spark, tmp_path):
    ps = [Pattern(("NN", "VB"), ((1, "nsubj", 0),), 5), Pattern(("NN",), (), 9)]
    files.write_patterns(spark, ps, str(tmp_path / "p"))
    assert sorted(files.read_patterns(spark, str(tmp_path / "p")), key=lambda p: p.freq) == ps
    assert files.parse_patterns("t # 2\nv 0 NNS\nv 1 ,\nv 2 VB\ne 2 0 nsubj:pass\ne 2 1 punct\n", fuzzy=True) == [Pattern(("NN", "VB"), ((1, "nsubj", 0),), 2)]


def test_likelihood_and_chain(spark):
    t = spark.createDataFrame([("fruit", "apple", 6), ("company", "apple", 4), ("fruit", "pear", 2), ("food", "fruit", 1)], "concept string, instance string, freq int")
    got = {(r["concept"], r["instance"]): r["score"] for r in taxonomy.with_scores(t).collect()}
    assert got["fruit", "apple"] == pytest.approx(0.6) and got["company", "apple"] == pytest.approx(0.4)
    pmi = {(r["concept"], r["instance"]): r["score"] for r in taxonomy.with_scores(t, "pmi").collect()}
    assert pmi["fruit", "apple"] == pytest.approx(0.075)
    with pytest.raises(NotImplementedError):
        taxonomy.with_scores(t, "other")
    up = taxonomy.chains(t, spark.createDataFrame([("apple",)], "instance string"))
    assert sorted((r["depth"], r["concept"]) for r in up.collect()) == [(0, "apple"), (1, "fruit"), (2, "food")]
    # a concept is the first of the five, no concept without one has a chain, and cycles end at the length
    loop = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("a", "x", 1)], "concept string, instance string, freq int")
    rows = taxonomy.chains(loop, spark.createDataFrame([("a",), ("x",), ("none",)], "instance string")).collect()
    chain = lambda i: "".join(r["concept"] for r in sorted(rows, key=lambda r: r["depth"]) if r["instance"] == i)
    assert (chain("a"), chain("x"), chain("none")) == ("ababa", "xababa", "")


def test_seed_rule(spark):
    words, ners = ["he", "saw", "she", "he"], ["O"] * 4
    want = ["__PERSON__0", "saw", "__PERSON__1", "__PERSON__0"]
    row = spark.createDataFrame([(words, ners)], "w array<string>, n array<string>").select(concepts.seeded(F.col("w"), F.col("n"))).first()[0]
    assert row == want


def test_conceptualize(spark):
    t = spark.createDataFrame([("fruit", "apple", 3), ("big firm", "apple", 1), ("food", "apple pie", 1)], "concept string, instance string, freq int")
    cols = "eid string, words array<string>, ners array<string>, pos_tags array<string>, phrases array<string>, phrase_ners array<string>, phrase_tags array<string>"
    e = [("1", ["eat", "apple", "pie"], ["O"] * 3, ["VB", "NN", "NN"], ["eat", "apple pie"], ["O"] * 2, ["VB", "NN"]), ("2", ["go"], ["O"], ["VB"], ["go"], ["O"], ["VB"])]
    got = {(r["eid"], r["concept"]): r["score"] for r in concepts.conceptualize(spark.createDataFrame(e, cols), t, 2).collect()}
    assert got == {("1", "eat food"): 1.0, ("1", "eat fruit pie"): 0.75, ("1", "eat big-firm pie"): 0.25, ("2", "go"): 1.0}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.cleaned(F.lit(" é see http://a.b/c https://d.e <ref name=x> "))) == "see <url> <url> <ref>"
    cases = {
        "\n\tsee example.com/x, (www.a.co.uk) \n": "see <url>, (<url>)", "<url>[](<url> <url>": "<url> <url>", "jo@example.com or ex.org@x": "jo@example.com or ex.org@x", "at 3.14 v1.2.3 e.g. that": "at 3.14 v1.2.3 e.g. that",
        "<ref a\nb> <ref c>": "<ref a\nb> <ref>", "http://x.y/(a)b.": "<url>(a)b.",
    }
    for text, want in cases.items():
        assert one(tx.cleaned(F.lit(text))) == want
    assert one(tx.from_template(F.lit("x they both have y"), F.lit("they both have"))) == "they both have y"
    assert one(tx.from_template(F.lit("x because y"), F.lit(""))) == "y"
    assert one(tx.from_template(F.lit("x"), F.lit("they"))) is None
    assert one(tx.index_from(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.lit("a"), F.lit(1))) == 2
    assert one(tx.prompt_key(F.lit("1"), F.lit(None).cast("string"), F.lit("isA"))) == hashlib.md5(b"1-isA").hexdigest()
    assert one(F.size(tx.sentences(F.lit("a b. c d. " * 20), 50))) == 40
    assert one(vx.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]
    assert one(tx.relation_of(F.lit("12-isA-34|5"))) == "isA"
    assert len(vocab.RELATIONS) == 21


def test_generation_annotation_and_features(spark):
    items = spark.createDataFrame([(1, "red pen", "Office"), (2, "cup", "Home")], "asin long, title string, top_cate string")
    pairs = generation.with_items(spark.createDataFrame([(1, 2), (1, 3)], "item_a long, item_b long"), items)
    prompts = generation.pair_prompts(pairs, vocab.relations(spark))
    assert prompts.count() == 21
    assert prompts.where("rel = 'open'").first()["text"] == 'He bought a product of "red pen" and a product of "cup" because'
    assert generation.generate(prompts).first()["output"][0].endswith("it is useful.")
    parsed = parsing.annotate(spark.createDataFrame([("1", "The man found a boat."), ("2", "")], "sid string, text string")).orderBy("sid").collect()
    assert parsed[0]["pos_tags"][0] == "DT" and parsed[1]["tokens"] == ["."]
    vec = features.text_vectors(spark.createDataFrame([("a b",), ("a b",), (None,)], "t string"), "t", 8)
    assert sorted(len(r["features"]) for r in vec.collect()) == [8, 8]
    trained = features.train_translation(spark.createDataFrame([("x", 0, 0, 1), ("x", 1, 0, 2)], "g string, h int, r int, t int"), 3, 1, "g", size=4, epochs=5)
    assert trained.count() == 4


def test_scoring_and_recommendation(spark):
    s = spark.createDataFrame([("v", 0.9), ("i", 0.8), ("v", 0.4)], "label string, score double")
    half = {r["threshold"]: r for r in scoring.metrics(s).collect()}[0.5]
    assert (half["tp"], half["fp"], half["fn"], half["tn"], half["precision"]) == (1, 1, 1, 0, 0.5)
    p = spark.createDataFrame([(1.0, 0.0), (5.0, 4.0), (3.0, 1.0)], "prediction double, rating double")
    assert recommend.rmse(p).first()[0] == pytest.approx((5 / 2) ** 0.5)
    labelled = spark.createDataFrame([("good thing", "v"), ("bad thing", "i")] * 10, "assertion string, label string")
    model = scoring.train_scorer(labelled, 64, 10)
    assert {r["assertion"]: r["prediction"] for r in scoring.predict(model, labelled).collect()} == {"good thing": "v", "bad thing": "i"}


def test_cached_table_and_stream(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert files.stored(spark, str(tmp_path / "t"), make).count() == files.stored(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1
    from purposegraph.streaming import stages

    spark.createDataFrame([("1", "A boat.")], files.RAW).write.json(str(tmp_path / "s"))
    q = stages.annotated(stages.json_stream(spark, str(tmp_path / "s"), files.RAW)).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("parsed").count() == 1


def permuted(labels, edges):
    """The smallest renumbering, by trying all."""
    forms = []
    for order in permutations(range(len(labels))):
        at = {x: i for i, x in enumerate(order)}
        forms.append((tuple(labels[x] for x in order), tuple(sorted((at[u], e, at[v]) for u, e, v in edges))))
    return min(forms)


def parts(labels, edges, k):
    """Forms of the connected sub-graphs of k vertices with as many edges or one fewer, by trying all choices of edges."""
    real, forms = sorted({e for e in edges if e[0] != e[2]}), set()
    for m in (k - 1, k):
        for g in itertools.combinations(real, m):
            span = sorted({x for u, _, v in g for x in (u, v)})
            reach = set(span[:1])
            for _ in span:
                reach |= {x for u, _, v in g if u in reach or v in reach for x in (u, v)}
            if len(span) == k and len(reach) == k:
                at = {x: i for i, x in enumerate(span)}
                forms.add(permuted(tuple(labels[x] for x in span), tuple(sorted((at[u], e, at[v]) for u, e, v in g))))
    return forms


GRAPHS = "labels array<string>, edges array<struct<u:int,label:string,v:int>>, weight long"


def test_frequent_subgraphs_equal_all_choices_of_edges(spark):
    """Trees, chains, equal leaves, circles, parallel edges and loops, several components, equal graphs."""
    draw, rows = random.Random(7), []
    for _ in range(40):
        n = draw.randint(2, 9)
        tree = [(draw.randrange(i), i) for i in range(1, n)]
        more = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.choice([0, 0, 1, 2]))]
        edges = {(a, draw.choice("ab"), b) if draw.random() < 0.6 else (b, draw.choice("ab"), a) for a, b in tree + more if draw.random() < 0.95}
        rows.append((draw.choices("XY", k=n), sorted(edges), draw.randint(1, 3)))
    rows += [(["X"] * 8, [(0, "a", i) for i in range(1, 8)], 2), (["X"] * 6, [(i, "a", (i + 1) % 6) for i in range(6)], 1), (["X", "Y"], [(0, "a", 1), (0, "b", 1), (1, "a", 0), (1, "a", 1)], 3), (["X"], [], 5)]
    rows += rows[:5]
    bounds, want = [(2, 1, 999), (3, 4, 60), (4, 2, 50), (5, 3, 99)], {}
    for labels, edges, weight in rows:
        for k, _, _ in bounds:
            for f in parts(labels, edges, k):
                want[f] = want.get(f, 0) + weight
    limits = {k: (least, most) for k, least, most in bounds}
    want = {f: n for f, n in want.items() if limits[len(f[0])][0] <= n <= limits[len(f[0])][1]}
    found = subgraphs.frequent(spark.createDataFrame(rows, GRAPHS).repartition(3), bounds).collect()
    got = {permuted(tuple(r["labels"]), tuple((e["u"], e["label"], e["v"]) for e in r["edges"])): r["freq"] for r in found}
    assert len(got) == len(found) and got == want and {len(f[0]) for f in want} == {2, 3, 4, 5}


def test_a_star_of_equal_leaves_has_one_embedding_for_each_size(spark, monkeypatch):
    star = spark.createDataFrame([(["V"] + ["N"] * 12, [(0, "x", i) for i in range(1, 13)], 1)], GRAPHS)
    sizes, table = [], Scratch.table

    def noted(self, df):
        out = table(self, df)
        if "code" in out.columns:
            sizes.append(out.agg(F.sum(F.size("code"))).first()[0])
        return out

    monkeypatch.setattr(Scratch, "table", noted)
    assert subgraphs.frequent(star, [(k, 1, 9) for k in range(2, 14)]).count() == 12
    assert set(sizes[:-1]) == {1}
    assert subgraphs.frequent(star.limit(0), [(3, 1, 9)]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_smallest_codes_are_equal_for_renumbered_graphs_only(data):
    n = data.draw(st.integers(2, 6))
    labels = data.draw(st.lists(st.integers(0, 1), min_size=n, max_size=n))
    edges = [(data.draw(st.integers(0, i - 1)), data.draw(st.integers(0, 1)), i) for i in range(1, n)]
    edges = [e if data.draw(st.booleans()) else (e[2], e[1], e[0]) for e in edges]
    order = data.draw(st.permutations(range(n)))
    other = [(order[u], e, order[v]) for u, e, v in edges]
    moved = tuple(labels[order.index(i)] for i in range(n))
    code = subgraphs.smallest(tuple(labels), edges)
    assert code == subgraphs.smallest(moved, other) and subgraphs.minimal(code)
    assert permuted(code.labels, code.arcs()) == permuted(tuple(labels), edges)


def test_frequent_edges_equal_sql(spark, sf):
    sql = f"WITH {SENTENCES_SQL} SELECT a.label AS g, e.label AS e, b.label AS d, count(DISTINCT e.sid) AS n FROM edges e JOIN nodes a ON a.sid = e.sid AND a.v = e.u JOIN nodes b ON b.sid = e.sid AND b.v = e.v GROUP BY 1, 2, 3 HAVING n >= 10"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = mining.frequent(mining.graphs(sentences(spark, sf)), 2, 10, 1 << 40).collect()
    assert {(r["labels"][r["edges"][0]["u"]], r["edges"][0]["label"], r["labels"][r["edges"][0]["v"]], r["freq"]) for r in got if len(r["edges"]) == 1} == set(db.execute(sql).fetchall())


def test_distinct_events_are_those_whose_skeletons_lie_in_no_other():
    def event(word, *places):
        n = len(places)
        return plain_events.Eventuality([word] * n, ["NN"] * n, ["O"] * n, [], list(range(n)), [], list(places))

    events = [event("a", 1, 2), event("b", 1, 2, 3), event("c", 1, 2, 3), event("d", 4, 5), event("d", 6, 7), event("e", 3, 4)]
    assert plain_events.distinct(events) == [events[1], events[3], events[5]]


def test_separators_go_by_tags(spark):
    df = spark.createDataFrame([(["DT", "WP$", "NN", ".", ":", "WRB", "CC"],)], "tags array<string>")
    assert df.select(matching.separators(F.col("tags"))).first()[0] == [1, 3, 5]


def test_item_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\tone\tBooks | New\tOld\n y\ttwo \n")
    rows = {r["asin"]: r for r in files.item_meta_tsv(spark, str(tmp_path)).collect()}
    assert (rows["x"]["cate"], rows["x"]["top_cate"]) == (["Books | New", "Old"], "Books ") and (rows["y"]["title"], rows["y"]["cate"]) == ("two", [])


@pytest.mark.parametrize(("hidden", "wide"), [((5, 3), True), ((), False), ((4,), False)])
def test_network_gradients_equal_differences(hidden, wide):
    draw = np.random.default_rng(3)
    net = networks.Network(networks.Shape(6, 5, 4, 2, hidden, wide), draw.standard_normal((5, 2)))
    users, items, ratings = draw.integers(0, 6, 9), draw.integers(0, 5, 9), draw.standard_normal(9)
    _, g = net.gradients(users, items, ratings, train=False)
    for name, p in net.p.items():
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in p.shape)
            kept = p[at]
            p[at] = kept + 1e-6
            up = net.gradients(users, items, ratings, train=False)[0]
            p[at] = kept - 1e-6
            down = net.gradients(users, items, ratings, train=False)[0]
            p[at] = kept
            assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_networks_learn_ratings(spark):
    draw = np.random.default_rng(1)
    u, v = draw.standard_normal((30, 2)), draw.standard_normal((20, 2))
    rows = [(int(a), int(b), float(3 + u[a] @ v[b])) for a in range(30) for b in range(20)]
    df = spark.createDataFrame(rows, "user int, item int, rating double")
    valid = df.where("(user + item) % 7 = 0")
    train = df.where("(user + item) % 7 > 0")
    for kind in (recommend.train_wide_deep, recommend.train_collaborative):
        got = kind(train, valid, valid, 30, 20, size=4, hidden=(16,), steps=600, batch=64, every=300, runs=2, rate=0.01).collect()
        assert sorted((r["run"], r["step"]) for r in got) == [(0, 300), (0, 600), (1, 300), (1, 600)]
        flat = np.std([r[2] for r in rows])
        assert all(r["valid"] == r["test"] for r in got) and max(r["valid"] for r in got if r["step"] == 600) < 0.7 * flat


def test_translation_of_pairs_to_texts_learns(spark):
    draw = np.random.default_rng(2)
    e = draw.standard_normal((12, 6))
    rows = [("g", int(a), 0, int(b), [float(x) for x in (e[a] + e[b]) / 4]) for a in range(12) for b in range(12) if a != b]
    df = spark.createDataFrame(rows, "g string, h int, r int, second int, text array<double>")
    loss = lambda n: features.train_translation(df, 12, 1, "g", size=6, epochs=n, batch=16).first()["loss"]
    assert loss(60) < loss(1)


def test_events_survive_serialisation(spark):
    e = plain_events.Eventuality(["i", "be", "sure"], ["PRP", "VBP", "JJ"], ["O", "O", "DATE"], [(2, "nsubj", 0), (2, "cop", 1)], [0, 1, 2], [0, 1], [4, 5, 7], "PRP VBP JJ", [{"start": 2, "end": 3, "text": "sure", "ner": "DATE"}], 2.0)
    assert (len(e), str(e)) == (3, "i be sure")
    for small in (False, True):
        assert plain_events.Eventuality.decoded(e.encoded(small)) == e and plain_events.Eventuality.decoded(e.encoded(small)).eid == e.eid
    assert "eid" in e.to_dict() and "eid" not in e.to_dict(minimum=True)
    rows = spark.createDataFrame([e.row() | {"sid": "s"}], "sid string, " + extraction.SCHEMA)
    back = extraction.deserialised(extraction.serialised(rows))
    assert [r.asDict(True) for r in back.collect()] == [r.asDict(True) for r in rows.drop("sid").collect()]
    found = extraction.resolved(spark.createDataFrame([(e.eid,), ("none",)], "eid string"), rows)
    assert [r["eid"] for r in found.collect()] == [e.eid]


def test_merged_events_have_the_commonest_entity_types_and_all_mentions(spark):
    def event(sid, ners, mention):
        m = [{"start": 0, "end": 1, "text": mention, "ner": ners[0]}] if mention else []
        return plain_events.Eventuality(["x", "go"], ["NN", "VB"], ners, [(1, "nsubj", 0)], [0, 1], [0], [0, 1], "p", m).row() | {"sid": sid}

    rows = spark.createDataFrame([event("a", ["CITY", "O"], "x"), event("b", ["CITY", "O"], "y"), event("c", ["O", "O"], None), event("d", ["PERSON", "O"], "x")], "sid string, " + extraction.SCHEMA)
    r = extraction.merge_all(rows).first()
    assert (r["frequency"], r["sentences"], r["ners"], [m["text"] for m in r["mentions"]]) == (4.0, 4, ["CITY", "O"], ["x", "x", "y"])


def test_batch_matcher_counts_and_keeps_events(spark):
    big = Pattern(("NN", "VB", "NN"), ((1, "nsubj", 0), (1, "dobj", 2)))
    small, other = Pattern(("NN", "VB"), ((1, "nsubj", 0),)), Pattern(("IN", "VB"), ((1, "prep", 0),))
    rows = [
        ("a", ["NN", "VB", "NN", "IN"], [(1, "nsubj", 0), (1, "dobj", 2), (1, "prep", 3)]),  # the largest pattern holds, and so counts for its child
        ("b", ["NN", ";", "VB", "IN"], [(2, "nsubj", 0), (2, "prep", 3)]),  # the subject lies beyond a separator: its event stays, the next pattern counts
        ("c", ["NN", "NN", "VB"], [(2, "nsubj", 0), (2, "nsubj", 1)]),
    ]
    df = spark.createDataFrame([(s, [f"w{i}" for i in range(len(t))], t, d) for s, t, d in rows], "sid string, lemmas array<string>, pos_tags array<string>, dependencies array<struct<gov:int,rel:string,dep:int>>")
    found = extraction.batch_match(df, [small, other, big])
    patterns = matching.ordered([small, other, big])
    counts = {patterns[r["pattern_id"]]: r["matches"] for r in extraction.batch_counts(found).collect()}
    assert counts == {big: 1, small: 3, other: 1}
    words = sorted((r["sid"], " ".join(r["words"])) for r in extraction.batch_events(found).collect())
    assert words == [("a", "w0 w1 w2"), ("b", "w0 w2"), ("b", "w2 w3"), ("c", "w0 w2"), ("c", "w1 w2")]


def test_extraction_from_texts_in_both_orders(spark):
    texts = spark.createDataFrame([("s", "the dog is running and the cat is eating")], "sid string, text string")
    patterns = [Pattern(("NN", "VBG"), ((1, "nsubj", 0),)), Pattern(("DT", "NN"), ((1, "det", 0),))]
    parsed = parsing.annotate(texts)
    events = extraction.from_texts(texts, patterns)
    assert {r["eid"] for r in events.collect()} == {r["eid"] for r in extraction.extract(parsed, patterns).collect()}
    by_eid = [r["eid"] for r in extraction.numbered(events, "eid").sort("place").collect()]
    by_place = [sum(r["raw_places"]) / len(r["raw_places"]) for r in extraction.numbered(events, "position").sort("place").collect()]
    assert by_eid == sorted(by_eid) and by_place == sorted(by_place)
    with pytest.raises(NotImplementedError):
        extraction.numbered(events, "other")


def test_mining_from_lengths_to_claims(spark):
    def parsed(i, tags, words):
        deps = [(k, "next", k + 1) for k in range(len(tags) - 1)]
        return (f"s{i}", words, " ".join(words), tags, deps)

    rows = [parsed(i, ["DT", "NN", "VB", "JJ", "RB"], ["the", "dog", "runs", "so", f"w{i}"]) for i in range(60)]
    rows += [parsed(60 + i, ["DT", "NN", "VB", "TO", "VB"], ["the", "cat", "likes", "to", f"x{i}"]) for i in range(60)]
    rows += [parsed(120 + i, ["PRP", "MD", "PRP", "MD"][: 1 + i % 4], ["it", "may", "it", "may"][: 1 + i % 4]) for i in range(100)]
    df = spark.createDataFrame(rows, "sid string, tokens array<string>, text string, pos_tags array<string>, dependencies array<struct<gov:int,rel:string,dep:int>>")
    patterns, claims = mining.mine(df, ["the"])
    assert all("DT" in p.labels for p in patterns) and len({len(p.labels) for p in patterns}) > 1
    got = {patterns[r["pattern_id"]].labels: (r["n"], r["text"][:4]) for r in claims.collect()}
    # sentences of the second kind have an edge from the verb to "to", so they count for what ends before it
    assert got == {("DT", "NN", "VB"): (60, "the "), ("DT", "NN"): (60, "the ")}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_edge_seeds_keep_the_matches_that_lie_on_them(data):
    def graph(n):
        labels = data.draw(st.lists(st.sampled_from("AB"), min_size=n, max_size=n))
        edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.sampled_from(["x", "y"]), st.integers(0, n - 1)), min_size=1, max_size=6, unique=True))
        return labels, edges

    labels, edges = graph(4)
    small, wanted = graph(2)
    pattern = Pattern(tuple(small), tuple(wanted))
    every = matching.matches(labels, edges, pattern)
    at = data.draw(st.integers(0, len(wanted) - 1))
    on = data.draw(st.integers(0, len(edges) - 1))

    def laid(m):
        return [(m[u], x, m[v]) for u, x, v in wanted]

    assert matching.matches_at_edge(labels, edges, pattern) == every
    assert matching.matches_at_edge(labels, edges, pattern, on) == [m for m in every if edges[on] in laid(m)]
    assert matching.matches_at_edge(labels, edges, pattern, None, at) == every
    assert matching.matches_at_edge(labels, edges, pattern, on, at) == [m for m in every if laid(m)[at] == edges[on]]


def test_metrics_and_concepts_go_to_files(spark, tmp_path):
    best = spark.createDataFrame([(2, 5, 1.0, 4.0), (0, 1, 1.0, 1.0), (1, 3, 1.0, 1.0)], "run int, step int, valid double, test double")
    files.write_metrics(best, f"{tmp_path}/metrics")
    row = spark.read.json(f"{tmp_path}/metrics").first()
    assert row["results"] == [1.0, 1.0, 4.0] and row["mean"] == 2.0 and row["std"] == pytest.approx(2**0.5)
    taxonomy = spark.createDataFrame([("animal", "dog", 3), ("pet", "dog", 1)], "concept string, instance string, freq int")
    events = spark.createDataFrame([("e", ["dog", "run"], ["O", "O"], ["NN", "VB"], ["dog", "run"], ["O", "O"], ["NN", "VB"])], files.EVENTS)
    files.write_json(events, f"{tmp_path}/events")
    files.conceptualize_file(spark, f"{tmp_path}/events", f"{tmp_path}/concepts", taxonomy)
    straight = concepts.conceptualize(events, taxonomy)
    assert sorted(map(tuple, spark.read.schema(straight.schema).json(f"{tmp_path}/concepts").collect())) == sorted(map(tuple, straight.collect())) != []


def test_prompts_meet_the_cache_as_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, "x", "y"), (1, 3, "x", "z"), (2, 3, "y", "z")], "item_a long, item_b long, title_a string, title_b string")
    rel = vocab.relations(spark)
    prompts = generation.pair_prompts(pairs, rel)
    cache = prompts.where("rel = 'isA' OR asin_b = '3' AND asin_a = '2' OR rel = 'can' AND asin_a = '1' AND asin_b = '3'")
    got = generation.missing_prompts(pairs, rel, cache)
    assert sorted(got.collect()) == sorted(generation.not_cached(prompts, cache).select(got.columns).collect())
    assert got.count() == 20 + 19


def test_cached_prompts_are_not_shuffled(spark, sf):
    from purposegraph.plans import generation as plans

    assert "hashpartitioning(key" not in plans.prompt_anti_cache(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_pairs_in_tasks_that_follow_the_input(spark, sf, monkeypatch):
    from purposegraph.plans import tables

    want = tables.pairs(spark, sf).collect()
    monkeypatch.setattr(generation, "PART_BYTES", 4 << 10)
    got = tables.pairs(spark, sf)
    assert got.rdd.getNumPartitions() > 8  # the session has 4 shuffle partitions
    assert sorted(got.collect()) == sorted(want)


def test_pairs_of_wanted_items(spark):
    lines = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 9), (3, 1), (None, 1), (None, 2), (4, None), (4, 1)], "basket int, item int")
    wanted = spark.createDataFrame([(1, True), (2, False), (3, None), (3, False), (4, False), (4, True)], "asin int, wanted boolean")  # 9 is unknown, 4 has two rows
    assert sorted(map(tuple, generation.pairs(lines, wanted).collect())) == [(1, 2), (1, 3), (3, 4)]
    assert sorted(map(tuple, generation.pairs(lines).collect())) == [(1, 2), (1, 3), (1, 9), (2, 3), (3, 4)]


def test_models_carry_what_batches_touched():
    shape = networks.Shape(10_000, 10_000, 8, 0, (4,), True)
    net, draw = networks.Network(shape, seed=3), np.random.default_rng(0)
    whole = {k: (v.copy(), np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, 4):
        users, items, ratings = draw.integers(0, 50, 16), draw.integers(9_000, 9_040, 16), draw.standard_normal(16)
        g = net.gradients(users, items, ratings)[1]
        net.step(users, items, ratings)
        for k, (v, m, s) in whole.items():  # Adam over all rows
            m += 0.1 * (g[k] - m)
            s += 0.001 * (g[k] * g[k] - s)
            v -= net.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    assert all(np.array_equal(net.p[k], whole[k][0]) for k in whole)
    data = net.packed()
    assert len(data) < 20_000
    again = networks.Network(shape, seed=3).load(data)
    assert all(np.array_equal(again.p[k], net.p[k]) for k in net.p)


def test_translation_normalises_what_has_changed():
    model, sizes = features.Translation(5_000, 2, 4), []
    whole = model.renormalise
    model.renormalise = lambda rows=slice(None): sizes.append(len(model.e[rows])) or whole(rows)
    draw = np.random.default_rng(0)
    for _ in range(3):
        model.step(draw.integers(0, 5_000, 8), draw.integers(0, 2, 8), draw.integers(0, 5_000, 8))
    assert sizes[0] == 5_000 and max(sizes[1:]) <= 32


def test_sentences_take_calls_by_batch_not_by_word(spark, sf, monkeypatch):
    import cProfile
    import pstats

    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    held = []
    monkeypatch.setattr(Classic, "mapInArrow", lambda self, f, schema: held.append(f))
    sentences(spark, sf)
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))

    def calls(n):
        batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([" ".join(map(word, range(n)))])], names=["sid", "s"])
        with cProfile.Profile() as p:
            out = list(held[0](iter([batch])))
        assert out[0].column(1).to_pylist() == [[word(i) for i in range(n)]]
        return pstats.Stats(p).total_calls

    assert calls(4_000) < calls(1_000) + 100
