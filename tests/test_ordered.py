import hashlib
from itertools import combinations, product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from purposegraph.operators import concepts, generation, ordered, scoring, taxonomy
from purposegraph.operators.matching import Pattern
from purposegraph.sources import files
from purposegraph.sources.key_cache import KeyCache

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


# ---- samples

def test_sample_equals_the_sorted_rows(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("a.b"))
    want = sorted((str(i) for i in range(3000)), key=lambda k: md5(f"7-{k}"))
    for n in (0, 1, 17, 1500, 2999, 3000, 5000):
        got = generation.sample(df, F.col("key"), n, 7, at_once=-1)
        assert got.columns == ["key", "a.b"]
        assert sorted(r["key"] for r in got.collect()) == sorted(want[:n]), n


def test_sample_where_one_key_holds_most_rows(spark):
    """Rows of one key are told apart as wholes, equal rows count as often as they occur."""
    rows = [("hot", i % 400) for i in range(4000)] + [(f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, x int")
    for n in (1, 150, 2000, 4100):
        got = [(r["key"], r["x"]) for r in generation.sample(df, F.col("key"), n, 1, at_once=0).collect()]
        assert len(got) == n
        rank = lambda r: (md5(f"1-{r[0]}"), md5(f'{{"key":"{r[0]}","x":{r[1]}}}'))
        assert sorted(got, key=rank) == sorted(rows, key=rank)[:n]


def test_sample_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([("a", None)] * 200, "key string, x int")
    assert generation.sample(same, F.col("key"), 130, at_once=0).collect() == [("a", None)] * 130
    assert generation.sample(same.limit(0), F.col("key"), 130, at_once=0).count() == 0


# ---- numbers and slices

def test_numbers_have_no_gaps_and_slices_are_exact(spark):
    rows = [((i * 37) % 1000, i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "x int, number int").repartition(7)
    got = {r["x"]: r["number"] for r in ordered.numbered(df, ["x"]).collect()}
    assert got == {i: i for i in range(1000)}
    cut = lambda i: sorted(r["x"] for r in generation.shard(df, ["x"], i, 300).collect())
    assert [cut(i) for i in range(5)] == [list(range(300)), list(range(300, 600)), list(range(600, 900)), list(range(900, 1000)), []]
    assert ordered.numbered(df.limit(0), ["x"]).count() == 0
    ties = spark.createDataFrame([(None,), (1,), (1,), (1,)], "x int")
    assert sorted((r["number"], r["x"]) for r in ordered.numbered(ties, ["x"]).collect()) == [(0, None), (1, 1), (2, 1), (3, 1)]


def test_dummy_labels_take_turns_whatever_the_partitions(spark):
    df = spark.range(50)
    for parts in (1, 5):
        got = scoring.with_label(df.repartition(parts), ["id"]).orderBy("id").collect()
        assert [r["label"] for r in got] == ["v", "i"] * 25
    assert scoring.with_label(df.withColumn("quality", F.lit("v"))).columns == ["id", "label"]


# ---- curves

@few
@given(st.lists(st.tuples(st.sampled_from("vi"), st.sampled_from([None, float("nan"), float("inf"), -float("inf"), -1e300, -7.5, 0.0, 2.0, 2.5, 1e9])), min_size=1, max_size=40), st.sampled_from([1, 2, 5]))
def test_curve_of_any_scores(spark, rows, ranges):
    got = {r["threshold"]: (r["tp"], r["fp"], r["recall"]) for r in scoring.pr_curve(spark.createDataFrame(rows, "label string, score double"), ranges).collect()}
    known = [(x, s) for x, s in rows if s is not None and s == s]
    every = max(1, sum(x == "v" for x, _ in rows))
    want = {}
    for _, t in known:
        tp, fp = (sum(x == y and s >= t for x, s in known) for y in "vi")
        want[t] = (tp, fp, pytest.approx(tp / every))
    assert got == want


# ---- chains

def plain_chain(best, own, start, length, cycles):
    out, at = [start], start
    while at in best and len(out) <= length - own:
        at = best[at]
        if not cycles and at in out:
            break
        out.append(at)
    return out if own or len(out) > 1 or start in best else []


@few
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefghxy")), min_size=1, max_size=10), st.sampled_from([1, 2, 3, 8, 13]), st.booleans())
def test_long_chains_equal_steps(spark, edges, length, cycles):
    t = spark.createDataFrame([(c, i, 1) for c, i in edges], "concept string, instance string, freq int")
    got = taxonomy.long_chains(t, spark.createDataFrame([(x,) for x in "abhxyz"], "instance string"), length, cycles)
    chains = {}
    for r in sorted(got.collect(), key=lambda r: r["depth"]):
        chains.setdefault(r["instance"], []).append(r["concept"])
    best = {}
    for c, i in edges:
        best[i] = min(c, best.get(i, c))
    own = {c for c, _ in edges}
    want = {x: plain_chain(best, x in own, x, length, cycles) for x in "abhxyz"}
    assert chains == {x: c for x, c in want.items() if c}


def test_long_and_short_chains_agree(spark):
    t = spark.createDataFrame([(f"n{i + 1}", f"n{i}", 1) for i in range(70)], "concept string, instance string, freq int")
    starts = spark.createDataFrame([("n0",), ("n3",), ("n68",), ("n70",)], "instance string")
    assert sorted(taxonomy.long_chains(t, starts, 5).collect()) == sorted(taxonomy.chains(t, starts, 5).collect())
    long = taxonomy.long_chains(t, starts, 64).where("instance = 'n0'")
    assert [r["concept"] for r in long.orderBy("depth").collect()] == [f"n{i}" for i in range(65)]


# ---- products of concepts

def all_ways(words, options, limit):
    out = []
    for n in range(1, len(options) + 1):
        for chosen in combinations(options, n):
            for picks in product(*(options[w] for w in chosen)):
                score, new = 1.0, dict(zip(chosen, picks, strict=True))
                for _, p in picks:
                    score *= p
                out.append((score, [new[w][0] if w in new else w for w in words]))
    return sorted(out, reverse=True)[:limit]


def ways_of(spark, words, options, limit):
    kind = "ws array<string>, xs array<struct<w:string,cs:array<struct<s:double,c:string>>>>"
    rows = [(words, [(w, [(s, c) for c, s in cs]) for w, cs in options.items()])]
    row = spark.createDataFrame(rows, kind).select(concepts.replacements(F.col("ws"), F.col("xs"), limit).alias("r")).first()["r"]
    return [(r["s"], r["w"]) for r in row]


@few
@given(st.data())
def test_best_products_equal_enumeration(spark, data):
    words = data.draw(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6))
    some = st.lists(st.tuples(st.sampled_from(["a", "b", "X", "Y", "Z"]), st.sampled_from([0.0, 0.125, 0.25, 0.5, 1.0])), min_size=1, max_size=3, unique_by=lambda x: x[0])
    options = {w: data.draw(some) for w in dict.fromkeys(words) if data.draw(st.booleans())}
    if any(s == 0.0 for cs in options.values() for _, s in cs):  # products of nothing tie with each other: the scores are what is fixed
        for limit in (1, 3, 50):
            assert [s for s, _ in ways_of(spark, words, options, limit)] == [s for s, _ in all_ways(words, options, limit)]
    else:
        for limit in (1, 3, 50):
            assert ways_of(spark, words, options, limit) == all_ways(words, options, limit)


def test_an_event_of_thirty_nouns(spark):
    words = [f"w{i}" for i in range(30)]
    options = {w: [(f"{w}-x", 0.5), (f"{w}-y", 0.25)] for w in words}
    got = ways_of(spark, words, options, 40)
    assert len(got) == 40 and got[29][0] == 0.5 and got[30][0] == 0.25
    assert sorted(w for _, w in got[:30]) == sorted([[f"{x}-x" if x == y else x for x in words] for y in words])


def test_concepts_of_words_and_phrases_with_a_start(spark):
    t = spark.createDataFrame([("fruit", "apple", 3), ("firm", "apple", 1), ("city", "paris", 1)], "concept string, instance string, freq int")
    e = [
        ("1", ["apple", "buys", "apple", "paris"], ["O"] * 3 + ["CITY"], ["NN", "VB", "NN", "NN"], ["apple", "buys", "apple", "paris"], ["O"] * 3 + ["CITY"], ["NN", "VB", "NN", "NN"]),
        ("2", None, None, None, [], None, []),
        ("3", ["apple"], ["O"], ["NN"], ["apple"], ["O"], ["NN"]),
    ]
    got = {(r["eid"], r["concept"], r["score"]) for r in concepts.conceptualize(spark.createDataFrame(e, files.EVENTS), t, 2, start=1).collect()}
    # places of a word are replaced together, those before the start too; the start itself names no word
    assert got == {("1", "fruit buys fruit __CITY__0", 0.75), ("1", "firm buys firm __CITY__0", 0.25), ("2", "", 1.0), ("3", "apple", 1.0)}
    assert concepts.conceptualize(spark.createDataFrame(e, files.EVENTS).limit(0), t).count() == 0


# ---- key cache

def keys(spark, *names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def test_key_cache_is_appended_to_and_opened_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = KeyCache(spark, path, 4)
    cache.add(keys(spark, "a", "b", "b", None), 0)
    cache.add(keys(spark, "b", "c"), 1)
    assert sorted((r["key"], r["batch"]) for r in cache.keys().collect()) == [("a", 0), ("b", 0), ("c", 1)]
    cache.close()
    again = KeyCache(spark, path, 99)  # the stored number of buckets holds
    assert again.buckets == 4
    left = lambda c, **k: sorted(str(r["key"]) for r in c.missing(keys(spark, "a", "c", "d", None), **k).collect())
    assert left(again) == ["None", "d"]
    assert left(again, batch=1) == ["None", "c", "d"]  # a batch that is run again
    again.compact(8)
    assert (again.buckets, left(again)) == (8, ["None", "d"])
    again.add(keys(spark, "d"))
    again.close()
    assert left(KeyCache(spark, path)) == ["None"]
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 1


def test_only_prompts_are_shuffled_against_stored_keys(spark, tmp_path):
    cache = KeyCache(spark, str(tmp_path / "cache"), 4)
    cache.add(spark.range(500).select(F.col("id").cast("string").alias("key")))
    plan = cache.missing(spark.range(100).select(F.md5(F.col("id").cast("string")).alias("key")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    cache.close()


def test_a_stream_answers_keys_once_across_restarts(spark, tmp_path):
    from purposegraph.streaming import stages

    cache, seen = KeyCache(spark, str(tmp_path / "cache"), 2), []
    write = lambda df, i: seen.extend(r["key"] for r in df.collect())

    def run():
        stream = stages.json_stream(spark, str(tmp_path / "in"), "key string")
        stages.once_ever(stream, cache, write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    keys(spark, "a", "b", "a").write.json(str(tmp_path / "in"))
    run()
    keys(spark, "b", "c").write.mode("append").json(str(tmp_path / "in"))
    run()
    assert sorted(seen) == ["a", "b", "c"]
    cache.close()


# ---- pattern files as tables

def test_pattern_tables_follow_the_text_form(spark, tmp_path):
    text = "t # 12\nv 0 NNS\nv 2 VB\nv 3 .\ne 2 0 nsubj:x\ne 2 3 punct\nt # 5\nv 0 .\nt # 3\nv 0 JJR\n"
    for name, body in (("a.txt", text), ("b.txt", ""), ("c.txt", "t # 7\nv 0 VB\nv 1 NN\ne 0 1 dobj")):
        (tmp_path / name).write_text(body)
    for fuzzy in (False, True):
        rows = files.pattern_table(spark, str(tmp_path), fuzzy).collect()
        got = sorted((tuple(r["labels"]), tuple(tuple(e) for e in r["edges"]), r["freq"]) for r in rows)
        want = sorted((p.labels, p.edges, p.freq) for p in files.read_patterns(spark, str(tmp_path), fuzzy))
        assert got == want and len(got) == 3
    table = files.pattern_table(spark, str(tmp_path))
    files.write_pattern_table(table, str(tmp_path / "out"))
    again = files.pattern_table(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    assert files.read_patterns(spark, str(tmp_path / "out"))[0] == Pattern(("NNS", "VB"), ((1, "nsubj", 0),), 12)


def test_stored_paths_are_few_and_never_broadcast(spark, monkeypatch):
    from purposegraph.sources.shared import Scratch

    made = []
    monkeypatch.setattr(Scratch, "table", lambda self, df, f=Scratch.table: made.append((f(self, df), df)) or made[-1][0])
    edges = [(f"s{i % 3}", f"p{i}", 5) for i in range(60)] + [(f"p{i}", f"s{i}", 5) for i in range(3)]
    t = spark.createDataFrame(edges, "concept string, instance string, freq int")
    starts = t.select("instance").distinct()
    got = taxonomy.long_chains(t, starts, 20)
    stored = [df for df, _ in made if "path" in df.columns]
    assert stored and stored[-1].count() == 6  # three concepts of parts, three parts of concepts; 63 instances
    plans = [df._jdf.queryExecution().executedPlan().toString() for _, df in made if "path" in df.columns]
    assert not any("BroadcastHashJoin" in p for p in plans)
    next_ = {i: c for c, i, _ in edges}
    want = []
    for x in next_:
        at = x
        for depth in range(20 if x in next_.values() else 21):
            want.append((x, depth, at))
            at = next_[at]
    assert sorted(map(tuple, got.collect())) == sorted(want)
