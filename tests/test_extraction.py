"""Events as columns: against the plain version, sentence by sentence."""

import collections
import random

from pyspark.sql import functions as F

from purposegraph.operators import extraction, matching
from purposegraph.operators.matching import Pattern
from tests import plain_events

PARSED = f"sid string, tokens array<string>, lemmas array<string>, pos_tags array<string>, ners array<string>, mentions {extraction.MENTIONS}, dependencies {extraction.DEPS}"
PATTERNS = [
    Pattern(("NN", "VB"), ((1, "nsubj", 0),)), Pattern(("NN", "VB", "NN"), ((1, "nsubj", 0), (1, "dobj", 2))), Pattern(("IN", "NN"), ((1, "case", 0),)),
    Pattern(("NN", "NN"), ((0, "compound", 1),)), Pattern(("VB", "NONE"), ((0, "NONE", 1),)), Pattern(("NN", "VB", "NN", "RB"), ((1, "nsubj", 0), (1, "dobj", 2), (1, "advmod", 3))),
]
WORDS = ["dog", "Cat", 'quo"te', "back\\slash", "naïve", "中", "😀", "tab\t", "x", "y", "\x7f", "new\nline"]


def parsed(draw, n):
    rows = []
    for i in range(n):
        k = draw.randint(2, 9)
        tags = draw.choices(["NN", "NNS", "VB", "RB", "JJ", "DT", "IN", ",", "CC", "PRP$"], k=k)
        arcs = {(draw.randrange(j), draw.choice(["nsubj", "dobj", "case", "compound", "compound:prt", "advmod", "det"]), j) for j in range(1, k)}
        arcs |= {(draw.randrange(k), draw.choice(["compound", "advmod", "nsubj"]), draw.randrange(k)) for _ in range(draw.choice([0, 0, 2]))}
        arcs = [a if draw.random() < 0.7 else (a[2], a[1], a[0]) for a in sorted(arcs)]
        lo = draw.randrange(k)
        mentions = draw.choice([None, [], [{"start": lo, "end": draw.randint(lo + 1, k), "text": "t", "ner": draw.choice(["CITY", None])}]])
        rows.append({"sid": f"s{i}", "tokens": draw.choices(WORDS, k=k), "lemmas": draw.choices(WORDS, k=k), "pos_tags": tags, "ners": draw.choices(["O", "CITY", "DATE"], k=k), "mentions": mentions, "dependencies": arcs})
    return rows


def shape(e):
    return (e["eid"], e["pattern"], tuple(e["words"]), tuple(e["pos_tags"]), tuple(e["ners"]), tuple((d["gov"], d["rel"], d["dep"]) for d in e["dependencies"]), tuple(e["skeleton_indices"]), tuple(e["skeleton_dependency_indices"]),
        tuple(e["verb_indices"]), tuple(e["raw_places"]), tuple(map(tuple, e["segments"])), tuple((m["start"], m["end"], m["text"], m["ner"]) for m in e["mentions"]), e["frequency"])


def descent(known):
    out = {}
    for parent, child in matching.hierarchy(known):
        out.setdefault(parent, set()).add(child)
    return out


def test_extract_equals_the_plain_version(spark):
    rows = parsed(random.Random(11), 250)
    df = spark.createDataFrame([{**r, "dependencies": [{"gov": g, "rel": x, "dep": d} for g, x, d in r["dependencies"]]} for r in rows], PARSED).repartition(3)
    known = matching.ordered(PATTERNS)
    for transitive in (False, True):
        want = collections.Counter((r["sid"], *shape(e.row())) for r in rows for e in plain_events.extract_sentence(r, known, descent(known), transitive))
        got = collections.Counter((r["sid"], *shape(r)) for r in extraction.extract(df, PATTERNS, transitive=transitive).collect())
        assert got == want and sum(want.values()) > 100
    skipped = extraction.extract(df, PATTERNS, skip_words=("dog",)).select("sid").distinct().collect()
    assert {r["sid"] for r in skipped} <= {r["sid"] for r in rows if "dog" not in r["tokens"]}


def test_batch_matches_equal_the_plain_version(spark):
    rows = parsed(random.Random(12), 200)
    df = spark.createDataFrame([{**r, "dependencies": [{"gov": g, "rel": x, "dep": d} for g, x, d in r["dependencies"]]} for r in rows], PARSED).repartition(3)
    known = matching.ordered(PATTERNS)
    want = {}
    for r in rows:
        counts, events = plain_events.batch_sentence(r, known, descent(known))
        if counts or events:
            want[r["sid"]] = (tuple(sorted(counts.items())), tuple(sorted(shape(e.row()) for e in events)))
    found = extraction.batch_match(df, PATTERNS).collect()
    got = {r["sid"]: (tuple(sorted((c["pattern_id"], c["matches"]) for c in r["counts"])), tuple(sorted(map(shape, r["events"])))) for r in found if r["counts"] or r["events"]}
    assert got == want and len(want) > 50


def test_segments_of_compounds(spark):
    cases = [(4, [(2, "compound", 1), (2, "compound", 0), (3, "x", 2)]), (4, [(3, "compound", 0)]), (6, [(1, "compound", 0), (2, "compound:prt", 1), (5, "compound", 4), (5, "compound", 2)]), (12, [(i + 1, "compound", i) for i in range(11)]), (1, [])]
    df = spark.createDataFrame([(n, deps) for n, deps in cases], f"n int, deps {extraction.DEPS}")
    got = [tuple(map(tuple, r[0])) for r in df.select(extraction.segments(F.col("n"), F.col("deps"))).collect()]
    assert got == [tuple(plain_events.segments(n, deps)) for n, deps in cases]


def test_closure_of_depth_four(spark):
    deps = [(0, "a", 1), (1, "a", 2), (2, "a", 3), (3, "a", 4), (5, "a", 6)]
    df = spark.createDataFrame([(deps, ["VB", "RB", "JJ", "DT", "RB", "NN", "RB"])], f"d {extraction.DEPS}, t array<string>")
    inside = F.array(F.lit(0))
    for transitive, want in ((True, [1, 2, 3, 4]), (False, [1])):
        got = df.select(extraction.optional_closure(extraction.optional_edges(F.col("d"), F.col("t"), inside), inside, transitive)).first()[0]
        assert sorted(got) == want
