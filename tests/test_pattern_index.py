"""The pattern index: against the matcher of one pattern and one sentence."""

import random
import time

import pytest

from purposegraph.operators import matching, pattern_index
from purposegraph.operators.matching import Pattern

PARSED = "sid string, pos_tags array<string>, dependencies array<struct<gov:int,rel:string,dep:int>>"
LABELS, RELATIONS = ["NN", "NNS", "VB", "RB", "DT"], ["a", "b", "c:x", "c:y"]


def graphs(draw, n):
    rows = []
    for i in range(n):
        k = draw.randint(1, 7)
        arcs = [(draw.randrange(j), draw.choice(RELATIONS), j) for j in range(1, k)]
        arcs += [(draw.randrange(k), draw.choice(RELATIONS), draw.randrange(k)) for _ in range(draw.choice([0, 0, 1, 3]))]
        rows.append((f"s{i}", draw.choices(LABELS, k=k), [a if draw.random() < 0.7 else (a[2], a[1], a[0]) for a in arcs]))
    return rows


def patterns(draw, n):
    out = []
    for _ in range(n):
        k = draw.randint(1, 4)
        arcs = [(draw.randrange(j), draw.choice(["a", "b", "c", "NONE"]), j) for j in range(1, k) if draw.random() < 0.95]
        arcs += [(draw.randrange(k), draw.choice(["a", "c", "NONE"]), draw.randrange(k)) for _ in range(draw.choice([0, 0, 0, 1]))]
        out.append(Pattern(tuple(draw.choices([*LABELS, "NONE"], k=k)), tuple(a if draw.random() < 0.7 else (a[2], a[1], a[0]) for a in arcs)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_matcher(spark, seed):
    """Loops, parallel edges, wild labels and relations, unconnected patterns and single vertices among them."""
    draw = random.Random(seed)
    rows, library = graphs(draw, 120), patterns(draw, 150)
    df = spark.createDataFrame([*rows, ("none", None, None), ("empty", [], [])], PARSED).repartition(3)
    want = sorted((s, k, m) for s, tags, deps in rows for k, p in enumerate(library) if deps or not p.edges for m in matching.matches(tags, deps, p))
    got = sorted((r["sid"], r["pattern_id"], tuple(r["mapping"])) for r in pattern_index.find(df, library).collect())
    assert got == want and len(want) > 500
    one = sorted((r["sid"], r["pattern_id"]) for r in pattern_index.find(df, library, limit=1).collect())
    assert one == sorted({(s, k) for s, k, _ in want})


def test_thousands_of_patterns_in_one_plan(spark):
    draw = random.Random(9)
    rows = graphs(draw, 300)
    library = patterns(draw, 5000)
    df = spark.createDataFrame(rows, PARSED).repartition(4)
    found = pattern_index.find(df, library, limit=1)
    small = pattern_index.find(df, library[:2], limit=1)
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(found) == plan(small)
    start = time.time()
    got = {(r["sid"], r["pattern_id"]) for r in found.collect()}
    assert time.time() - start < 60
    some = random.Random(1).sample(range(5000), 60)
    assert {x for x in got if x[1] in set(some)} == {(s, k) for s, tags, deps in rows for k in some if (deps or not library[k].edges) and matching.matches(tags, deps, library[k], limit=1)}


def test_containment_and_isomorphs(spark):
    draw = random.Random(4)
    library = [p for p in patterns(draw, 200) if p.edges]
    got = {(r["parent"], r["child"]) for r in pattern_index.containment(spark, library).collect()}
    assert got == set(matching.hierarchy(library)) and len(got) > 20
    plain = [p for p in library if pattern_index.regular(p) and len(set(p.edges)) == len(p.edges)]
    renamed = []
    for p in plain:
        order = draw.sample(range(len(p.labels)), len(p.labels))
        renamed.append(Pattern(tuple(p.labels[order.index(i)] for i in range(len(order))), tuple((order[u], e, order[v]) for u, e, v in p.edges), 3))
    merged = pattern_index.merged(pattern_index.table(spark, plain + renamed)).collect()
    alone = pattern_index.merged(pattern_index.table(spark, plain)).collect()
    assert len(merged) == len(alone) and sum(r["freq"] for r in merged) == 3 * len(plain)
    exact = lambda a, b: sorted(a.labels) == sorted(b.labels) and len(a.edges) == len(b.edges) and any(tuple(a.labels[m[i]] for i in range(len(m))) == b.labels for m in matching.matches(a.labels, a.edges, b)) and "NONE" not in [e for _, e, _ in a.edges + b.edges]
    kinds = [p for p in plain if "NONE" not in p.labels and "NONE" not in [e for _, e, _ in p.edges]]
    classes = []
    for p in kinds:
        if not any(exact(p, q) for q in classes):
            classes.append(p)
    assert len(pattern_index.merged(pattern_index.table(spark, kinds)).collect()) == len(classes)
