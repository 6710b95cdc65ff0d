"""What follows a parse in the parse's own task: the same as on rows, with the input parsed once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from purposegraph.operators import extraction, matching, mining, pattern_index, subgraphs
from purposegraph.operators.matching import Pattern
from purposegraph.operators.parsing import Annotated
from purposegraph.plans import parsing as plans
from purposegraph.plans.tables import parsed, sentences


def shown(df):
    return sorted(map(str, df.collect()))


def counted(texts: Annotated, sums) -> Annotated:
    """The same texts; sums counts the batches' parses."""
    parse = texts.parse

    def run(batches):
        for batch in parse(batches):
            sums.add(batch.num_rows)
            yield batch

    return Annotated(texts.texts, run, texts.schema)


@pytest.mark.parametrize("query", ["frequent_triples", "frequent_quads", "frequent_subgraphs", "pattern_example", "subgraph_match_join", "optional_closure", "event_containment"])
def test_sentences_are_parsed_once(spark, sf, query, monkeypatch):
    """F6, F10, F13, F14, F15, F22, F24."""
    n, sums = sentences(spark, sf).count(), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(plans, "parsed", lambda *a: counted(parsed(*a), sums))
    plans.QUERIES[query](spark, sf).collect()
    assert sums.value == n


@pytest.mark.parametrize("query", ["pattern_library", "pattern_coverage"])
def test_sentences_are_parsed_twice_at_most(spark, sf, query, monkeypatch):
    """mined or counted, then matched."""
    n, sums = sentences(spark, sf).count(), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(plans, "parsed", lambda *a: counted(parsed(*a), sums))
    plans.QUERIES[query](spark, sf).collect()
    assert 0 < sums.value <= 2 * n


def test_annotated_texts_equal_their_rows(spark, sf):
    texts, rows = parsed(spark, sf), sentences(spark, sf)
    library = [plans.PATH, plans.FORK, plans.TWO]
    assert texts.count() == rows.count()
    assert shown(matching.find(texts, library)) == shown(matching.find(rows, library))
    bounds = [(3, 10, 400), (4, 20, 300)]
    assert shown(subgraphs.frequent(texts, bounds)) == shown(subgraphs.frequent(mining.graphs(rows), bounds))
    lemmas = rows.withColumn("lemmas", F.col("tokens"))
    for patterns in ([plans.CHAIN, plans.DET], [plans.CHAIN, plans.PATH]):
        assert shown(extraction.extract(texts, patterns)) == shown(extraction.extract(lemmas, patterns))
        assert shown(extraction.extract(texts, patterns, ("of",))) == shown(extraction.extract(lemmas, patterns, ("of",)))
    named = rows.withColumn("text", F.array_join("tokens", " "))
    assert shown(mining.shortest_matches(texts, library)) == shown(mining.example(matching.find(rows, library, limit=1), named))


def graphs(spark, rows):
    """Annotated texts whose parses are given: by place in the list."""
    kind = pa.schema([("sid", pa.string()), ("tokens", pa.list_(pa.string())), ("pos_tags", pa.list_(pa.string())), ("dependencies", pa.list_(pa.struct([("gov", pa.int32()), ("rel", pa.string()), ("dep", pa.int32())])))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"sid": str(i), "tokens": t, "pos_tags": t, "dependencies": [dict(zip(("gov", "rel", "dep"), e, strict=True)) for e in d]} for i in batch.column(0).to_pylist() for t, d in [rows[i]]], schema=kind)

    return Annotated(spark.range(len(rows)), run, "sid string, tokens array<string>, pos_tags array<string>, dependencies array<struct<gov:int,rel:string,dep:int>>")


ODD = [
    (["NN", "VB"], [(0, "next:x", 1), (0, "next", 1)]),
    (["NNS", "VB", "NN"], [(0, "next", 1), (2, "next", 1), (1, "det", 1)]),
    (["VB"], []),
    (["NN", "NN", "NN"], [(0, "next", 1), (1, "next", 2), (2, "next", 0)]),
]


def test_odd_graphs(spark):
    """Repeated edges, labels with colons, loops, circles, no edges."""
    texts = graphs(spark, ODD)
    assert shown(subgraphs.frequent(texts, [(2, 1, 9), (3, 1, 9)])) == shown(subgraphs.frequent(mining.graphs(texts.rows()), [(2, 1, 9), (3, 1, 9)]))
    patterns = [
        Pattern(("NN", "VB"), ((0, "next", 1),)), Pattern(("NN", "VB", "NN"), ((0, "next", 1), (2, "next", 1))), Pattern(("NN", "NN", "NN"), ((0, "next", 1), (1, "next", 2), (2, "next", 0))),
        Pattern(("NONE", "VB"), ((0, "NONE", 1),)), Pattern(("VB",), ((0, "det", 0),)),
    ]
    for p in patterns:
        want = sorted((str(i), *m) for i, (t, d) in enumerate(ODD) for m in matching.matches(t, d, p))
        assert sorted(map(tuple, matching.by_arcs(matching.arcs(texts, p), p).collect())) == want
        assert sorted((r["sid"], *r["mapping"]) for r in pattern_index.find(texts, [p]).collect()) == want


def test_events_are_written_in_the_parse(spark, sf):
    """no event is built by columns of the plan, and those of a sentence are no group that is folded."""
    plan = plans.event_containment(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("collect_list", "inline", "aggregate("))


COMPOUND = [
    (["IN", "NN", "NN", "DT", "JJ", "VBD"], [(1, "next", 0), (2, "compound", 1), (2, "det", 3), (3, "amod", 4), (5, "next", 2), (2, "amod", 4), (2, "amod", 4)]),
    (["NN", "NN", "NN", "NN"], [(0, "compound:x", 1), (1, "compound", 2), (3, "compound", 2), (0, "next", 3)]),
    (["DT", "NN", "DT", "NN"], [(1, "det", 0), (3, "det", 2), (1, "next", 3)]),
]


@pytest.mark.parametrize("transitive", [False, True])
def test_events_of_odd_graphs(spark, transitive):
    """compounds, leading prepositions, optional words of optional words, repeats and loops: as the columns say."""
    texts = graphs(spark, COMPOUND + ODD)
    rows = texts.rows().withColumn("lemmas", F.col("tokens"))
    patterns = [
        Pattern(("NN", "NN"), ((0, "compound", 1),)), Pattern(("NN", "IN"), ((0, "next", 1),)), Pattern(("NN", "NN", "NN"), ((0, "compound", 1), (1, "compound", 2))),
        Pattern(("DT", "NN"), ((1, "det", 0),)), Pattern(("NN", "VB"), ((0, "next", 1),)), Pattern(("NN", "NN"), ((0, "next", 1),)),
    ]
    got, want = (shown(extraction.extract(x, patterns, transitive=transitive)) for x in (texts, rows))
    assert got == want and len(got) > 5
    few = extraction.extract(texts, patterns, transitive=transitive, kept=("words", "segments"))
    assert few.columns == ["sid", "words", "segments"] and few.count() == len(got)


def test_sentence_of_many_events(spark):
    """what stays is what the rule says, event by event, also where a sentence has many."""
    import random

    draw = random.Random(3)
    rows = [(str(s), i, sorted(draw.sample(range(12), draw.randint(0, 4))), str(draw.randint(0, 60))) for s in range(4) for i in range(400 if s else 1)]
    events = spark.createDataFrame([(s, i, e, list(range(len(b))), b) for s, i, b, e in rows], "sid string, place int, eid string, skeleton_indices array<int>, raw_places array<int>")
    want = []
    for s in range(4):
        kept = []
        for _, i, b, e in sorted((r for r in rows if r[0] == str(s)), key=lambda r: (-len(r[2]), r[1])):
            if not any(set(b) <= set(k) or e == x for k, x in kept):
                kept.append((b, e))
        want += [(str(s), e, b) for b, e in kept]
    assert sorted(tuple(r) for r in extraction.without_contained(events).select("sid", "eid", "raw_places").collect()) == sorted(want)


def test_graphs_move_as_bytes(spark, monkeypatch):
    """no stored table of graphs or embeddings has arrays, which Spark moves number by number; slices of blobs are read as they are."""
    kinds, table = [], subgraphs.Scratch.table
    monkeypatch.setattr(subgraphs.Scratch, "table", lambda self, df: kinds.append(df.schema.simpleString()) or table(self, df))
    assert subgraphs.frequent(graphs(spark, COMPOUND + ODD), [(2, 1, 9), (3, 1, 9)]).count() > 3
    assert len(kinds) > 3 and not any("array" in k for k in kinds)
    made = subgraphs.blobs(np.arange(7), np.array([2, 0, 5]))
    assert [[x.tolist() for x in subgraphs.unblobbed(b)] for b in (made, made.slice(2), made.slice(1, 1), made.slice(0, 0))] == [[[0, 1, 2, 3, 4, 5, 6], [2, 0, 5]], [[2, 3, 4, 5, 6], [5]], [[], [0]], [[], []]]
