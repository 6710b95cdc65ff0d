import collections

import numpy as np
import pytest

from purposegraph.llm import blocks, pitman_yor, queries
from purposegraph.llm.pitman_yor import Settings


def test_burn_in_and_average(spark, sf, monkeypatch):
    """the query averages rounds after a burn-in, and a burnt round is in no average. The empty text's one token shows the average itself."""
    docs = spark.createDataFrame([(1, "a b a b c"), (9, "a a b"), (3, ""), (5, "c a b a")], "doc_id long, text string")
    mean = lambda **s: next(10 ** r["score"] for r in pitman_yor.score(docs, settings=Settings(**s)).collect() if r["doc_id"] == 3)
    assert 3 * mean(rounds=3, burn=0) - mean(rounds=1, burn=0) == pytest.approx(2 * mean(rounds=3, burn=1), rel=1e-9)
    seen = []
    monkeypatch.setattr(queries.pitman_yor, "score", lambda docs, settings=Settings(): seen.append(settings))
    queries.op9_lm_scores(spark, sf)
    assert seen[0].burn >= 1 and seen[0].rounds - seen[0].burn >= 2


def test_pairs_of_a_block_are_found_by_sorts(spark, monkeypatch):
    """op9's CPU: counts and places of pairs come from sorts, not from look-ups for each token."""
    texts = ["A b a\tb\u00a0c", "", "a b\n\x0b\x0c b", "\xc9 a b"]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[3])], "doc_id long, text string").coalesce(1)
    rows = pitman_yor.token_blocks(docs, 2, "text", pitman_yor.held_out).where("payload is not null").collect()
    monkeypatch.setattr(np, "searchsorted", None)
    plain = [[*pitman_yor.tokens([t])[0]] for t in texts]  # distinct tokens in order of first appearance
    assert plain == [[b"a", b"b", "b\u00a0c".encode(), b"\n"], [b"\n"], [b"a", b"b", b"\n"], ["\xc9".encode(), b"a", b"b", b"\n"]]
    b = pitman_yor.Block(rows[0]["payload"])
    assert len(rows) == 1 and b.sizes.tolist() == [5, 1, 4, 4] and b.doc_ids == [1, 2, 3, None]
    met = b.neighbours()
    assert b.pairs[b.pair].tolist() == met.tolist()
    trained = collections.Counter(met[~np.repeat(b.held, b.sizes)].tolist())
    assert b.trained().tolist() == [trained[x] for x in b.pairs.tolist()]


def test_sorting_equals_argsort():
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    near = (np.uint64((1 << 64) - 9) + rng.integers(0, 9, 5000).astype(np.uint64))[::-1]  # told apart by the lowest bits alone
    for keys in (wide, near, np.append(wide, wide[:900]), rng.integers(0, 50, 3000), np.array([], dtype=np.int64), np.zeros(4, dtype=np.int64)):
        assert blocks.sorting(keys).tolist() == np.argsort(keys, kind="stable").tolist()
