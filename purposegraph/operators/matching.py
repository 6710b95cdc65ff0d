"""Labelled sub-graph matching over parsed sentences.

Sentences are rows with pos_tags (array of strings) and dependencies (array of (gov, rel, dep)); patterns are few and
travel with the closure. Cheap necessary conditions are native columns ahead of the Python matcher.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.vocab import CLAUSE_SEPARATOR_PREFIX, CLAUSE_SEPARATOR_TAGS, FORBIDDEN_END_POS_TAGS, MUST_POS_TAGS
from .parsing import Annotated

Edge = tuple[int, str, int]
#: A pattern label that fits any label, and those that fit whatever they begin.
WILD, PREFIXES = "NONE", ("NN", "RB", "JJ")


@dataclass(frozen=True)
class Pattern:
    """Vertex labels, edges between their places, and a frequency."""

    labels: tuple[str, ...]
    edges: tuple[Edge, ...]
    freq: int = 0

    def key(self) -> tuple:
        return len(self.edges), len(self.labels), self.labels, self.edges


def _bundles(edges) -> dict[tuple[int, int], set[str]]:
    """The labels of the parallel edges between each two vertices."""
    out: dict[tuple[int, int], set[str]] = {}
    for u, label, v in edges:
        out.setdefault((u, v), set()).add(label)
    return out


class Graph:
    """A sentence's graph, indexed once for all patterns."""

    def __init__(self, labels, edges):
        self.labels = labels
        self.out: dict[int, dict[int, set[str]]] = {}
        self.back: dict[int, set[int]] = {}
        self.into = [0] * len(labels)
        self.edges = 0
        for u, label, v in edges:
            self.edges += 1
            self.into[v] += 1
            self.out.setdefault(u, {}).setdefault(v, set()).add(label.partition(":")[0])
            self.back.setdefault(v, set()).add(u)
        self.at: dict[str, list[int]] = {}
        for i, label in enumerate(labels):
            self.at.setdefault(label, []).append(i)

    def fitting(self, wanted: str) -> list[int]:
        if wanted == WILD:
            return list(range(len(self.labels)))
        if wanted in PREFIXES:
            return sorted(i for label, places in self.at.items() if label.startswith(wanted) for i in places)
        return self.at.get(wanted, [])


@lru_cache(4096)
def _steps(pattern: Pattern) -> tuple[tuple[int, str, int, tuple[tuple[int, int, frozenset[str]], ...]], ...]:
    """The order in which a pattern's vertices are placed: vertex, label, incoming edges it needs, bundles to itself and to those placed before."""
    wanted = _bundles(pattern.edges)
    need = Counter(v for _, _, v in pattern.edges)
    beside = {p: {q for e in wanted for q in e if p in e and q != p} for p in range(len(pattern.labels))}
    order: list[int] = []
    while len(order) < len(pattern.labels):  # next a vertex that touches those placed, the one with most edges first
        rest = [p for p in range(len(pattern.labels)) if p not in order]
        order.append(max(rest, key=lambda p: (len(beside[p] & set(order)), len(beside[p]), -p)))
    return tuple(
        (p, pattern.labels[p], need[p], tuple((x, y, frozenset(w)) for (x, y), w in sorted(wanted.items()) if p in (x, y) and {x, y} <= set(order[: k + 1]))) for k, p in enumerate(order)
    )


def matches(labels, edges, pattern: Pattern, limit: int | None = None, fixed: dict[int, int] | None = None, graph: Graph | None = None) -> list[tuple[int, ...]]:
    """All injective mappings of the pattern's vertices into the graph that keep its edges (further edges may be there).

    A mapping gives the graph vertex of each pattern vertex; symmetric images come separately. A vertex needs at least
    the pattern vertex's number of incoming edges; the labels of parallel pattern edges must all be among the graph's,
    whose own labels count up to their colon. fixed: graph vertices that some pattern vertices must take. graph: labels
    and edges, indexed already.
    """
    g = graph or Graph(labels, edges)
    steps = _steps(pattern)
    fits = {p: [i for i in g.fitting(label) if g.into[i] >= need and (not fixed or fixed.get(p, i) == i)] for p, label, need, _ in steps}
    out: list[tuple[int, ...]] = []
    place: dict[int, int] = {}

    def near(p: int, bundles) -> list[int]:
        """Where p can go: beside a placed neighbour if it has one."""
        for x, y, _ in bundles:
            if x != y:
                some = g.out.get(place[x], {}) if y == p else g.back.get(place[y], ())
                return [i for i in fits[p] if i in some]
        return fits[p]

    def extend(depth: int) -> bool:
        if depth == len(steps):
            out.append(tuple(place[p] for p in range(len(steps))))
            return limit is not None and len(out) >= limit
        p, _, _, bundles = steps[depth]
        for i in near(p, bundles):
            if i in place.values():
                continue
            place[p] = i
            if all((got := g.out.get(place[x], {}).get(place[y])) and (w <= got or WILD in w) for x, y, w in bundles) and extend(depth + 1):
                return True
            del place[p]
        return False

    if all(fits.values()):
        extend(0)
    return sorted(out)


def matches_at_edge(labels, edges: list[Edge], pattern: Pattern, graph_edge: int | None = None, pattern_edge: int | None = None) -> list[tuple[int, ...]]:
    """Matches that lay a pattern edge on a graph edge of the same label, as counted up to its colon, both loops or neither.

    The seeds are places in the edge lists: with both, that pattern edge lies on that graph edge; with one, it meets any
    of the other side; without, all matches. A match found through several edges comes once.
    """
    if graph_edge is None and pattern_edge is None:
        return matches(labels, edges, pattern)
    g, found = Graph(labels, edges), set()
    for pu, wanted, pv in pattern.edges if pattern_edge is None else [pattern.edges[pattern_edge]]:
        for u, label, v in edges if graph_edge is None else [edges[graph_edge]]:
            if label.split(":")[0] == wanted.split(":")[0] and (u == v) == (pu == pv):
                found.update(matches(labels, edges, pattern, fixed={pu: u, pv: v}, graph=g))
    return sorted(found)


def contains(big: Pattern, small: Pattern) -> bool:
    return bool(matches(big.labels, big.edges, small, limit=1))


def placed(pattern: Pattern, mapping: tuple[int, ...]) -> Pattern:
    """The pattern with its vertices in the order of their places in a sentence, edges sorted."""
    order = sorted(range(len(mapping)), key=lambda p: mapping[p])
    rank = {p: i for i, p in enumerate(order)}
    edges = sorted(((rank[u], label, rank[v]) for u, label, v in pattern.edges), key=lambda e: (e[0], e[2], e[1]))
    return Pattern(tuple(pattern.labels[p] for p in order), tuple(edges), pattern.freq)


def ordered(patterns: list[Pattern]) -> list[Pattern]:
    """Largest first: by numbers of edges and vertices, then labels and edges."""
    return sorted(patterns, key=Pattern.key, reverse=True)


def without_isomorphs(patterns: list[Pattern]) -> list[Pattern]:
    """ordered(), without those that are isomorphic to (or contain) an earlier one; their frequencies go to it."""
    kept: list[Pattern] = []
    for p in ordered(patterns):
        twin = next((i for i, k in enumerate(kept) if len(k.labels) == len(p.labels) and len(k.edges) <= len(p.edges) and contains(p, k)), None)
        if twin is None:
            kept.append(p)
        else:
            kept[twin] = Pattern(kept[twin].labels, kept[twin].edges, kept[twin].freq + p.freq)
    return kept


def hierarchy(patterns: list[Pattern]) -> list[tuple[int, int]]:
    """(parent, child) places: the parent contains the child and has no fewer edges and as many vertices or one more."""
    return [
        (j, i)
        for i, small in enumerate(patterns)
        for j, big in enumerate(patterns)
        if i != j and len(big.labels) - len(small.labels) in (0, 1) and len(big.edges) >= len(small.edges) and contains(big, small)
    ]


def connected(pattern: Pattern) -> bool:
    """One piece, with every CC, WRB and WP* vertex governed and no parataxis."""
    n = len(pattern.labels)
    if len(pattern.edges) < n - 1 or any(label.split(":")[0] == "parataxis" for _, label, _ in pattern.edges):
        return False
    governed = {v for _, _, v in pattern.edges}
    if any((x in ("CC", "WRB") or x.startswith("WP")) and i not in governed for i, x in enumerate(pattern.labels)):
        return False
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for u, _, v in pattern.edges:
            for y in ({u, v} - {x}) if x in (u, v) else ():
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    return len(seen) == n


def prefix_ok(mapping, k: int) -> bool:
    """The first k mapped places, in order, are neighbours."""
    s = sorted(mapping)[:k]
    return all(b - a == 1 for a, b in zip(s, s[1:], strict=False))


def must_ok(mapping, edges, tags=None) -> bool:
    """No edge across the match's border is a must: by its label, or with tags by its outer end's tag."""
    inside = set(mapping)
    across = [(u, label, v) for u, label, v in edges if (u in inside) != (v in inside)]
    return not any((tags[v if u in inside else u] if tags else label) in MUST_POS_TAGS for u, label, v in across)


# The same predicates as columns; mapping is an array of places.


def prefix_holds(mapping: Column, k: int) -> Column:
    def neighbours(s: Column) -> Column:
        return F.forall(F.transform(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) == 1)), lambda b: b)

    return let(F.slice(F.array_sort(mapping), 1, k), neighbours)


def separators(tags: Column) -> Column:
    """Places of clause separators, by their tags."""
    return F.filter(F.transform(tags, lambda t, i: F.when(t.isin(*CLAUSE_SEPARATOR_TAGS) | t.startswith(CLAUSE_SEPARATOR_PREFIX), i)), lambda i: i.isNotNull())


def within_clause(mapping: Column, places: Column) -> Column:
    """No separator lies at, or between, places of a match of two or more."""
    ends = F.struct(F.array_min(mapping).alias("lo"), F.array_max(mapping).alias("hi"))
    return (F.size(mapping) < 2) | let(ends, lambda m: ~F.exists(places, lambda s: (m["lo"] <= s) & (s <= m["hi"])))


def must_holds(mapping: Column, dependencies: Column, tags: Column) -> Column:
    """No edge across the match's border ends outside at a must tag."""
    def outer(m: Column) -> Column:
        def bad(d: Column) -> Column:
            inside = F.array_contains(m, d["gov"])
            return (inside != F.array_contains(m, d["dep"])) & F.get(tags, F.when(inside, d["dep"]).otherwise(d["gov"])).isin(*MUST_POS_TAGS)

        return ~F.exists(dependencies, bad)

    return let(mapping, outer)


def ends_well(labels: Column) -> Column:
    """The labels, in the order of places, don't end with a forbidden tag."""
    return ~F.element_at(labels, -1).isin(*FORBIDDEN_END_POS_TAGS)


def degrees_suffice(pattern: Pattern) -> Column:
    """Necessary: for each pattern vertex some vertex that has as many edges of each label coming in, and going out."""
    out = F.lit(True)
    for p in range(len(pattern.labels)):
        for end, other in (("gov", 0), ("dep", 2)):
            need = Counter(e[1] for e in pattern.edges if e[other] == p and e[1] != WILD)
            if need:
                out = out & _one_has(end, need)
    return out


def _one_has(end: str, need: Counter) -> Column:
    """Some vertex at that end of edges has at least so many of each label."""
    def enough(place: Column) -> Column:
        ok = F.lit(True)
        for label, n in need.items():
            ok = ok & (F.size(F.filter("dependencies", _one(lambda d, label=label: (d[end] == place) & (F.split_part(d["rel"], F.lit(":"), F.lit(1)) == label)))) >= n)
        return ok

    return F.exists(F.array_distinct(F.transform("dependencies", lambda d: d[end])), enough)


def large_enough(pattern: Pattern) -> Column:
    """Necessary: as many vertices and edges, and each pattern label as often among the tags."""
    out = (F.size("pos_tags") >= len(pattern.labels)) & (F.size("dependencies") >= len(pattern.edges))
    for label, n in Counter(x for x in pattern.labels if x != WILD).items():
        fits = (lambda t, label=label: t.startswith(label)) if label in PREFIXES else (lambda t, label=label: t == label)
        out = out & (F.size(F.filter("pos_tags", _one(fits))) >= n)
    for label in {x for _, x, _ in pattern.edges if x != WILD}:
        out = out & F.exists("dependencies", _one(lambda d, label=label: F.split_part(d["rel"], F.lit(":"), F.lit(1)) == label))
    return out


def _one(f):
    return lambda x: f(x)


def edge_lists(column: pa.ListArray) -> list[list[Edge]]:
    """Arrow lists of (gov, rel, dep) as lists of tuples, without a dictionary for each; null lists are empty."""
    flat = column.flatten()
    edges = list(zip(*(flat.field(name).to_pylist() for name in ("gov", "rel", "dep")), strict=True))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return [edges[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)] if len(column) else []


def find(sentences: DataFrame, patterns: list[Pattern], limit: int | None = None) -> DataFrame:
    """(sid, pattern_id, mapping) of all matches; pattern_id is the pattern's place in the list. See pattern_index.find."""
    from . import pattern_index

    return pattern_index.find(sentences, patterns, limit)


def shown(pattern: Pattern) -> str:
    """A pattern as text, for people."""
    arcs = ", ".join(f"{pattern.labels[u]}{u} -{label}-> {pattern.labels[v]}{v}" for u, label, v in pattern.edges)
    return f"[{' '.join(pattern.labels)}] {arcs} x{pattern.freq}"


def count(sentences: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(pattern_id, matches, sentences)."""
    return find(sentences, patterns).groupBy("pattern_id").agg(F.count("*").alias("matches"), F.countDistinct("sid").alias("sentences"))


def by_joins(nodes: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """The matches of one pattern as joins: nodes (sid, v, label), edges (sid, u, label, v). Columns sid, p0, p1, ...

    For patterns whose vertices are all on edges. Each pattern edge is a join on the sentence and what is placed already.
    """
    e = edges.select("sid", "u", F.split_part("label", F.lit(":"), F.lit(1)).alias("label"), "v").distinct()
    out, placed_ = None, set()
    todo = list(pattern.edges)
    while todo:
        u, label, v = next((x for x in todo if not placed_ or {x[0], x[2]} & placed_), todo[0])
        todo.remove((u, label, v))
        step = (e if label == WILD else e.where(F.col("label") == label)).select("sid", F.col("u").alias(f"p{u}"), F.col("v").alias(f"p{v}")).distinct()
        out = step if out is None else out.join(step, ["sid", *[f"p{x}" for x in (u, v) if x in placed_]])
        placed_ |= {u, v}
    into = edges.groupBy("sid", F.col("v")).agg(F.count("*").alias("into"))
    need = Counter(v for _, _, v in pattern.edges)
    for p, want in enumerate(pattern.labels):
        n = nodes
        if want != WILD:
            n = n.where(F.col("label").startswith(want) if want in PREFIXES else F.col("label") == want)
        out = out.join(n.select("sid", F.col("v").alias(f"p{p}")), ["sid", f"p{p}"], "left_semi")
        if need[p] > 1:
            out = out.join(into.where(F.col("into") >= need[p]).select("sid", F.col("v").alias(f"p{p}")), ["sid", f"p{p}"], "left_semi")
    ids = [F.col(f"p{p}") for p in range(len(pattern.labels))]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            out = out.where(a != b)
    return out.select("sid", *[f"p{p}" for p in range(len(pattern.labels))])


def arcs(texts: Annotated, pattern: Pattern) -> DataFrame:
    """(sid, u, label, v, lu, lv, iu, iv): the edges of annotated texts that fit an edge of the pattern by relation, the labels of both ends, and the numbers of edges that enter them.

    They are chosen as the texts are parsed, so that no other edge, and no vertex, is a row.
    """
    need = Counter(v for _, _, v in pattern.edges)
    wanted = [(x, pattern.labels[u], pattern.labels[v], need[u], need[v]) for u, x, v in pattern.edges]

    def run(batches):
        for batch in batches:
            tags, deps = batch.column("pos_tags"), batch.column("dependencies")
            n, m = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (tags, deps))
            labels, edges = tags.flatten().dictionary_encode(), deps.flatten()
            rels = edges.field("rel").dictionary_encode()
            row = np.repeat(np.arange(len(m)), m)
            u, v = (edges.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("gov", "dep"))
            first = (np.cumsum(n) - n)[row]
            into = np.bincount(v + first, minlength=len(labels))
            label, rel = labels.indices.to_numpy(zero_copy_only=False), rels.indices.to_numpy(zero_copy_only=False)
            names, plain = labels.dictionary.to_pylist(), [x.partition(":")[0] for x in rels.dictionary.to_pylist()]
            lu, lv, iu, iv = label[u + first], label[v + first], into[u + first], into[v + first]
            good = np.zeros(len(u), dtype=bool)
            for x, a, b, into_a, into_b in wanted:
                fits = lambda w: np.array([fits_label(t, w) for t in names], dtype=bool)
                if len(u):
                    good |= np.array([x in (WILD, t) for t in plain], dtype=bool)[rel] & fits(a)[lu] & fits(b)[lv] & (iu >= into_a) & (iv >= into_b)
            at = np.flatnonzero(good)
            shown = lambda items, which: pa.array(items, pa.string()).take(pa.array(which[at]))
            ints = lambda x: pa.array(x[at], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(row[at])), ints(u), shown(plain, rel), ints(v), shown(names, lu), shown(names, lv), ints(iu), ints(iv)], names=["sid", "u", "label", "v", "lu", "lv", "iu", "iv"])

    return texts.then(run, "sid string, u int, label string, v int, lu string, lv string, iu int, iv int")


def fits_label(label: str, wanted: str) -> bool:
    return wanted == WILD or label == wanted or (wanted in PREFIXES and label.startswith(wanted))


def by_arcs(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """by_joins() of edges (sid, u, label, v, lu, lv, iu, iv) that know their ends: a join for each pattern edge, of those alone that fit it."""
    need = Counter(v for _, _, v in pattern.edges)
    rows = edges.distinct()
    out, placed_, todo = None, set(), list(pattern.edges)

    def end(c: str, p: int) -> Column:
        want = pattern.labels[p]
        fits = F.lit(True) if want == WILD else F.col(f"l{c}").startswith(want) if want in PREFIXES else F.col(f"l{c}") == want
        return fits & (F.col(f"i{c}") >= need[p])

    while todo:
        u, label, v = next((x for x in todo if not placed_ or {x[0], x[2]} & placed_), todo[0])
        todo.remove((u, label, v))
        fitting = rows.where(end("u", u) & end("v", v) & (F.lit(True) if label == WILD else F.col("label") == label))
        step = fitting.where("u = v").select("sid", F.col("u").alias(f"p{u}")) if u == v else fitting.select("sid", F.col("u").alias(f"p{u}"), F.col("v").alias(f"p{v}"))
        out = step.distinct() if out is None else out.join(step.distinct(), ["sid", *[f"p{x}" for x in sorted({u, v}) if x in placed_]])
        placed_ |= {u, v}
    ids = [F.col(f"p{p}") for p in range(len(pattern.labels))]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            out = out.where(a != b)
    return out.select("sid", *[f"p{p}" for p in range(len(pattern.labels))])
