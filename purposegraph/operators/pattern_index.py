"""Matching against libraries of patterns: an index of edge triples over a tree of steps that patterns share.

A pattern is laid out from its rarest edge (label, relation, label in the whole library) vertex by vertex; patterns
that begin alike share what they begin with. A batch of sentences is walked once: edges of the batch are looked up by triple for the first
steps, and each further step extends the places found so far for all sentences of the batch together. Steps
without places end the walk there, so a pattern costs nothing where its rarest edge doesn't occur.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import OPTIONAL_POS_TAGS
from .matching import PREFIXES, WILD, Graph, Pattern, edge_lists, matches
from .parsing import Annotated, decoded
from .subgraphs import among, ragged, smallest

#: (place in the order of steps, True if the edge leaves it, relations, label of the new vertex, edges that it needs coming in,
#: (place, True if the edge leaves it, relations) of further edges to places before)
Step = tuple[int, bool, tuple[str, ...], str, int, tuple[tuple[int, bool, tuple[str, ...]], ...]]
FOUND = "sid string, pattern_id int, mapping array<int>"


@dataclass
class Node:
    """What can follow the same steps: further steps, and patterns that are complete (id, place of each vertex)."""

    onward: dict = field(default_factory=dict)
    complete: list[tuple[int, list[int]]] = field(default_factory=list)


def regular(p: Pattern) -> bool:
    """Connected by edges without loops; others are matched one by one."""
    reach, more = {0}, True
    while more:
        more = {x for u, _, v in p.edges for x in (u, v) if (u in reach or v in reach)} - reach
        reach |= more
    return bool(p.edges) and len(reach) == len(p.labels) and all(u != v for u, _, v in p.edges)


def library(patterns: list[Pattern]) -> tuple[Node, list[int]]:
    """(the tree of the regular patterns' steps, places in the list of the others)."""
    triples = Counter((p.labels[u], e, p.labels[v]) for p in patterns for u, e, v in set(p.edges))
    root, odd = Node(), []
    for k, p in enumerate(patterns):
        if not regular(p):
            odd.append(k)
            continue
        bundles: dict[tuple[int, int], set[str]] = {}
        for u, e, v in p.edges:
            bundles.setdefault((u, v), set()).add(e)
        need = Counter(v for _, _, v in p.edges)
        first = min(p.edges, key=lambda x: (triples[p.labels[x[0]], x[1], p.labels[x[2]]], p.labels[x[0]], x[1], p.labels[x[2]], x[0], x[2]))
        shown = lambda u, v: tuple(sorted(bundles[u, v])) if WILD not in bundles[u, v] else (WILD,)
        order = [first[0], first[2]]
        back = shown(first[2], first[0]) if (first[2], first[0]) in bundles else ()
        step = (p.labels[first[0]], need[first[0]], shown(*order), back, p.labels[first[2]], need[first[2]])
        node = root.onward.setdefault(step, Node())
        while len(order) < len(p.labels):
            ways = []
            for u, v in bundles:
                for old, new, out in ((u, v, True), (v, u, False)):
                    if old in order and new not in order:
                        ways.append((order.index(old), out, shown(u, v), p.labels[new], need[new], new))
            at, out, relations, label, n, new = min(ways)
            rest = [(i, True, shown(x, new)) for i, x in enumerate(order) if (x, new) in bundles] + [(i, False, shown(new, x)) for i, x in enumerate(order) if (new, x) in bundles]
            rest.remove((at, out, relations))
            order.append(new)
            node = node.onward.setdefault((at, out, relations, label, n, tuple(sorted(rest))), Node())
        node.complete.append((k, [order.index(x) for x in range(len(order))]))
    return root, odd


class Sentences:
    """The graphs of a batch: vertices numbered through, edges without loops by the vertex they leave and by the one they enter."""

    def __init__(self, tags: pa.ListArray, deps: pa.ListArray):
        n = tags.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        m = deps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        labels, arcs = tags.flatten(), deps.flatten()
        labels = (labels.fill_null("") if labels.null_count else labels).dictionary_encode()
        self.names, self.label = labels.dictionary.to_pylist(), labels.indices.to_numpy()
        shift = np.repeat(self.first, m)
        u, v = (arcs.field(x).to_numpy(zero_copy_only=False).astype(np.int64) + shift for x in ("gov", "dep"))
        rels = arcs.field("rel").dictionary_encode()
        plain = [x.partition(":")[0] for x in rels.dictionary.to_pylist()]
        self.rels = sorted(set(plain))
        e = np.array([self.rels.index(x) for x in plain], dtype=np.int64)[rels.indices.to_numpy()] if len(u) else u
        self.size = len(self.label)
        self.into = np.bincount(v, minlength=self.size)
        keep = u != v
        edges = np.unique(np.stack([u[keep], v[keep], e[keep]]), axis=1) if keep.any() else np.zeros((3, 0), dtype=np.int64)
        self.ends = {}
        for out, (a, b, x) in ((True, edges), (False, edges[[1, 0, 2]])):
            order = np.argsort(a, kind="stable")
            self.ends[out] = (b[order], x[order], np.searchsorted(a[order], np.arange(self.size + 1)))
        u, v, e = edges
        self.pairs = np.unique(u * self.size + v)
        self.exact = np.sort((u * self.size + v) * max(1, len(self.rels)) + e)
        triple = (self.label[u].astype(np.int64) * max(1, len(self.rels)) + e) * max(1, len(self.names)) + self.label[v]
        order = np.argsort(triple, kind="stable")
        self.triples, start = np.unique(triple[order], return_index=True)
        self.slices = np.append(start, len(order))
        self.u, self.v = u[order], v[order]
        self._fits: dict[str, np.ndarray] = {}

    def fits(self, wanted: str) -> np.ndarray:
        """Which of the batch's labels the pattern's label fits."""
        if wanted not in self._fits:
            self._fits[wanted] = np.array([wanted == WILD or x == wanted or (wanted in PREFIXES and x.startswith(wanted)) for x in self.names], dtype=bool)
        return self._fits[wanted]

    def has(self, u: np.ndarray, v: np.ndarray, relations: tuple[str, ...]) -> np.ndarray:
        """Which pairs have edges of all the relations; any edge will do for the wild one."""
        at = u * self.size + v
        ok = np.ones(len(at), dtype=bool)
        for r in relations:
            if r == WILD:
                ok &= among(at, self.pairs)
            elif r in self.rels:
                ok &= among(at * len(self.rels) + self.rels.index(r), self.exact)
            else:
                ok[:] = False
        return ok

    def started(self, step) -> np.ndarray:
        """Places (first, second) of a pattern's first edge, looked up by triple."""
        left, into_left, relations, back, right, into_right = step
        known, n = max(1, len(self.rels)), max(1, len(self.names))
        rest, b = np.divmod(self.triples, n)
        a, e = np.divmod(rest, known)
        ok = self.fits(left)[a] & self.fits(right)[b] if len(a) else np.zeros(0, dtype=bool)
        if relations[0] != WILD:
            ok &= e == self.rels.index(relations[0]) if relations[0] in self.rels else False
        some = np.flatnonzero(ok)
        at = ragged(self.slices[some], self.slices[some + 1] - self.slices[some])
        u, v = self.u[at], self.v[at]
        ok = (self.into[u] >= into_left) & (self.into[v] >= into_right)
        u, v = u[ok], v[ok]
        if len(relations) > 1 or back:
            ok = self.has(u, v, relations[1:]) & self.has(v, u, back)
            u, v = u[ok], v[ok]
        places = np.stack([u, v], axis=1)
        return np.unique(places, axis=0) if relations[0] == WILD and len(places) else places

    def extended(self, places: np.ndarray, step: Step) -> np.ndarray:
        at, out, relations, label, into, rest = step
        b, e, start = self.ends[out]
        x = places[:, at]
        sizes = start[x + 1] - start[x]
        m, edge = np.repeat(np.arange(len(x)), sizes), ragged(start[x], sizes)
        new = b[edge]
        ok = (self.into[new] >= into) & self.fits(label)[self.label[new]]
        if relations[0] != WILD:
            ok &= e[edge] == self.rels.index(relations[0]) if relations[0] in self.rels else False
        m, new = m[ok], new[ok]
        ok = ~(places[m] == new[:, None]).any(axis=1)
        m, new = m[ok], new[ok]
        for i, leaves, wanted in ((at, out, relations[1:]), *rest):
            if wanted and len(m):
                old = places[m, i]
                ok = self.has(old, new, wanted) if leaves else self.has(new, old, wanted)
                m, new = m[ok], new[ok]
        wider = np.concatenate([places[m], new[:, None]], axis=1)
        return np.unique(wider, axis=0) if relations[0] == WILD and len(wider) else wider


def walked(g: Sentences, root: Node):
    """(pattern, places of its vertices) of all matches in the batch."""
    todo = [(node, g.started(step)) for step, node in root.onward.items()]
    while todo:
        node, places = todo.pop()
        if len(places):
            for k, order in node.complete:
                yield k, places[:, order]
            todo += [(further, g.extended(places, step)) for step, further in node.onward.items()]


def gathered(tags: pa.ListArray, deps: pa.ListArray, root: Node, odd: list[int], patterns: list[Pattern], limit: int | None):
    """(row, pattern, mapping's length, mappings end to end) of all matches in a batch, in order of rows, patterns and mappings."""
    g = Sentences(tags, deps)
    none = np.zeros(0, dtype=np.int64)
    rows, ids, maps, sizes = [none], [none], [none], [none]
    for k, places in walked(g, root):
        row = g.row[places[:, 0]]
        local = places - g.first[row][:, None]
        order = np.lexsort((*local.T[::-1], row))
        if limit is not None:
            begin = np.flatnonzero(np.diff(row[order], prepend=-1))
            order = order[np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < limit]
        for out, x in ((rows, row[order]), (ids, np.full(len(order), k)), (maps, local[order].reshape(-1)), (sizes, np.full(len(order), local.shape[1]))):
            out.append(x)
    if odd:
        for i, (t, e) in enumerate(zip(tags.to_pylist(), edge_lists(deps), strict=True)):
            graph = Graph(t, e)
            for k in odd:
                for m in matches(t, e, patterns[k], limit, graph=graph):
                    for out, x in ((rows, [i]), (ids, [k]), (maps, m), (sizes, [len(m)])):
                        out.append(np.array(x, dtype=np.int64))
    rows, ids, maps, sizes = (np.concatenate(x) for x in (rows, ids, maps, sizes))
    order = np.lexsort((np.arange(len(rows)), ids, rows))
    begin = np.cumsum(sizes) - sizes
    return rows[order], ids[order], sizes[order], maps[ragged(begin[order], sizes[order])]


def narrowed(sentences: DataFrame, patterns: list[Pattern]) -> DataFrame:
    vertices, edges = min(len(p.labels) for p in patterns), min(len(p.edges) for p in patterns)
    return sentences.where((F.size("pos_tags") >= max(1, vertices)) & (F.size("dependencies") >= edges))


def find(sentences: DataFrame | Annotated, patterns: list[Pattern], limit: int | None = None) -> DataFrame:
    """(sid, pattern_id, mapping) of all matches, or of the first `limit` of each pattern in a sentence; pattern_id is the pattern's place in the list.

    Matches are those of matching.matches. Annotated texts are matched in the task that parses them. One map whose plan doesn't grow with the patterns, which travel with the function.
    """
    if not patterns:
        return sentences.sparkSession.createDataFrame([], FOUND)
    root, odd = library(patterns)

    def run(batches):
        for batch in batches:
            rows, ids, sizes, maps = gathered(batch.column("pos_tags"), batch.column("dependencies"), root, odd, patterns, limit)
            mapping = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(maps, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(rows)), pa.array(ids, pa.int32()), mapping], names=["sid", "pattern_id", "mapping"])

    if isinstance(sentences, Annotated):
        return sentences.then(run, FOUND)
    return narrowed(sentences, patterns).select(F.col("sid").cast("string").alias("sid"), "pos_tags", "dependencies").mapInArrow(run, FOUND)


def surroundings(maps: np.ndarray, match: np.ndarray, u: np.ndarray, v: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(match, edge) of the edges u -> v that leave a match's vertices (maps, of which match says whose they are) or words that these lead to where follow says so, and so on."""
    order = np.argsort(u, kind="stable")
    start = np.searchsorted(u[order], np.arange(len(follow) + 1))
    seen = at = match * len(follow) + maps
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    while len(at):
        m, x = np.divmod(at, len(follow))
        sizes = start[x + 1] - start[x]
        m, edge = np.repeat(m, sizes), order[ragged(start[x], sizes)]
        found.append((m, edge))
        at = np.setdiff1d((m * len(follow) + v[edge])[follow[v[edge]]], seen)
        seen = np.union1d(seen, at)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


MATCH = "struct<pattern_id:int,mapping:array<int>,labels:array<string>,places:array<int>,inside:array<int>,near:array<struct<gov:int,rel:string,dep:int>>>"
WORDED = f"{MATCH[:-1]},tags:array<string>,tokens:array<string>>"


def matched(sentences: DataFrame | Annotated, patterns: list[Pattern], follow: tuple[str, ...] = OPTIONAL_POS_TAGS) -> DataFrame:
    """The sentences that have a match, with matches: an array of (pattern_id, mapping, labels of the pattern, places, inside, near), in order.

    near: the edges that leave the match's words, and those that leave words with the tags `follow` that depend on them,
    directly or not; places: the places of all these words, in order. near and inside, the match itself, count in places,
    so what is made of a match needs no more of its sentence, however long that is. Annotated texts are matched in the task
    that parses them: of their sentences only sid becomes a row, and a match has the tags and tokens of its places besides.
    """
    texts = isinstance(sentences, Annotated)
    empty = sentences.sparkSession.createDataFrame([], f"sid string, matches array<{WORDED}>") if texts else sentences.where("false").withColumn("matches", F.array().cast(f"array<{MATCH}>"))
    if not patterns:
        return empty
    root, odd = library(patterns)
    columns, schema = [c for c in empty.columns if c != "matches"], empty.schema

    def run(batches):
        for batch in batches:
            tags, deps = (batch.column(c) for c in ("pos_tags", "dependencies"))
            rows, ids, sizes, maps = gathered(tags, deps, root, odd, patterns, None)
            n, m = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (tags, deps))
            first, arcs, words = np.cumsum(n) - n, deps.flatten(), tags.flatten()
            shift = np.repeat(first, m)
            u, v = (arcs.field(x).to_numpy(zero_copy_only=False).astype(np.int64) + shift for x in ("gov", "dep"))
            match = np.repeat(np.arange(len(rows)), sizes)
            own = maps + np.repeat(first[rows], sizes)
            coded = words.dictionary_encode()
            leads = np.array([x in follow for x in coded.dictionary.to_pylist()] + [False])  # the last for null
            who, edge = surroundings(own, match, u, v, leads[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)])
            total = max(1, len(words))
            order = np.lexsort((edge, who))
            who, edge = who[order], edge[order]
            places = np.unique(np.concatenate([match * total + own, who * total + u[edge], who * total + v[edge]]))
            begin = np.searchsorted(places, np.arange(len(rows) + 1) * total)
            local = lambda k, x: np.searchsorted(places, k * total + x) - begin[k]
            ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            ints = lambda x: pa.array(x, pa.int32())
            names = [x for p in patterns for x in p.labels]
            label_first = np.cumsum([0] + [len(p.labels) for p in patterns])[ids]
            labels = pa.array(names, pa.string()).take(pa.array(ragged(label_first, sizes)))
            near = pa.StructArray.from_arrays([ints(local(who, u[edge])), decoded(arcs.field("rel").take(pa.array(edge))), ints(local(who, v[edge]))], names=["gov", "rel", "dep"])
            raw = ints(places % total - np.repeat(first[rows], np.diff(begin)))
            lists = [(ends(sizes), ints(maps)), (ends(sizes), labels), (ends(np.diff(begin)), raw), (ends(sizes), ints(local(match, own))), (ends(np.bincount(who, minlength=len(rows))), near)]
            names = ["pattern_id", "mapping", "labels", "places", "inside", "near"]
            if texts:
                lists += [(ends(np.diff(begin)), decoded(c.take(pa.array(places % total)))) for c in (words, batch.column("tokens").flatten())]
                names += ["tags", "tokens"]
            each = pa.StructArray.from_arrays([ints(ids), *[pa.ListArray.from_arrays(e, x) for e, x in lists]], names=names)
            some, counts = np.unique(rows, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(some)) for c in columns], pa.ListArray.from_arrays(ends(counts), each)], names=[*columns, "matches"])

    if texts:
        return sentences.then(run, schema)
    return narrowed(sentences, patterns).mapInArrow(run, schema)


PATTERNS = "pattern_id int, labels array<string>, edges array<struct<u:int,label:string,v:int>>, freq long"


def table(spark, patterns: list[Pattern]) -> DataFrame:
    """Patterns as rows, pattern_id being their place in the list."""
    return spark.createDataFrame([(k, list(p.labels), [tuple(e) for e in p.edges], p.freq) for k, p in enumerate(patterns)], PATTERNS)


def containment(spark, patterns: list[Pattern]) -> DataFrame:
    """(parent, child): the parent contains the child, has no fewer edges, and as many vertices or one more. The patterns are matched as sentences against their own library."""
    sizes = table(spark, patterns).select("pattern_id", F.size("labels").alias("n"), F.size("edges").alias("m"))
    arcs = F.transform("edges", lambda e: F.struct(e["u"].alias("gov"), e["label"].alias("rel"), e["v"].alias("dep")))
    graphs = table(spark, patterns).select(F.col("pattern_id").cast("string").alias("sid"), F.col("labels").alias("pos_tags"), arcs.alias("dependencies"))
    pairs = find(graphs.repartition(max(1, len(patterns) // 2000)), patterns, limit=1).select(F.col("sid").cast("int").alias("parent"), F.col("pattern_id").alias("child"))
    big, small = sizes.toDF("parent", "n", "m"), sizes.toDF("child", "k", "l")
    return pairs.where("parent <> child").join(big, "parent").join(small, "child").where("n - k BETWEEN 0 AND 1 AND m >= l").select("parent", "child")


def merged(patterns: DataFrame) -> DataFrame:
    """(labels, edges, freq): connected patterns (labels, edges, freq) with isomorphic ones summed, their smallest code being the key."""
    kind = "labels array<string>, edges array<struct<u:int,label:string,v:int>>, freq long"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                names = sorted({*r["labels"], *(e["label"] for e in r["edges"])})
                arcs = [(e["u"], names.index(e["label"]), e["v"]) for e in r["edges"]]
                if arcs:
                    code = smallest(tuple(map(names.index, r["labels"])), sorted(set(arcs)))
                    r = {"labels": [names[x] for x in code.labels], "edges": [{"u": u, "label": names[x], "v": v} for u, x, v in code.arcs()], "freq": r["freq"]}
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return patterns.select("labels", "edges", F.col("freq").cast("long").alias("freq")).mapInArrow(run, kind).groupBy("labels", "edges").agg(F.sum("freq").alias("freq"))
