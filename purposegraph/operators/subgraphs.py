"""Frequent sub-graphs: minimal codes grown along the right-most path, a table of embeddings for each level.

A code writes a connected graph as steps of a depth-first walk. Each step adds an edge: forward to a new vertex, from any
vertex of the path from the first vertex to the last one, or back from the last vertex to that path. Of a graph's codes one is the
smallest, and its beginnings are the smallest codes of what they write, so growing smallest codes alone reaches each
sub-graph once. Level by level, the table of embeddings (a row for each sentence graph with the places of all
embeddings) is extended by the codes that have support, and supports are summed by key in a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .parsing import Annotated

#: (from, to, 1 if the edge leads that way and 0 if it leads back, edge label); `to` is new in a forward step.
Step = tuple[int, int, int, int]


@dataclass(frozen=True)
class Code:
    """Vertex labels by number, and steps. Labels are numbers in the order of their names."""

    labels: tuple[int, ...] = ()
    steps: tuple[Step, ...] = ()

    @property
    def tree(self) -> bool:
        return len(self.steps) < len(self.labels)

    def path(self) -> list[int]:
        """Vertices from the last one back to the first."""
        parent = {j: i for i, j, _, _ in self.steps if j > i}
        out = [len(self.labels) - 1]
        while out[-1]:
            out.append(parent[out[-1]])
        return out

    def with_step(self, step: Step, label: int) -> Code:
        return Code(self.labels + (label,) if step[1] == len(self.labels) else self.labels, (*self.steps, step))

    def arcs(self) -> list[tuple[int, int, int]]:
        """(governor, label, dependent)."""
        return sorted(((i, e, j) if out else (j, e, i) for i, j, out, e in self.steps), key=lambda a: (a[0], a[2], a[1]))


def rank(step: Step, label: int) -> tuple:
    """The order of steps that can follow the same ones: back before forward, from the deepest vertex on, then by direction and labels."""
    i, j, out, e = step
    return (0, j, out, e, 0) if j < i else (1, -i, out, e, label)


def twins(at: dict[int, list[tuple[int, int, int]]], labels) -> dict[int, int]:
    """For each vertex with a single edge the last one before it that has the same label and the same edge to the same vertex."""
    out, last = {}, {}
    for v in sorted(at):
        if len(at[v]) == 1:
            key = (*at[v][0], labels[v])
            if key in last:
                out[v] = last[key]
            last[key] = v
    return out


def smallest(labels: tuple[int, ...], arcs: list[tuple[int, int, int]], known: Code | None = None) -> Code | None:
    """The smallest code of a connected graph without loops; with known, None as soon as it can't be known.

    All embeddings of the smallest beginning are extended together. Leaves that can't be told apart are taken in one
    order only, so that they don't multiply embeddings.
    """
    at: dict[int, list[tuple[int, int, int]]] = {}
    for u, e, v in arcs:
        at.setdefault(u, []).append((v, 1, e))
        at.setdefault(v, []).append((u, 0, e))
    before = twins(at, labels)
    starts = [((labels[u], out, e, labels[v]), (u, v)) for u in at for v, out, e in at[u] if u not in before and v not in before]
    first = min(k for k, _ in starts)
    code = Code((first[0], first[3]), ((0, 1, first[1], first[2]),))
    if known and (code.labels, code.steps) != (known.labels[:2], known.steps[:1]):
        return None
    found = [m for k, m in starts if k == first]
    while len(code.steps) < len(arcs):
        path, n = code.path(), len(code.labels)
        used = {(i, j, out, e) for i, j, out, e in code.steps} | {(j, i, 1 - out, e) for i, j, out, e in code.steps}
        best, following = None, []
        for m in found:
            number = {x: i for i, x in enumerate(m)}
            for i in path:
                for y, out, e in at[m[i]]:
                    j = number.get(y, n)
                    if j < n:
                        if i != n - 1 or j not in path or (i, j, out, e) in used:
                            continue
                    elif y in before and before[y] not in number:
                        continue
                    key = rank((i, j, out, e), labels[y])
                    if best is None or key < best[0]:
                        best, following = (key, (i, j, out, e), labels[y]), []
                    if key == best[0]:
                        following.append(m if j < n else (*m, y))
        code, found = code.with_step(best[1], best[2]), list(dict.fromkeys(following))
        k = len(code.steps)
        if known and (code.labels != known.labels[: len(code.labels)] or code.steps != known.steps[:k]):
            return None
    return code


def minimal(code: Code) -> bool:
    return smallest(code.labels, code.arcs(), code) is not None


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), then those from starts[1] on, and so on."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, dtype=np.int64)


def blobs(flat: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Lists of 32-bit numbers, flat with the size of each, as the bytes that Spark moves whole instead of number by number."""
    ends = 4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if ends[-1] >= 1 << 31:
        raise OverflowError("a batch's graphs or embeddings exceed 2 GB; set spark.sql.execution.arrow.maxRecordsPerBatch lower")
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, dtype=np.int32))])


def unblobbed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat, sizes) of blobs()."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.int32, count=int(ends[-1] - ends[0]) // 4, offset=int(ends[0])) if ends[-1] > ends[0] else np.zeros(0)
    return flat.astype(np.int64), np.diff(ends) // 4


class Graphs:
    """The graphs of a batch end to end: vertices numbered through, edges sorted by the vertex they are seen from.

    A graph comes as one list (blobs): the number of vertices, their labels, and (governor, relation, dependent) of each edge.
    kept: sorted keys of the edges that matter; others are left out.
    """

    def __init__(self, column: pa.BinaryArray, names: int, kept: np.ndarray | None = None):
        flat, sizes = unblobbed(column)
        begin = np.cumsum(sizes) - sizes
        n = flat[begin] if len(begin) else begin
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.row = np.repeat(np.arange(len(n)), n)
        self.label = flat[ragged(begin + 1, n)]
        m = (sizes - 1 - n) // 3
        edge = flat[ragged(begin + 1 + n, 3 * m)].reshape(-1, 3)
        shift = np.repeat(self.first[:-1], m)
        u, v, e = edge[:, 0] + shift, edge[:, 2] + shift, edge[:, 1]
        a, b, e, out = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([e, e]), np.repeat([1, 0], len(u))
        some = a != b
        if kept is not None:
            some &= among(edge_key(self.label[a], out, e, self.label[b], names), kept) | among(edge_key(self.label[b], 1 - out, e, self.label[a], names), kept)
        a, b, e, out = a[some], b[some], e[some], out[some]
        order = np.argsort(a, kind="stable")
        self.a, self.b, self.e, self.out = a[order], b[order], e[order], out[order]
        self.start = np.searchsorted(self.a, np.arange(len(self.label) + 1))
        leaf = np.flatnonzero(np.diff(self.start) == 1)
        at = self.start[leaf]
        keys = np.stack([leaf, self.label[leaf], self.out[at], self.e[at], self.b[at]])
        sort = np.lexsort(keys)
        same = (np.diff(keys[1:, sort], axis=1) == 0).all(axis=0)
        self.twin = np.full(len(self.label), -1, dtype=np.int64)
        self.twin[leaf[sort][1:][same]] = leaf[sort][:-1][same]

    def seen_from(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, place of an edge) of all edges at the vertices x."""
        sizes = self.start[x + 1] - self.start[x]
        return np.repeat(np.arange(len(x)), sizes), ragged(self.start[x], sizes)


def edge_key(a, out, e, b, names: int) -> np.ndarray:
    return ((a * 2 + out) * names + e) * names + b


def among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, keys)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == keys) if len(ordered) else np.zeros(len(keys), dtype=bool)


class Codes:
    """The codes of a level as arrays, and the keys of their extensions."""

    def __init__(self, codes: list[Code], names: int, most: int):
        self.codes, self.names, self.most, self.width = codes, names, most, most + 1
        self.size = np.array([len(c.labels) for c in codes], dtype=np.int64)
        self.tree = np.array([c.tree for c in codes], dtype=bool)
        self.on_path = np.zeros((len(codes), self.width), dtype=bool)
        self.up = np.zeros((len(codes), 3), dtype=np.int64)  # of the last vertex: its parent, and the edge as seen from it
        for k, c in enumerate(codes):
            self.on_path[k, c.path()] = True
            i, _, out, e = next(s for s in reversed(c.steps) if s[1] == len(c.labels) - 1 and s[1] > s[0])
            self.up[k] = i, 1 - out, e

    def key(self, code, i, j, out, e, label) -> np.ndarray:
        return ((((code * self.width + i) * self.width + j) * 2 + out) * self.names + e) * (self.names + 1) + label

    def of_key(self, key: int) -> Code:
        key, label = divmod(key, self.names + 1)
        key, e = divmod(key, self.names)
        key, out = divmod(key, 2)
        key, j = divmod(key, self.width)
        code, i = divmod(key, self.width)
        return self.codes[code].with_step((i, j, out, e), label)

    def extensions(self, g: Graphs, code: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedding, key, new vertex or -1) of all extensions by one edge."""
        found = []
        for i in range(places.shape[1]):
            own = np.flatnonzero(self.on_path[code, i])
            r, at = g.seen_from(places[own, i])
            m = own[r]
            c, b, out, e = code[m], g.b[at], g.out[at], g.e[at]
            here = places[m] == b[:, None]
            met = here.any(axis=1)
            twin = g.twin[b]
            new = ~met & (self.size[c] < self.most)
            late = np.flatnonzero(new & (twin >= 0))
            new[late] = (places[m[late]] == twin[late][:, None]).any(axis=1)
            found.append((m[new], self.key(c[new], i, self.size[c[new]], out[new], e[new], g.label[b[new]]), b[new]))
            back = np.flatnonzero(met & self.tree[c] & (self.size[c] == i + 1))
            if len(back):
                cb, j = c[back], here[back].argmax(axis=1)
                fits = self.on_path[cb, j] & ~((self.up[cb, 0] == j) & (self.up[cb, 1] == out[back]) & (self.up[cb, 2] == e[back]))
                back, cb, j = back[fits], cb[fits], j[fits]
                found.append((m[back], self.key(cb, i, j, out[back], e[back], self.names), np.full(len(back), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


class Sums:
    """Weights by key, gathered in a task."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def add(self, row: np.ndarray, key: np.ndarray, weight: np.ndarray) -> None:
        """Each graph counts once for a key."""
        if not len(key):
            return
        number, keys = pd.factorize(key)
        pairs = pd.unique(row * len(keys) + number)
        self.keys.append(keys)
        self.sums.append(np.bincount(pairs % len(keys), weights=weight[pairs // len(keys)], minlength=len(keys)).astype(np.int64))
        if len(self.keys) >= 64:
            keys, sums = self.total()
            self.keys, self.sums = [keys], [sums]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        number, keys = pd.factorize(np.concatenate(self.keys))
        return keys, np.bincount(number, weights=np.concatenate(self.sums), minlength=len(keys)).astype(np.int64)


LEVEL = "graph binary, weight long, code binary, places binary, key long, freq long"


def level_batch(graph, weight, row: np.ndarray, code: np.ndarray, places: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """The graphs that have embeddings, with these."""
    order = np.argsort(row, kind="stable")
    row, code, places = row[order], code[order], places[order]
    sizes = np.bincount(row, minlength=len(graph))
    some = np.flatnonzero(sizes)
    local = np.where(places < 0, -1, places - first[row][:, None]).reshape(-1)
    take, none = pa.array(some), pa.nulls(len(some), pa.int64())
    columns = [graph.take(take), weight.take(take), blobs(code, sizes[some]), blobs(local, sizes[some] * places.shape[1]), none, none]
    return pa.RecordBatch.from_arrays(columns, names=["graph", "weight", "code", "places", "key", "freq"])


def sums_batch(sums: Sums) -> pa.RecordBatch:
    keys, freq = sums.total()
    none = pa.nulls(len(keys), pa.binary())
    return pa.RecordBatch.from_arrays([none, pa.nulls(len(keys), pa.int64()), none, none, pa.array(keys, pa.int64()), pa.array(freq, pa.int64())], names=["graph", "weight", "code", "places", "key", "freq"])


GRAPH = "graph binary, weight long, length int, linked boolean, names string"


def flat_graphs(n: np.ndarray, label: np.ndarray, m: np.ndarray, u: np.ndarray, e: np.ndarray, v: np.ndarray) -> pa.BinaryArray:
    """Graphs of n vertices and m edges as blobs: the number of vertices, their labels, and (governor, relation, dependent) of each edge."""
    size = 1 + n + 3 * m
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), dtype=np.int32)
    flat[begin] = n
    flat[ragged(begin + 1, n)] = label
    at = ragged(begin + 1 + n, 3 * m).reshape(-1, 3)
    for k, values in enumerate((u, e, v)):
        flat[at[:, k]] = values
    return blobs(flat, size)


def numbers(column: pa.Array, number: dict[str, int], form=lambda x: x) -> np.ndarray:
    coded = column.dictionary_encode()
    to = np.array([number[form(x)] for x in coded.dictionary.to_pylist()], dtype=np.int64)
    return to[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else to


def rows_named(graph: pa.BinaryArray, weight: pa.Array, n: np.ndarray, m: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([graph, weight, pa.array(n, pa.int32()), pa.array(m > 0), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(graph)), pa.int32()), pa.array([json.dumps(names)])).dictionary_decode()], names=["graph", "weight", "length", "linked", "names"])


def coded(weighted: DataFrame) -> DataFrame:
    """(graph, weight, length, linked, names): labelled graphs (labels, edges (u, label, v), weight) as blobs of numbers, their vertices, whether they have edges, and which names the numbers are in a batch, as JSON."""

    def run(batches):
        for batch in batches:
            labels, edges = batch.column(0), batch.column(1)
            n, m = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (labels, edges))
            labels, arcs = labels.flatten(), edges.flatten()
            names = sorted({*labels.unique().to_pylist(), *arcs.field("label").unique().to_pylist()})
            number = {x: i for i, x in enumerate(names)}
            graph = flat_graphs(n, numbers(labels, number), m, arcs.field("u").to_numpy(zero_copy_only=False), numbers(arcs.field("label"), number), arcs.field("v").to_numpy(zero_copy_only=False))
            yield rows_named(graph, batch.column(2), n, m, names)

    return weighted.select("labels", "edges", F.col("weight").cast("long").alias("weight")).mapInArrow(run, GRAPH)


def coded_texts(texts: Annotated) -> DataFrame:
    """coded() of the parses' graphs, made in the task that parses them: weight 1, relations up to their colon, each edge once."""

    def run(batches):
        for batch in batches:
            tags, deps = batch.column("pos_tags"), batch.column("dependencies")
            n, m = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (tags, deps))
            labels, arcs = tags.flatten().dictionary_encode(), deps.flatten()
            rels = arcs.field("rel").dictionary_encode()
            plain = lambda x: x.partition(":")[0]
            names = sorted({*labels.dictionary.to_pylist(), *map(plain, rels.dictionary.to_pylist())})
            number = {x: i for i, x in enumerate(names)}
            row = np.repeat(np.arange(len(m)), m)
            edges = np.stack([numbers(rels, number, plain), *(arcs.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("dep", "gov")), row])
            edges = edges[:, np.lexsort(edges)]
            edges = edges[:, np.append(True, (np.diff(edges, axis=1) != 0).any(axis=0))[: edges.shape[1]]]
            m = np.bincount(edges[3], minlength=len(m))
            yield rows_named(flat_graphs(n, numbers(labels, number), m, edges[2], edges[0], edges[1]), pa.array(np.ones(len(n)), pa.int64()), n, m, names)

    return texts.then(run, GRAPH)


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(graph, weight): rows of coded() that have edges, numbered by names, equal ones once."""
    number = {x: i for i, x in enumerate(names)}

    def run(batches):
        for batch in batches:
            own = batch.column(2).dictionary_encode()
            lists = [json.loads(x) for x in own.dictionary.to_pylist()]
            to = np.array([number[x] for names_ in lists for x in names_], dtype=np.int64)
            first = np.cumsum([0] + [len(x) for x in lists])
            flat, sizes = unblobbed(batch.column(0))
            begin = np.cumsum(sizes) - sizes
            n = flat[begin]
            m = (sizes - 1 - n) // 3
            shift = first[own.indices.to_numpy(zero_copy_only=False)] if len(own) else n
            edge = flat[ragged(begin + 1 + n, 3 * m)].reshape(-1, 3)
            graph = flat_graphs(n, to[flat[ragged(begin + 1, n)] + np.repeat(shift, n)], m, edge[:, 0], to[edge[:, 1] + np.repeat(shift, m)] if len(edge) else edge[:, 1], edge[:, 2])
            yield pa.RecordBatch.from_arrays([graph, batch.column(1)], names=["graph", "weight"])

    linked = rows.where("linked").select("graph", "weight", "names")
    return linked.mapInArrow(run, "graph binary, weight long").groupBy("graph").agg(F.sum("weight").alias("weight"))


def lengths(rows: DataFrame) -> DataFrame:
    """(length, n): how many of coded() have so many vertices."""
    return rows.groupBy("length").agg(F.sum("weight").alias("n"))


def first_level(graphs: DataFrame, names: int) -> DataFrame:
    """(key, freq) of single edges, by edge_key of the smaller way to write them."""

    def run(batches):
        sums = Sums()
        for batch in batches:
            g = Graphs(batch.column(0), names)
            key = edge_key(g.label[g.a], g.out, g.e, g.label[g.b], names)
            small = key <= edge_key(g.label[g.b], 1 - g.out, g.e, g.label[g.a], names)
            sums.add(g.row[g.a[small]], key[small], batch.column(1).to_numpy())
        keys, freq = sums.total()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(freq, pa.int64())], names=["key", "freq"])

    return graphs.mapInArrow(run, "key long, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))


def started(graphs: DataFrame, table: Codes, keys: np.ndarray) -> DataFrame:
    """The first level's embeddings, and the sums of their extensions."""
    names, order = table.names, np.argsort(keys)

    def run(batches):
        sums = Sums()
        for batch in batches:
            g = Graphs(batch.column(0), names, keys[order])
            key = edge_key(g.label[g.a], g.out, g.e, g.label[g.b], names)
            own = np.flatnonzero(among(key, keys[order]) & (g.twin[g.a] < 0) & (g.twin[g.b] < 0))
            code, places = order[np.searchsorted(keys[order], key[own])], np.stack([g.a[own], g.b[own]], axis=1)
            m, further, _ = table.extensions(g, code, places)
            sums.add(g.row[places[m, 0]], further, batch.column(1).to_numpy())
            yield level_batch(batch.column(0), batch.column(1), g.row[places[:, 0]], code, places, g.first)
        yield sums_batch(sums)

    return graphs.mapInArrow(run, LEVEL)


def grown(level: DataFrame, table: Codes, keys: np.ndarray, following: Codes, edges: np.ndarray, columns: int, last: bool = False) -> DataFrame:
    """The next level's embeddings: those of `level` extended by keys[k] are of code k of `following`; and the sums of their extensions. Of the last level only the sums."""
    order = np.argsort(keys)
    ordered = keys[order]

    def run(batches):
        sums = Sums()
        for batch in batches:
            g = Graphs(batch.column(0), table.names, edges)
            code, sizes = unblobbed(batch.column(2))
            row = np.repeat(np.arange(len(batch)), sizes)
            places = unblobbed(batch.column(3))[0].reshape(-1, columns)
            places = np.where(places < 0, -1, places + g.first[row][:, None])
            m, key, new = table.extensions(g, code, places)
            some = np.flatnonzero(among(key, ordered))
            m, key, new = m[some], key[some], new[some]
            wider = np.concatenate([places[m], np.full((len(m), 1), -1)], axis=1)
            forward = np.flatnonzero(new >= 0)
            wider[forward, table.size[code[m[forward]]]] = new[forward]
            own = order[np.searchsorted(ordered, key)]
            k, further, _ = following.extensions(g, own, wider)
            sums.add(row[m[k]], further, batch.column(1).to_numpy())
            if not last:
                yield level_batch(batch.column(0), batch.column(1), row[m], own, wider, g.first)
        yield sums_batch(sums)

    return level.where(F.col("graph").isNotNull()).mapInArrow(run, LEVEL)


def supported(sums: DataFrame, table: Codes, floors: list[int]) -> list[tuple[int, int]]:
    """(key, freq) of the extensions with the support that codes of their size need, if they are the smallest codes of what they write.

    They come to the driver: a graph adds its weight to each of its sub-graphs once, so that codes of at least a share s of
    all graphs are at most the mean number of sub-graphs over s.
    """
    codes = sums.groupBy("key").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min(floors))

    def run(batches):
        for batch in batches:
            keys, freq = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [f >= floors[len((c := table.of_key(k)).labels)] and minimal(c) for k, f in zip(keys, freq, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return [tuple(r) for r in codes.mapInArrow(run, "key long, freq long").collect()]


def frequent(weighted: DataFrame | Annotated, bounds) -> DataFrame:
    """(labels, edges, freq): connected sub-graphs of (labels, edges (u, label, v), weight) whose support lies within the bounds (vertices, least, most) of their size.

    A sub-graph has as many edges as vertices or one fewer; its support is the weight of the graphs that hold it. A
    sub-graph has at least the support of what contains it, so only codes grow that reach the least bound of the sizes
    to come. bounds may be a function that makes them of the graphs' numbers by size [(vertices, n)]. Of annotated texts the graphs are
    the parses, each with weight 1; the input is read once. Labels are numbered in the order of their smallest code. Tags and relations, and the frequent codes, come to the driver.
    Leaves of one vertex that can't be told apart are used in one order, so equal ones don't multiply embeddings.
    """
    spark, kind, scratch = weighted.sparkSession, "labels array<string>, edges array<struct<u:int,label:string,v:int>>, freq long", Scratch(weighted.sparkSession)
    rows = scratch.table(coded_texts(weighted) if isinstance(weighted, Annotated) else coded(weighted))
    if callable(bounds):
        bounds = bounds([(r["length"], r["n"]) for r in lengths(rows).collect()])  # one row for each length
    wanted = {size: (least, most) for size, least, most in bounds if size > 1}
    if not wanted:
        scratch.close()
        return spark.createDataFrame([], kind)
    most, out = max(wanted), []
    floors = [max(1, min(least for s, (least, _) in wanted.items() if s >= n)) for n in range(most + 1)]
    names = sorted(r[0] for r in rows.select("names").distinct().select(F.explode(F.from_json("names", "array<string>"))).distinct().collect())
    graphs = scratch.table(packed(rows, names))
    scratch.close(keep=1)
    n = len(names)

    def note(codes: list[Code], freqs: list[int]) -> None:
        for c, f in zip(codes, freqs, strict=True):
            low, high = wanted.get(len(c.labels), (1, 0))
            if low <= f <= high:
                out.append(([names[x] for x in c.labels], [(u, names[e], v) for u, e, v in c.arcs()], f))

    rows = [tuple(r) for r in first_level(graphs, n).where(F.col("freq") >= floors[2]).collect()]
    edges = np.sort(np.array([k for k, _ in rows], dtype=np.int64))
    keys, codes = np.array([k for k, _ in rows], dtype=np.int64), []
    for k, _ in rows:
        (k, b), a = divmod(k, n), 0
        k, e = divmod(k, n)
        a, way = divmod(k, 2)
        codes.append(Code((a, b), ((0, 1, way, e),)))
    note(codes, [f for _, f in rows])
    table = Codes(codes, n, most)
    level = scratch.table(started(graphs, table, keys)) if codes else None
    for steps in range(2, most + 1):  # edges of the codes to come
        rows = supported(level.where(F.col("key").isNotNull()).select("key", "freq"), table, floors) if codes else []
        if not rows:
            break
        keys, codes = np.array([k for k, _ in rows], dtype=np.int64), [table.of_key(k) for k, _ in rows]
        note(codes, [f for _, f in rows])
        if steps < most:
            following = Codes(codes, n, most)
            level, table = scratch.table(grown(level, table, keys, following, edges, steps, steps + 1 == most)), following
            scratch.close(keep=1)
    scratch.close()
    return spark.createDataFrame(out, kind)
