"""Eventualities: canonical, hash-identified events from pattern matches in parsed sentences.

Sentences come with their matches as an array (pattern_index.matched); a match is a row, and what becomes of it are columns.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import let
from ..functions.vocab import OPTIONAL_POS_TAGS
from .matching import Pattern, ordered, separators, within_clause
from .parsing import Annotated, decoded
from .pattern_index import containment, matched
from .subgraphs import ragged

DEPS = "array<struct<gov:int,rel:string,dep:int>>"
MENTIONS = "array<struct<start:int,end:int,text:string,ner:string>>"
SCHEMA = (
    f"eid string, pattern string, words array<string>, pos_tags array<string>, ners array<string>, dependencies {DEPS}, "
    "skeleton_indices array<int>, skeleton_dependency_indices array<int>, verb_indices array<int>, raw_places array<int>, "
    f"segments array<array<int>>, mentions {MENTIONS}, frequency double"
)


def ints() -> Column:
    return F.array().cast("array<int>")


def places_of(deps: Column) -> Column:
    """The vertices of edges, in order, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(deps, lambda d: F.array(d["gov"], d["dep"])))))


def rank_in(places: Column, x: Column) -> Column:
    return (F.array_position(places, x) - 1).cast("int")


def optional_edges(deps: Column, tags: Column, inside: Column) -> Column:
    """Edges to optional words that aren't in the match."""
    return F.filter(deps, lambda d: F.get(tags, d["dep"]).isin(*OPTIONAL_POS_TAGS) & ~F.array_contains(inside, d["dep"]))


def optional_closure(edges: Column, inside: Column, transitive: bool) -> Column:
    """Optional words that depend on the match; with transitive also those that depend on them, and so on until none is added.

    edges are those to optional words, so that the rounds are at most as many; a round after the last addition does nothing.
    """
    reached = lambda e, known: F.array_distinct(F.transform(F.filter(e, lambda d: F.array_contains(known, d["gov"])), lambda d: d["dep"]))
    if not transitive:
        return let(edges, lambda e: reached(e, inside))

    def rounds(e: Column) -> Column:
        start = F.struct(ints().alias("found"), F.lit(True).alias("more"))
        step = lambda a, _: F.when(a["more"], let(reached(e, F.concat(inside, a["found"])), lambda now: F.struct(now.alias("found"), (F.size(now) > F.size(a["found"])).alias("more")))).otherwise(a)
        return F.aggregate(e, start, step)["found"]

    return let(edges, rounds)


def escaped(word: Column) -> Column:
    """A string as JSON with ASCII escapes, quotes included."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r", 34: '"', 92: "\\"}
        out = F.when(n.between(32, 126) & ~n.isin(34, 92), c)
        for k, x in short.items():
            out = out.when(n == k, F.lit(f"\\{x}"))
        return out.when(n < 65536, code(n)).otherwise(F.concat(code(F.lit(0xD800) + F.shiftright(n - 65536, 10)), code(F.lit(0xDC00) + (n - 65536) % 1024)))

    plain = word.rlike(r"^[ !#-\[\]-~]*$")
    return F.concat(F.lit('"'), F.when(plain, word).otherwise(F.array_join(F.transform(F.split(word, ""), one), "")), F.lit('"'))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def eid(words: Column, tags: Column, deps: Column) -> Column:
    """sha1 of the rendered dependencies, words and tags, as JSON with the usual separators and ASCII escapes."""

    def shown(w: Column, t: Column) -> Column:
        end = lambda i: listed(F.array(i.cast("string"), F.get(w, i), F.get(t, i)))
        arcs = F.transform(deps, lambda d: listed(F.array(end(d["gov"]), escaped(d["rel"]), end(d["dep"]))))
        return F.sha1(listed(F.array(listed(arcs), listed(w), listed(t))))

    return let(F.struct(F.transform(words, escaped).alias("w"), F.transform(tags, escaped).alias("t")), lambda x: shown(x["w"], x["t"]))


def segments(n: Column, deps: Column) -> Column:
    """Words in groups: compounds, head first, and other words alone, in the order of heads.

    The compound edges make a graph; each of its components falls into runs of neighbouring words, and each run is a
    group. Its head is the first of its words that governs another one of it and depends on none, else its first word; the
    others follow in order. Components by the smallest number that neighbours hand on, as often as there are edges at most.
    """
    every = F.sequence(F.lit(0), n - 1)
    alone = F.transform(every, lambda i: F.array(i))

    def grouped(edges: Column) -> Column:
        touched = places_of(edges)

        def spread(a: Column, _: Column) -> Column:
            near = lambda t, i: F.least(t, F.coalesce(F.array_min(F.transform(F.filter(edges, lambda d: (d["gov"] == i) | (d["dep"] == i)), lambda d: F.least(F.get(a["t"], d["gov"]), F.get(a["t"], d["dep"])))), t))
            return F.when(a["more"], let(F.transform(a["t"], near), lambda now: F.struct(now.alias("t"), (now != a["t"]).alias("more")))).otherwise(a)

        def runs(t: Column) -> Column:
            starts = F.filter(every, lambda i: ~F.array_contains(touched, i) | ~F.array_contains(touched, i - 1) | (F.get(t, i) != F.get(t, i - 1)))

            def group(i: Column, k: Column) -> Column:
                following = F.coalesce(F.get(starts, k + 1), n)
                members = F.sequence(i, following - 1)

                def headed(m: Column) -> Column:
                    inner = F.filter(edges, lambda d: F.array_contains(m, d["gov"]) & F.array_contains(m, d["dep"]))
                    free = let(inner, lambda e: F.filter(m, lambda x: F.exists(e, lambda d: d["gov"] == x) & ~F.exists(e, lambda d: d["dep"] == x)))
                    return let(F.coalesce(F.get(free, 0), i), lambda head: F.concat(F.array(head), F.filter(m, lambda x: x != head)))

                return F.when(following - i == 1, F.array(i)).otherwise(let(members, headed))

            return F.array_sort(F.transform(starts, group))

        return let(F.aggregate(edges, F.struct(every.alias("t"), F.lit(True).alias("more")), spread)["t"], runs)

    return let(F.filter(deps, lambda d: d["rel"].startswith("compound")), lambda e: F.when(F.size(e) == 0, alone).otherwise(grouped(e)))


def with_words(found: DataFrame, matches: Column) -> DataFrame:
    """A row (sid, place, m) for each match; m has the tags, lemmas, entity types and mentions of its places. Matches that come with their tokens have these as lemmas, and neither entities nor mentions."""
    at = lambda m, c: F.transform(m["places"], lambda i: F.get(F.col(c), i))
    said = lambda m: F.filter("mentions", lambda x: F.array_contains(m["places"], x["start"]) & F.array_contains(m["places"], x["end"] - 1))
    kept = ("pattern_id", "mapping", "labels", "places", "inside", "near")
    if "pos_tags" not in found.columns:
        bare = F.transform(matches, lambda m: F.struct(*[m[c].alias(c) for c in kept], m["tags"].alias("tags"), m["tokens"].alias("lemmas"), F.transform(m["tags"], lambda t: F.lit("O")).alias("ners"), F.array().cast(MENTIONS).alias("mentions")))
        return found.select("sid", F.posexplode(bare).alias("place", "m"))
    full = F.transform(matches, lambda m: F.struct(*[m[c].alias(c) for c in kept], at(m, "pos_tags").alias("tags"), at(m, "lemmas").alias("lemmas"), at(m, "ners").alias("ners"), said(m).alias("mentions")))
    return found.select("sid", F.posexplode(full).alias("place", "m"))


def event(m: Column, transitive: bool) -> Column:
    """The event of a match as an array: none if no edge of it is left. Each step is bound, so that it is computed once."""
    near, tags = m["near"], m["tags"]
    numbers = lambda items, good: F.filter(F.transform(items, lambda x, i: F.when(good(x), i)), lambda i: i.isNotNull())

    def written(own: Column, arcs: Column, bones: Column, skeleton: Column) -> Column:
        pick = lambda c: F.transform(own, lambda i: F.get(c, i))
        deps = F.transform(arcs, lambda d: F.struct(d["gov"].alias("gov"), d["rel"].alias("rel"), d["dep"].alias("dep")))
        base = F.struct(F.transform(pick(m["lemmas"]), F.lower).alias("words"), pick(tags).alias("tags"), pick(m["ners"]).alias("ners"), pick(m["places"]).alias("raw_places"), deps.alias("deps"))

        def full(e: Column) -> Column:
            rank = lambda x: rank_in(e["raw_places"], x)
            spans = F.transform(m["mentions"], lambda x: F.struct(rank(x["start"]).alias("start"), (rank(x["end"] - 1) + 1).alias("end"), x["ner"].alias("ner")))
            said = F.transform(F.filter(spans, lambda x: (x["start"] >= 0) & (x["end"] > 0)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_join(F.slice(e["words"], x["start"] + 1, F.greatest(x["end"] - x["start"], F.lit(0))), " ").alias("text"), x["ner"].alias("ner")))
            shown = F.transform(F.array_sort(F.arrays_zip(m["mapping"].alias("at"), m["labels"].alias("label"))), lambda x: x["label"])
            return F.struct(
                eid(e["words"], e["tags"], e["deps"]).alias("eid"), F.array_join(shown, " ").alias("pattern"), e["words"].alias("words"), e["tags"].alias("pos_tags"), e["ners"].alias("ners"), e["deps"].alias("dependencies"),
                F.transform(skeleton, lambda x: rank_in(own, x)).alias("skeleton_indices"), numbers(arcs, lambda d: F.array_contains(bones, d)).alias("skeleton_dependency_indices"),
                numbers(e["tags"], lambda t: t.startswith("VB")).alias("verb_indices"), e["raw_places"].alias("raw_places"), segments(F.size(e["words"]), e["deps"]).alias("segments"), said.cast(MENTIONS).alias("mentions"), F.lit(1.0).alias("frequency"),
            )

        return let(base, full)

    def renumbered(c: Column) -> Column:
        def ranked(own: Column) -> Column:
            ranks = lambda deps: F.array_sort(F.array_distinct(F.transform(deps, lambda d: F.struct(rank_in(own, d["gov"]).alias("gov"), rank_in(own, d["dep"]).alias("dep"), d["rel"].alias("rel")))))
            return let(F.struct(ranks(c["chosen"]).alias("arcs"), ranks(c["bones"]).alias("bones"), places_of(c["bones"]).alias("skeleton")), lambda r: written(own, r["arcs"], r["bones"], r["skeleton"]))

        return let(places_of(c["chosen"]), ranked)

    def left(c: Column) -> Column:
        first = F.get(places_of(c["chosen"]), 0)

        def without(gone: Column) -> Column:
            kept = lambda deps: F.filter(deps, lambda d: (d["gov"] != gone) & (d["dep"] != gone))
            return F.struct(kept(c["chosen"]).alias("chosen"), kept(c["bones"]).alias("bones"))

        return let(let(first, lambda f: F.when(F.get(tags, f) == "IN", f).otherwise(-1)), without)

    def of_match(inside: Column) -> Column:
        both = lambda d: F.array_contains(inside, d["gov"]) & F.array_contains(inside, d["dep"])

        def chosen(b: Column) -> Column:
            more = F.filter(b["optional"], lambda d: F.array_contains(b["reach"], d["gov"]) & F.array_contains(b["extra"], d["dep"]))
            return F.struct(F.concat(b["bones"], more).alias("chosen"), b["bones"].alias("bones"))

        def reached(edges: Column) -> Column:
            extra = optional_closure(edges, inside, transitive)
            return let(extra, lambda x: F.struct(edges.alias("optional"), x.alias("extra"), (F.concat(inside, x) if transitive else inside).alias("reach"), F.filter(near, both).alias("bones")))

        return let(let(let(optional_edges(near, tags, inside), reached), chosen), left)

    made = let(F.array_sort(m["inside"]), of_match)
    return let(made, lambda c: F.when(F.size(c["chosen"]) > 0, F.array(renumbered(c))).otherwise(F.array()))


def constructed(matches: DataFrame, transitive: bool) -> DataFrame:
    """matches (sid, place, m) of with_words() with the columns of SCHEMA; matches of which no edge is left have no row.

    The event of a match has the match's words, lower-cased lemmas, and the optional ones that depend on them, with the edges
    between and to them, renumbered. A leading preposition goes with its edges.
    """
    return matches.select("sid", "place", F.inline(event(F.col("m"), transitive)))


def chained(edges: list[tuple[int, int]], n: int) -> list[list[int]]:
    """segments() of n words for compound edges (gov, dep)."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for g, d in edges:
        up[max(top(g), top(d))] = min(top(g), top(d))
    touched, runs = {x for e in edges for x in e}, []
    for i in range(n):
        if i in touched and i - 1 in touched and top(i) == top(i - 1):
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for run in runs:
        inner = [(g, d) for g, d in edges if g in run and d in run]
        governs, depends = {g for g, _ in inner}, {d for _, d in inner}
        head = next((x for x in run if x in governs and x not in depends), run[0])
        out.append([head, *(x for x in run if x != head)])
    return sorted(out)


def rendered(words: list, tags: list, arcs: list) -> str:
    """eid() of words, tags and arcs (gov, rel, dep). As there, what is null is left out."""
    some = lambda *items: [x for x in items if x is not None]
    shown = [some([g, *some(words[g], tags[g])], r, [d, *some(words[d], tags[d])]) for g, r, d in arcs]
    return hashlib.sha1(json.dumps([shown, some(*words), some(*tags)]).encode()).hexdigest()


def open_matches(rows: np.ndarray, ids: np.ndarray, children: dict[int, list[int]]) -> np.ndarray:
    """Places of the matches whose pattern no earlier pattern of their sentence rules out; ids are in order within a sentence."""
    keep, row, barred = np.ones(len(rows), dtype=bool), -1, set()
    last = None
    for i, (r, k) in enumerate(zip(rows.tolist(), ids.tolist(), strict=True)):
        if r != row:
            row, barred, last = r, set(), None
        if k in barred and k != last:
            keep[i] = False
        elif k != last:
            barred.update(children.get(k, ()))
            last = k
    return np.flatnonzero(keep)


def written(batches, children: dict[int, list[int]], transitive: bool, shown: list[str]):
    """constructed() of batches (sid, matches) whose matches come with their tags and tokens: all matches of a batch together, on their flat lists.

    An edge is told by the places of its ends in the batch. Of a match's edges those within it are its bones; those that lead on to optional words are taken besides.
    """
    for batch in batches:
        rows = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        m = batch.column(1).flatten()
        if children:
            at = open_matches(rows, m.field("pattern_id").to_numpy(zero_copy_only=False), children)
            rows, m = rows[at], m.take(pa.array(at))
        total = len(m)
        sizes = lambda c: m.field(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ints = lambda x: pa.array(x, pa.int32())
        lists = lambda counts, x: pa.ListArray.from_arrays(ints(np.concatenate([[0], np.cumsum(counts)])), x)
        n = sizes("places")
        begin, whose = np.cumsum(n) - n, np.repeat(np.arange(total), n)
        raw = m.field("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tags, tokens = (m.field(c).flatten() for c in ("tags", "tokens"))
        kinds = tags.dictionary_encode()
        kind = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)
        is_ = lambda good: np.array([x is not None and good(x) for x in kinds.dictionary.to_pylist()] + [False])[kind]
        optional, leads, verb = is_(lambda t: t in OPTIONAL_POS_TAGS), is_(lambda t: t == "IN"), is_(lambda t: t.startswith("VB"))
        inside = np.zeros(len(raw), dtype=bool)
        inside[m.field("inside").flatten().to_numpy(zero_copy_only=False) + np.repeat(begin, sizes("inside"))] = True
        near = m.field("near").flatten()
        who = np.repeat(np.arange(total), sizes("near"))
        gov, dep = (near.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + begin[who] for c in ("gov", "dep"))
        rels = near.field("rel").dictionary_encode()
        names = sorted(x for x in rels.dictionary.to_pylist() if x is not None)
        number = np.array([names.index(x) if x is not None else -1 for x in rels.dictionary.to_pylist()] + [-1], dtype=np.int64)
        rel = number[pc.fill_null(rels.indices, -1).to_numpy(zero_copy_only=False)]
        bone = inside[gov] & inside[dep]
        chosen = bone | (optional[dep] & ~inside[dep] & (transitive | inside[gov]))
        first = np.full(total, len(raw))
        np.minimum.at(first, who[chosen], np.minimum(gov, dep)[chosen])
        gone = np.where(np.append(leads, False)[first], first, -1)[who]
        chosen &= (gov != gone) & (dep != gone)
        edges = np.stack([rel, dep, gov, who])[:, chosen]
        edges = edges[:, np.lexsort(edges)]
        edges = edges[:, np.append(True, (np.diff(edges, axis=1) != 0).any(axis=0))[: edges.shape[1]]]
        rel, dep, gov, who = edges
        bone = inside[gov] & inside[dep]
        used, skeleton = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
        used[gov] = used[dep] = True
        skeleton[gov[bone]] = skeleton[dep[bone]] = True
        own = np.flatnonzero(used)
        count, arcs = np.bincount(whose[own], minlength=total), np.bincount(who, minlength=total)
        start, arc_start = np.cumsum(count) - count, np.cumsum(arcs) - arcs
        rank = np.cumsum(used) - 1  # among own
        rank_in_own = rank - start[whose] if len(raw) else rank
        some = np.flatnonzero(arcs)
        words = [x if x is None else x.lower() for x in tokens.take(pa.array(own)).to_pylist()]
        said = tags.take(pa.array(own))
        g, d = rank_in_own[gov], rank_in_own[dep]
        relations = pa.array(names, pa.string()).take(pa.array(rel, mask=rel < 0))
        triples, tag_list = list(zip(g.tolist(), relations.to_pylist(), d.tolist(), strict=True)), said.to_pylist()
        eids, groups = [], []
        for s, k, a, c in zip(start[some].tolist(), count[some].tolist(), arc_start[some].tolist(), arcs[some].tolist(), strict=True):
            own_arcs = triples[a : a + c]
            eids.append(rendered(words[s : s + k], tag_list[s : s + k], own_arcs))
            if "segments" in shown:
                compound = [(x, y) for x, r, y in own_arcs if r is not None and r.startswith("compound")]
                groups.append(chained(compound, k) if compound else [[i] for i in range(k)])
        mapping, shape = m.field("mapping").flatten().to_numpy(zero_copy_only=False), sizes("mapping")
        labels = m.field("labels").flatten().take(pa.array(np.lexsort((mapping, np.repeat(np.arange(total), shape)))))
        of = lambda flags: lists(np.bincount(whose[flags], minlength=total)[some], ints(rank_in_own[flags]))
        bones = np.flatnonzero(bone)
        empty = pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("ner", pa.string())]))
        columns = {
            "eid": lambda: pa.array(eids, pa.string()), "pattern": lambda: pc.binary_join(lists(shape, labels), " ").take(pa.array(some)), "words": lambda: lists(count[some], pa.array(words, pa.string())), "pos_tags": lambda: lists(count[some], decoded(said)),
            "ners": lambda: lists(count[some], pa.array(["O"] * len(own), pa.string())), "dependencies": lambda: lists(arcs[some], pa.StructArray.from_arrays([ints(g), relations, ints(d)], names=["gov", "rel", "dep"])),
            "skeleton_indices": lambda: of(np.flatnonzero(skeleton)), "skeleton_dependency_indices": lambda: lists(np.bincount(who[bones], minlength=total)[some], ints(bones - arc_start[who[bones]])), "verb_indices": lambda: of(np.flatnonzero(used & verb)),
            "raw_places": lambda: lists(count[some], ints(raw[own])), "segments": lambda: pa.array(groups, pa.list_(pa.list_(pa.int32()))), "mentions": lambda: lists(np.zeros(len(some)), empty), "frequency": lambda: pa.array(np.ones(len(some))),
        }
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), ints(some), *[columns[c]() for c in shown]], names=["sid", "place", *shown])


def without_contained(events: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The events of each sentence whose skeletons lie in no other's and whose eid no other one has; with kept, only these columns.

    From the largest skeleton down, the earlier event first among equally large ones, an event stays unless its places
    are all in one that stays, or its eid is. Events are sorted by sentence and pass one by one; an event is compared with those that stay and
    have the place of its own that the fewest of them have, so that a sentence of many events is no square of them.
    """
    shown = [c for c in kept or events.columns if c not in ("sid", "place")]
    bones = F.transform("skeleton_indices", lambda k: F.get("raw_places", k))
    rows = events.select("sid", "place", bones.alias("__bones"), F.col("eid").alias("__eid"), *shown)
    rows = rows.repartition("sid").sortWithinPartitions("sid", -F.size("__bones"), "place", "__bones", "__eid")

    def run(batches):
        sentence, eids, at, some = object(), set(), {}, False  # at: by place, the skeletons that stay
        for batch in batches:
            stays = []
            for sid, own, eid_ in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if sid != sentence:
                    sentence, eids, at, some = sid, set(), {}, False
                own = frozenset(own)
                near = min((at.get(x, ()) for x in own), key=len, default=())
                good = not (eid_ in eids or (some and not own) or any(own <= k for k in near))
                if good:
                    some = True
                    if eid_ is not None:
                        eids.add(eid_)
                    for x in own:
                        at.setdefault(x, []).append(own)
                stays.append(good)
            yield batch.filter(pa.array(stays, pa.bool_())).select([0, *range(4, batch.num_columns)])

    return rows.mapInArrow(run, T.StructType([rows.schema["sid"], *rows.schema.fields[4:]]))


def ready(sentences: DataFrame, skip_words: tuple[str, ...] = ()) -> DataFrame:
    """(sid, lemmas, pos_tags, ners, mentions, dependencies) of the sentences that events come from."""
    has = set(sentences.columns)
    rows = sentences.where(F.size("dependencies") > 0)
    if "tokens" in has:
        rows = rows.where(F.col("tokens").isNotNull())
    if skip_words:
        rows = rows.where(~F.arrays_overlap("tokens", F.array(*map(F.lit, skip_words))))
    ners = F.coalesce("ners", F.transform("pos_tags", lambda t: F.lit("O"))) if "ners" in has else F.transform("pos_tags", lambda t: F.lit("O"))
    mentions = F.coalesce(F.col("mentions").cast(MENTIONS), F.array().cast(MENTIONS)) if "mentions" in has else F.array().cast(MENTIONS)
    return rows.select(F.col("sid").cast("string").alias("sid"), "lemmas", "pos_tags", ners.alias("ners"), mentions.alias("mentions"), "dependencies")


def descent(sentences: DataFrame, known: list[Pattern]) -> dict[int, list[int]]:
    """The children of each pattern; at most as many pairs as the library has come to the driver."""
    out: dict[int, list[int]] = {}
    if len(known) > 1:
        for r in containment(sentences.sparkSession, known).collect():
            out.setdefault(r["parent"], []).append(r["child"])
    return out


def below(children: dict[int, list[int]], pattern: Column) -> Column:
    """The children of the pattern, as a column."""
    if not children:
        return ints()
    lookup = F.create_map(*[x for k, c in children.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    return F.coalesce(F.get(F.array(F.element_at(lookup, pattern)), 0), ints())


def extract(sentences: DataFrame | Annotated, patterns: list[Pattern], skip_words: tuple[str, ...] = (), transitive: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """sid and a row for each event of every sentence; sentences with a skip word, or without dependencies, have none. kept: which columns of SCHEMA, all by default.

    Patterns are taken in order, the largest first; one that matches rules out its children. Matching is one map, all
    that follows are columns, and one shuffle by sentence drops the events that lie in others. Annotated texts are matched and their events
    written as they are parsed; their tokens are the lemmas.
    """
    known = ordered(patterns)
    if isinstance(sentences, Annotated) and skip_words:
        sentences = sentences.rows().withColumn("lemmas", F.col("tokens"))
    found = matched(sentences if isinstance(sentences, Annotated) else ready(sentences, skip_words), known)
    children = descent(sentences, known)
    if isinstance(sentences, Annotated):
        kind = T._parse_datatype_string(f"sid string, place int, {SCHEMA}")
        wanted = [f for f in kind.fields if not kept or f.name in ("sid", "place", "skeleton_indices", "raw_places", "eid", *kept)]
        names = [f.name for f in wanted[2:]]
        return without_contained(found.mapInArrow(lambda batches: written(batches, children, transitive, names), T.StructType(wanted)), [*kept] or None)
    matches = F.col("matches")
    if children:
        tried = F.array_distinct(F.transform("matches", lambda m: m["pattern_id"]))
        start = F.struct(ints().alias("open"), ints().alias("barred"))
        step = lambda a, k: F.when(F.array_contains(a["barred"], k), a).otherwise(F.struct(F.concat(a["open"], F.array(k)).alias("open"), F.concat(a["barred"], below(children, k)).alias("barred")))
        matches = let(F.aggregate(tried, start, step)["open"], lambda o: F.filter("matches", lambda m: F.array_contains(o, m["pattern_id"])))
    return without_contained(constructed(with_words(found, matches), transitive), [*kept] or None)


def merge(events: DataFrame) -> DataFrame:
    """One row for each eid: the first's words and tags, frequencies summed, sentences counted. Pre-aggregated before the shuffle."""
    return events.groupBy("eid").agg(
        F.min(F.struct("pattern", "words", "pos_tags")).alias("x"), F.sum("frequency").alias("frequency"), F.countDistinct("sid").alias("sentences")
    ).select("eid", "x.*", "frequency", "sentences")


def serialised(events: DataFrame) -> DataFrame:
    """(eid, value): events as JSON objects."""
    names = [f.name for f in T._parse_datatype_string(SCHEMA).fields]
    return events.select("eid", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def deserialised(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("value", SCHEMA).alias("x")).select("x.*")


def resolved(ids: DataFrame, events: DataFrame) -> DataFrame:
    """The events of the given eids; unknown ones have none."""
    return ids.select("eid").distinct().join(events, "eid")


def numbered(events: DataFrame, by: str = "position") -> DataFrame:
    """events with place, their rank within the sentence by mean place or by eid. A sentence's events are few: they lie in its words."""
    if by not in ("position", "eid"):
        raise NotImplementedError(by)
    mean = F.aggregate("raw_places", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("raw_places"), F.lit(1))
    order = [F.col("eid")] if by == "eid" else [mean, F.col("eid")]
    return events.withColumn("place", F.row_number().over(Window.partitionBy("sid").orderBy(*order)))


def from_texts(texts: DataFrame, patterns: list[Pattern], annotator=None, **settings) -> DataFrame:
    """Events of (sid, text): parsed by the annotator (parsing.annotate's own without one), then extracted."""
    from . import parsing

    parsed = parsing.annotate(texts) if annotator is None else parsing.annotate(texts, annotator)
    return extract(parsed, patterns, **settings)


def batch_match(sentences: DataFrame, patterns: list[Pattern], transitive: bool = True) -> DataFrame:
    """(sid, counts, events): for every sentence, patterns tried from the largest on until one has a match within a clause.

    counts: (pattern_id, matches), the matches within clauses of that pattern, and one for each of its children, which aren't
    tried; pattern_id is the place in matching.ordered(patterns). events: of all matches tried, also those across a
    separator, once for each eid. Sentences without a match have no row.
    """
    known = ordered(patterns)
    children = descent(sentences, known)
    found = matched(ready(sentences), known)
    valid = let(separators(F.col("pos_tags")), lambda stops: F.transform(F.filter("matches", lambda m: within_clause(m["mapping"], stops)), lambda m: m["pattern_id"]))
    good = found.withColumn("valid", valid)
    tried = good.withColumn("last", F.array_min("valid")).withColumn("matches", let(F.col("last"), lambda last: F.filter("matches", lambda m: last.isNull() | (m["pattern_id"] <= last))))
    own = F.struct(F.col("last").alias("pattern_id"), let(F.col("last"), lambda last: F.size(F.filter("valid", lambda k: k == last))).alias("matches"))
    rest = F.transform(below(children, F.col("last")), lambda k: F.struct(k.alias("pattern_id"), F.lit(1).alias("matches")))
    kind = "array<struct<pattern_id:int,matches:int>>"
    counts = tried.select("sid", F.when(F.col("last").isNotNull(), F.concat(F.array(own), rest)).otherwise(F.array().cast(kind)).alias("counts"))
    made = constructed(with_words(tried, F.col("matches")), transitive)
    names = [c for c in made.columns if c not in ("sid", "place")]
    once = made.groupBy("sid", "eid").agg(F.min_by(F.struct(*names), "place").alias("e"))
    events = once.groupBy("sid").agg(F.collect_list("e").alias("events"))
    none = F.array().cast(events.schema["events"].dataType)
    return counts.join(events, "sid", "left").select("sid", "counts", F.coalesce("events", none).alias("events"))


def batch_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("counts").alias("x")).groupBy("x.pattern_id").agg(F.sum("x.matches").alias("matches"))


def batch_events(found: DataFrame) -> DataFrame:
    return found.select("sid", F.explode("events").alias("x")).select("sid", "x.*")


def merge_all(events: DataFrame) -> DataFrame:
    """merge() with ners, the main entity type of each word, and mentions, the distinct ones of all occurrences; both as many as an event's words and texts allow."""
    kinds = main_entity(entity_counts(events)).groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("place", "ner"))).alias("k"))
    said = events.select("eid", F.explode("mentions").alias("m")).distinct().groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("m.start", "m.end", "m.text", "m.ner"))).alias("mentions"))
    both = merge(events).join(kinds, "eid", "left").join(said, "eid", "left")
    return both.select("eid", "pattern", "words", "pos_tags", "frequency", "sentences", F.transform("k", lambda x: x["ner"]).alias("ners"), F.coalesce("mentions", F.array()).alias("mentions"))


def entity_counts(events: DataFrame) -> DataFrame:
    """(eid, place, ner, n): how often each word of an event has each entity type, over its occurrences."""
    at = events.select("eid", "frequency", F.posexplode("ners").alias("place", "ner"))
    return at.groupBy("eid", "place", "ner").agg(F.sum("frequency").alias("n"))


def main_entity(counts: DataFrame) -> DataFrame:
    """(eid, place, ner): the most frequent type other than O, ties by name; O where there is no other."""
    best = F.max(F.when(F.col("ner") != "O", F.struct(F.col("n"), F.col("ner"))))
    return counts.groupBy("eid", "place").agg(F.coalesce(best["ner"], F.lit("O")).alias("ner"))


def normal_dependencies(deps: Column) -> Column:
    """For raw parses: without root edges, places from 0, no repeats, by governor and dependent."""
    kept = F.filter(deps, lambda d: (d["gov"] > 0) & (d["rel"] != "ROOT"))
    moved = F.transform(kept, lambda d: F.struct((d["gov"] - 1).alias("gov"), (d["dep"] - 1).alias("dep"), d["rel"].alias("rel")))
    return F.transform(F.array_sort(F.array_distinct(moved)), lambda d: F.struct(d["gov"].alias("gov"), d["rel"].alias("rel"), d["dep"].alias("dep")))
