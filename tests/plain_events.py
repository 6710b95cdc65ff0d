"""Events of one sentence in plain Python: what the columns of purposegraph.operators.extraction are tested against."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from purposegraph.functions.vocab import CLAUSE_SEPARATOR_PREFIX, CLAUSE_SEPARATOR_TAGS, OPTIONAL_POS_TAGS
from purposegraph.operators.matching import Graph, Pattern, matches, ordered, placed

Dep = tuple[int, str, int]


def sorted_dependencies(deps: list[Dep], reset: bool = True) -> tuple[list[Dep], dict[int, int], dict[int, int]]:
    """(dependencies without repeats by governor, dependent and label; place to rank; rank to place). With reset, ranks take the places' stead."""
    places = sorted({x for g, _, d in deps for x in (g, d)})
    rank = {x: i for i, x in enumerate(places)}
    out = sorted({(rank[g], r, rank[d]) if reset else (g, r, d) for g, r, d in deps}, key=lambda e: (e[0], e[2], e[1]))
    return out, rank, dict(enumerate(places))


def indices(deps: list[Dep]) -> list[int]:
    return sorted({x for g, _, d in deps for x in (g, d)})


def segments(n: int, deps: list[Dep]) -> list[tuple[int, ...]]:
    """Words in groups: compounds, head first, and other words alone, in the order of heads.

    The compound edges make a graph; each of its components falls into runs of neighbouring words, and each run is a
    group. Its head is the first of its words that governs another one of it and depends on none, else its first word; the
    others follow in order and have no group of their own. What is grouped depends on the edges alone, not on their order.
    """
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    pairs = {(g, d) for g, rel, d in deps if rel.startswith("compound")}
    for g, d in pairs:
        up[max(top(g), top(d))] = min(top(g), top(d))
    grouped = {x for pair in pairs for x in pair}
    groups: dict[int, tuple[int, ...]] = {i: (i,) for i in range(n) if i not in grouped}
    run: list[int] = []
    for i in sorted(grouped, key=lambda x: (top(x), x)) + [n + 1]:
        if run and (i != run[-1] + 1 or top(i) != top(run[-1])):
            inner = {(g, d) for g, d in pairs if g in run and d in run}
            free = [x for x in run if any(g == x for g, _ in inner) and all(d != x for _, d in inner)]
            head = free[0] if free else run[0]
            groups[head] = (head, *[x for x in run if x != head])
            run = []
        run.append(i)
    return [groups[i] for i in sorted(groups)]


@dataclass
class Eventuality:
    words: list[str]
    pos_tags: list[str]
    ners: list[str]
    dependencies: list[Dep]
    skeleton_indices: list[int]
    skeleton_dependency_indices: list[int]
    raw_places: list[int]
    pattern: str = ""
    mentions: list[dict] = field(default_factory=list)
    frequency: float = 1.0

    @property
    def eid(self) -> str:
        """sha1 of the rendered dependencies, words and tags, as JSON with the usual separators and ASCII escapes."""
        shown = [[[i, self.words[i], self.pos_tags[i]] if k != 1 else i for k, i in enumerate(d)] for d in self.dependencies]
        return hashlib.sha1(json.dumps([shown, self.words, self.pos_tags]).encode()).hexdigest()

    @property
    def verb_indices(self) -> list[int]:
        return [i for i, t in enumerate(self.pos_tags) if t.startswith("VB")]

    @property
    def phrases(self) -> list[str]:
        return [" ".join(self.words[i] for i in sorted(s)) for s in segments(len(self.words), self.dependencies)]

    @property
    def phrase_ners(self) -> list[str]:
        """Of each phrase the most frequent entity type other than O, the first on ties; O without one."""
        out = []
        for s in segments(len(self.words), self.dependencies):
            kinds = [self.ners[i] for i in sorted(s) if self.ners[i] != "O"]
            out.append(max(kinds, key=lambda k: (kinds.count(k), -kinds.index(k))) if kinds else "O")
        return out

    @property
    def position(self) -> float:
        return sum(set(self.raw_places)) / len(set(self.raw_places)) if self.raw_places else 0.0

    def entity_spans(self) -> list[tuple[int, int, str]]:
        """Maximal runs (start, end, type) of equal types other than O; verbs count as O."""
        kinds = ["O" if t.startswith("VB") else n for t, n in zip(self.pos_tags, self.ners, strict=True)]
        out: list[tuple[int, int, str]] = []
        for i, k in enumerate(kinds):
            if k == "O":
                continue
            if out and out[-1][1] == i and out[-1][2] == k:
                out[-1] = (out[-1][0], i + 1, k)
            else:
                out.append((i, i + 1, k))
        return out

    def __len__(self) -> int:
        return len(self.words)

    def __str__(self) -> str:
        return " ".join(self.words)

    #: What the other fields yield, left out of the shortest form.
    DERIVED = ("eid", "verb_indices", "segments")

    def to_dict(self, minimum: bool = False) -> dict:
        return {k: v for k, v in self.row().items() if not minimum or k not in self.DERIVED}

    @classmethod
    def from_dict(cls, d: dict) -> Eventuality:
        """The event of a full or shortest form; derived fields are derived again."""
        own = {k: v for k, v in d.items() if k not in cls.DERIVED}
        return cls(**own | {"dependencies": [(x["gov"], x["rel"], x["dep"]) for x in d["dependencies"]]})

    def encoded(self, minimum: bool = True) -> bytes:
        return json.dumps(self.to_dict(minimum)).encode()

    @classmethod
    def decoded(cls, data: bytes) -> Eventuality:
        return cls.from_dict(json.loads(data))

    def row(self) -> dict:
        return {
            "eid": self.eid, "pattern": self.pattern, "words": self.words, "pos_tags": self.pos_tags, "ners": self.ners,
            "dependencies": [{"gov": g, "rel": r, "dep": d} for g, r, d in self.dependencies], "skeleton_indices": self.skeleton_indices,
            "skeleton_dependency_indices": self.skeleton_dependency_indices, "verb_indices": self.verb_indices, "raw_places": self.raw_places,
            "segments": [list(s) for s in segments(len(self.words), self.dependencies)], "mentions": self.mentions, "frequency": self.frequency,
        }


def construct(sentence: dict, deps: list[Dep], skeleton: list[Dep], pattern: str = "") -> Eventuality | None:
    """The event that the dependencies span: lower-cased lemmas, renumbered. A leading preposition goes with its edges. None if nothing is left."""
    places = indices(deps)
    if places and sentence["pos_tags"][places[0]] == "IN":
        gone = places.pop(0)
        deps = [d for d in deps if gone not in (d[0], d[2])]
        skeleton = [d for d in skeleton if gone not in (d[0], d[2])]
    if not places or not deps:
        return None
    places = [p for p in places if p in set(indices(deps))]
    out, rank, _ = sorted_dependencies(deps)
    bones = {(rank[g], r, rank[d]) for g, r, d in skeleton}
    ners = sentence.get("ners") or ["O"] * len(sentence["pos_tags"])
    words = [sentence["lemmas"][i].lower() for i in places]
    mentions = []
    for m in sentence.get("mentions") or []:
        if m["start"] in rank and m["end"] - 1 in rank:
            a, b = rank[m["start"]], rank[m["end"] - 1] + 1
            mentions.append({"start": a, "end": b, "text": " ".join(words[a:b]), "ner": m.get("ner")})
    return Eventuality(
        words, [sentence["pos_tags"][i] for i in places], [ners[i] for i in places], out, [rank[i] for i in indices(skeleton)],
        [i for i, d in enumerate(out) if d in bones], places, pattern, mentions,
    )


def optional_closure(match: set[int], deps: list[Dep], tags: list[str], transitive: bool = True) -> set[int]:
    """Optional words that depend on the match; with transitive also those that depend on them, and so on."""
    out: set[int] = set()
    while True:
        more = {d for g, _, d in deps if (g in match or g in out) and d not in match and tags[d] in OPTIONAL_POS_TAGS} - out
        out |= more
        if not more or not transitive:
            return out


def from_match(sentence: dict, mapping: tuple[int, ...], pattern: Pattern, transitive: bool = True) -> Eventuality | None:
    deps = [tuple(d) for d in sentence["dependencies"]]
    inside = set(mapping)
    extra = optional_closure(inside, deps, sentence["pos_tags"], transitive)
    bones = [d for d in deps if d[0] in inside and d[2] in inside]
    chosen = bones + [d for d in deps if d not in bones and (d[0] in inside or (transitive and d[0] in extra)) and d[2] in extra]
    return construct(sentence, chosen, bones, " ".join(placed(pattern, mapping).labels))


def distinct(events: list[Eventuality]) -> list[Eventuality]:
    """The events, in their order, whose skeletons lie in no other's and whose eid no other kept one has.

    One pass from the largest skeleton down, the earlier event first among equally large ones; of equal skeletons and
    equal eids the first in that order stays, whatever else was dropped before.
    """
    places = [frozenset(e.raw_places[k] for k in e.skeleton_indices) for e in events]
    kept: dict[int, frozenset[int]] = {}
    for i in sorted(range(len(events)), key=lambda i: (-len(places[i]), i)):
        if not any(places[i] <= p for p in kept.values()) and events[i].eid not in {events[k].eid for k in kept}:
            kept[i] = places[i]
    return [events[i] for i in sorted(kept)]


def extract_sentence(sentence: dict, patterns: list[Pattern], children: dict[int, set[int]], transitive: bool = False) -> list[Eventuality]:
    """Events of one sentence: patterns in order; one that matches rules out its children; in order of mean place."""
    events: list[Eventuality] = []
    barred: set[int] = set()
    deps = [tuple(d) for d in sentence["dependencies"]]
    graph = Graph(sentence["pos_tags"], deps)
    for k, p in enumerate(patterns):
        if k in barred:
            continue
        found = matches(sentence["pos_tags"], deps, p, graph=graph)
        events += [e for m in found if (e := from_match(sentence, m, p, transitive)) is not None]
        if found:
            barred |= {k} | children.get(k, set())
    return sorted(distinct(events), key=lambda e: e.position)


def _separators(tags: list[str]) -> list[int]:
    return [i for i, t in enumerate(tags) if t in CLAUSE_SEPARATOR_TAGS or t.startswith(CLAUSE_SEPARATOR_PREFIX)]


def batch_sentence(r: dict, known: list[Pattern], children: dict[int, set[int]], transitive: bool = True) -> tuple[dict, list[Eventuality]]:
    deps = [tuple(d) for d in r["dependencies"]]
    stops = _separators(r["pos_tags"])
    counts: dict[int, int] = {}
    events: dict[str, Eventuality] = {}
    for k, p in enumerate(known):
        found = matches(r["pos_tags"], deps, p)
        for e in (from_match(r, m, p, transitive) for m in found):
            if e is not None:
                events.setdefault(e.eid, e)
        inside = [m for m in found if len(m) < 2 or not any(min(m) <= s <= max(m) for s in stops)]
        if inside:
            counts = {k: len(inside)} | {c: 1 for c in children.get(k, ())}
            break
    return counts, list(events.values())
