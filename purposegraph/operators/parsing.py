"""Assertions to sentences to parses: template suffixes, sentence ids, cleaning, splitting, and a pluggable annotator."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocab import ALIASES, MENTION_TYPES, PRONOUNS

PARSED = (
    "sid string, text string, tokens array<string>, lemmas array<string>, pos_tags array<string>, ners array<string>, "
    "mentions array<struct<start:int,end:int,text:string,ner:string>>, dependencies array<struct<gov:int,rel:string,dep:int>>"
)
EMPTY = {"text": ".", "tokens": ["."], "lemmas": ["."], "pos_tags": ["."], "ners": ["O"], "mentions": [], "dependencies": []}


@dataclass(frozen=True)
class Annotated:
    """Texts and the Arrow map that parses them, to batches of the schema, in which strings may be dictionary-coded.

    What follows on Arrow batches runs in the parse's own task (then), so that only what comes of the parses becomes rows.
    """

    texts: DataFrame
    parse: Callable
    schema: str

    @property
    def sparkSession(self):  # noqa: N802
        return self.texts.sparkSession

    def rows(self) -> DataFrame:
        return self.then(plain, self.schema)

    def then(self, run: Callable, schema) -> DataFrame:
        parse = self.parse
        return self.texts.mapInArrow(lambda batches: run(parse(batches)), schema)

    def count(self) -> int:
        """How many parses there are, none of which becomes a row."""
        return self.then(sizes, "n long").agg(F.sum("n")).first()[0] or 0


def decoded(column: pa.Array) -> pa.Array:
    """Without dictionaries, also inside lists and structs."""
    if pa.types.is_dictionary(column.type):
        return column.dictionary.take(column.indices)
    if pa.types.is_list(column.type):
        return pa.ListArray.from_arrays(column.offsets, decoded(column.values), mask=column.is_null() if column.null_count else None)
    if pa.types.is_struct(column.type) and not column.null_count:
        return pa.StructArray.from_arrays([decoded(column.field(i)) for i in range(column.type.num_fields)], names=[f.name for f in column.type])
    return column


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])


def plain(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([decoded(c) for c in batch.columns], names=batch.schema.names)


def relation_name(relation: Column) -> Column:
    """The relation with aliases resolved."""
    for alias, name in ALIASES.items():
        relation = F.when(relation == alias, name).otherwise(relation)
    return relation


def raw_sentences(assertions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences, rejects) of assertions (item_a_id, relation, item_b_id, assertion, row).

    Sentences (sid, text, and the parts of sid): the assertion from its relation's template on. Unknown relations are
    dropped; known ones whose template is missing are the rejects. The relation table has 21 rows.
    """
    known = assertions.withColumn("relation", relation_name(F.col("relation"))).join(F.broadcast(relations.select("relation", "template")), "relation")
    cut = known.withColumn("text", tx.from_template(F.col("assertion"), F.col("template")))
    sid = F.concat(F.concat_ws("-", F.col("item_a_id").cast("string"), "relation", F.col("item_b_id").cast("string")), F.lit("|"), F.col("row").cast("string"))
    ids = ["item_a_id", "relation", "item_b_id", "row"]
    return cut.where("text is not null").select(sid.alias("sid"), "text", *ids), cut.where("text is null").select(*ids, "assertion")


def sentence_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with a row for each cleaned sentence, numbered from 0 as `part`."""
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(tx.sentences(tx.cleaned(F.col(text)))).alias("part", text))


def wanted_mentions(mentions: Column) -> Column:
    """Mentions of the wanted types whose text is no pronoun."""
    return F.filter(mentions, lambda m: m["ner"].isin(*MENTION_TYPES) & ~F.lower(F.trim(m["text"])).isin(*PRONOUNS))


def simple_annotator(text: str) -> dict:
    """A light stand-in for a parser: tokens, lower-cased lemmas, tags by suffix and small word lists, and a chain of dependencies to the main verb.

    It makes demonstrations and tests run without a parser; real parses come as input or from an annotator of the caller's.
    """
    tokens = re.findall(r"\w+(?:'\w+)?|[^\w\s]", text)
    if not tokens:
        return dict(EMPTY)
    closed = {"the": "DT", "a": "DT", "an": "DT", "of": "IN", "in": "IN", "on": "IN", "for": "IN", "with": "IN", "to": "TO", "and": "CC", "or": "CC", "they": "PRP", "it": "PRP", "he": "PRP", "she": "PRP", "will": "MD", "could": "MD", "is": "VBZ", "are": "VBP", "was": "VBD", "both": "DT", "my": "PRP$", "your": "PRP$", "his": "PRP$"}
    tags = []
    for t in tokens:
        w = t.lower()
        if w in closed:
            tags.append(closed[w])
        elif not w[0].isalnum():
            tags.append("." if w in ".?!" else ",")
        elif w.isdigit():
            tags.append("CD")
        else:
            tags.append("VBG" if w.endswith("ing") else "VBD" if w.endswith("ed") else "RB" if w.endswith("ly") else "JJ" if w.endswith(("able", "ful", "ous")) else "NNS" if w.endswith("s") else "NN")
    head = next((i for i, t in enumerate(tags) if t.startswith("VB")), 0)
    names = {"DT": "det", "JJ": "amod", "RB": "advmod", "IN": "case", "MD": "aux", "TO": "mark", "CC": "cc", ".": "punct", ",": "punct", "PRP$": "nmod:poss"}
    deps = []
    for i, t in enumerate(tags):
        if i == head:
            continue
        noun = next((j for j in range(i + 1, len(tags)) if tags[j].startswith("NN")), None)
        gov = noun if t in ("DT", "JJ", "IN", "PRP$") and noun is not None else head
        deps.append({"gov": gov, "rel": names.get(t, "nsubj" if i < head else "dobj"), "dep": i})
    return {"text": text, "tokens": tokens, "lemmas": [t.lower() for t in tokens], "pos_tags": tags, "ners": ["NUMBER" if t == "CD" else "O" for t in tags], "mentions": [], "dependencies": sorted(deps, key=lambda d: (d["gov"], d["dep"]))}


def annotate(sentences: DataFrame, annotator=simple_annotator) -> DataFrame:
    """Parsed sentences of (sid, text); annotator: a picklable function from a text to a parse, run on Arrow batches. Empty texts give the empty parse."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(PARSED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [{"sid": s} | (annotator(t) if (t or "").strip() else dict(EMPTY)) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sentences.select(F.col("sid").cast("string"), "text").mapInArrow(run, schema)
