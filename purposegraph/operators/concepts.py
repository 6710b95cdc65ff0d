"""Conceptualization: words of an event replaced by seed concepts and taxonomy concepts, with scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.vocab import PERSON_PRONOUNS, SEED_NERS
from .taxonomy import with_scores

SEEDS = frozenset(f"__{n}__" for n in SEED_NERS)


def seeded(words: Column, ners: Column) -> Column:
    """Words with a seed entity type as __TYPE__k, k numbering the distinct words of the type by first appearance; person pronouns count as PERSON."""
    person = F.array(*map(F.lit, PERSON_PRONOUNS))
    kind = F.zip_with(words, ners, lambda w, n: F.when(n.isin(*SEED_NERS), n).when(F.array_contains(person, w), F.lit("PERSON")))

    def named(pairs: Column) -> Column:
        kinds = F.array_distinct(F.filter(F.transform(pairs, lambda p: p["k"]), lambda k: k.isNotNull()))
        of_kind = lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["w"]))
        numbers = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, of_kind(k))))

        def name(m: Column, p: Column) -> Column:
            number = (F.array_position(m[p["k"]], p["w"]) - 1).cast("string")
            return F.when(p["k"].isNull(), p["w"]).otherwise(F.concat(F.lit("__"), p["k"], F.lit("__"), number))

        return tx.let(numbers, lambda m: F.transform(pairs, lambda p: name(m, p)))

    return tx.let(F.arrays_zip(words.alias("w"), kind.alias("k")), named)


def word_concepts(taxonomy: DataFrame, k: int) -> DataFrame:
    """(instance, concept, score): the k likeliest concepts of each word, hyphened and distinct; ties by concept."""
    best = with_scores(taxonomy).select("instance", tx.hyphened(F.col("concept")).alias("concept"), "score").groupBy("instance", "concept").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("score"), "concept"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def replaceable(words: Column, tags: Column) -> Column:
    """Distinct lower-case nouns that are no seeds and no pronouns, in order."""
    barred = [*sorted(SEEDS), *PERSON_PRONOUNS, "it"]

    def wanted(p: Column) -> Column:
        first = F.substring(p["w"], 1, 1)
        return p["t"].startswith("NN") & (F.lower(first) == first) & (F.upper(first) != first) & ~p["w"].isin(*barred)

    return F.array_distinct(F.transform(F.filter(F.arrays_zip(words.alias("w"), tags.alias("t")), wanted), lambda p: p["w"]))


def replacements(words: Column, options: Column, limit: int) -> Column:
    """The limit best ways to replace one or more words, every place of a word alike: array<struct<s: product of scores, w: words, r: words replaced>>,
    by falling score, equal scores by falling words.

    options: array<struct<w: word, cs: array<struct<s, c>>>> of distinct words, scores in [0, 1]. A fold over the words keeps the
    limit best partial products (and one for the case that nothing is replaced). That loses none: whatever the later words become,
    a partial product that is dropped stays behind the limit kept ones, as scores multiply and the later places are the same.
    (Products that differ but become equal by rounding count as equal from then on.) So the work is words x limit x concepts, not all combinations.
    """
    start = F.array(F.struct(F.lit(1.0).alias("s"), words.alias("w"), F.lit(0).alias("r")))

    def put(p: Column, x: Column, o: Column) -> Column:
        new = F.zip_with(words, p["w"], lambda old, now: F.when(old == x["w"], o["c"]).otherwise(now))
        return F.struct((p["s"] * o["s"]).alias("s"), new.alias("w"), (p["r"] + 1).alias("r"))

    def grown(kept: Column, x: Column) -> Column:
        more = F.flatten(F.transform(kept, lambda p: F.transform(x["cs"], lambda o: put(p, x, o))))
        return F.slice(F.sort_array(F.concat(kept, more), asc=False), 1, limit + 1)

    return F.slice(F.filter(F.aggregate(options, start, grown), lambda p: p["r"] > 0), 1, limit)


def merged(by_word: Column, by_phrase: Column, limit: int) -> Column:
    """Two lists of ways as one by falling score, each text once; on equal scores the phrase's first. array<struct<s, text>>."""

    def marked(ways: Column, kind: int) -> Column:
        return F.transform(ways, lambda p, i: F.struct(F.array_join(p["w"], " ").alias("text"), (-p["s"]).alias("n"), F.lit(kind).alias("kind"), i.alias("i")))

    def once(rows: Column) -> Column:
        new = F.filter(rows, lambda p, i: (i == 0) | (p["text"] != F.get(rows, i - 1)["text"]))
        ranked = F.array_sort(F.transform(new, lambda p: F.struct(p["n"], p["kind"], p["i"], p["text"])))
        return F.transform(F.slice(ranked, 1, limit), lambda p: F.struct((-p["n"]).alias("s"), p["text"].alias("text")))

    return tx.let(F.array_sort(F.concat(marked(by_word, 1), marked(by_phrase, 0))), once)


def conceptualize(events: DataFrame, taxonomy: DataFrame, k: int = 3, start: int = 0, limit: int | None = None) -> DataFrame:
    """(eid, concept, cid, score) for every concept of every event (eid, words, ners, pos_tags, phrases, phrase_ners, phrase_tags).

    The first `start` tokens name no seeds and no words to replace. Concepts of the words that occur are joined by word, so the taxonomy
    is never broadcast or collected; the ways to replace words are array functions, the `limit` best (by default k ** k) of
    words and of phrases. An event without concepts is its own, with score 1; null lists count as empty, and eid should be unique.
    """
    top = min(limit or k**k, (1 << 31) - 2)
    lists = word_concepts(taxonomy, k).groupBy("instance").agg(F.collect_list(F.struct(F.col("score").alias("s"), F.col("concept").alias("c"))).alias("cs"))
    texts = ("words", "ners", "pos_tags", "phrases", "phrase_ners", "phrase_tags")
    rows = events.select("eid", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in texts])
    asked = rows.select("eid", F.explode(F.array_distinct(F.concat("words", "phrases"))).alias("instance"))
    known = asked.join(lists, "instance").groupBy("eid").agg(F.map_from_entries(F.collect_list(F.struct("instance", "cs"))).alias("known"))
    most = 1 << 30

    def named(words: str, ners: str) -> Column:
        tail = seeded(F.slice(words, start + 1, most), F.slice(ners, start + 1, most))
        return F.concat(F.slice(words, 1, start), tail) if start else tail

    def ways(words: str, tags: str) -> Column:
        asked = replaceable(F.slice(words, start + 1, most), F.slice(tags, start + 1, most))
        options = F.filter(F.transform(asked, lambda w: F.struct(w.alias("w"), F.col("known")[w].alias("cs"))), lambda x: x["cs"].isNotNull())
        return tx.let(F.col(words), lambda ws: tx.let(options, lambda xs: replacements(ws, xs, top)))

    ready = rows.join(known, "eid", "left").select("eid", "words", "phrases", "pos_tags", "phrase_tags", "known", named("words", "ners").alias("now"), named("phrases", "phrase_ners").alias("now_phrases"))
    texts_of = lambda x: F.transform(x, lambda p: F.struct(p["s"].alias("s"), F.array_join(p["w"], " ").alias("text")))
    found = ready.select("eid", "now", F.when(F.col("phrases") == F.col("words"), texts_of(ways("now", "pos_tags"))).otherwise(merged(ways("now", "pos_tags"), ways("now_phrases", "phrase_tags"), top)).alias("found"))
    own = F.array(F.struct(F.lit(1.0).alias("s"), F.array_join("now", " ").alias("text")))
    each = found.select("eid", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(own)).alias("x"))
    return each.select("eid", F.col("x.text").alias("concept"), F.sha1("x.text").alias("cid"), F.col("x.s").alias("score"))


def concept_table(pairs: DataFrame) -> DataFrame:
    """(cid, concept, score, instances): distinct instances (eid, pattern, score) and the sum of score times frequency; pairs carry pattern and frequency."""
    once = pairs.dropDuplicates(["cid", "eid", "pattern", "score"])
    return once.groupBy("cid", "concept").agg(F.sum(F.col("score") * F.col("frequency")).alias("score"), F.count("*").alias("instances"))


def pair_table(pairs: DataFrame) -> DataFrame:
    """pairs with pid, the sha1 of `cid$eid`; repeated pairs stay."""
    return pairs.withColumn("pid", F.sha1(F.concat("cid", F.lit("$"), "eid")))


def common_pattern(pairs: DataFrame) -> DataFrame:
    """(cid, pattern): each concept's most frequent pattern, ties by pattern. Two pre-aggregated steps."""
    counts = pairs.groupBy("cid", "pattern").agg(F.count("*").alias("n"))
    return counts.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("pattern").alias("p"))).alias("x")).select("cid", F.col("x.p").alias("pattern"))
