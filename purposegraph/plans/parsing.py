"""Queries on sentences, mining and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import extraction, matching, mining, parsing, pattern_index, subgraphs
from ..operators.matching import Pattern
from ..sources.shared import Scratch
from .tables import CASES, SENTENCES_SQL, parsed, sentences, table

PATH = Pattern(("DT", "NN", "VBG"), ((1, "det", 0), (1, "next", 2)))
FORK = Pattern(("NN", "IN", "NONE"), ((0, "next", 1), (1, "next", 2)))
TWO = Pattern(("NN", "VBD"), ((0, "next", 1),))
CHAIN = Pattern(("DT", "NN", "VBG", "NN"), ((1, "det", 0), (1, "next", 2), (2, "next", 3)))
DET = Pattern(("DT", "NN"), ((1, "det", 0),))
TEMPLATE = ["the", "of"]


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, rel = table(spark, sf_dir, "part"), F.broadcast(vocab.relations(spark))
    made = F.concat(F.lit("He bought it because "), F.when(F.col("p_partkey") % 7 == 0, "of ").otherwise(F.concat("template", F.lit(" "))), "p_name")
    return part.crossJoin(rel).select(F.col("p_partkey").alias("item_a_id"), "relation", F.col("p_size").alias("item_b_id"), made.alias("assertion"), F.col("p_partkey").alias("row"))


def template_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.raw_sentences(_assertions(spark, sf_dir), vocab.relations(spark))[0].select("sid", "text")


def template_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.raw_sentences(_assertions(spark, sf_dir), vocab.relations(spark))[1].groupBy("relation").agg(F.count("*").alias("n"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.cleaned(F.col("html"))).alias("cleaned_md5"), F.length(tx.cleaned(F.col("html"))).cast("long").alias("n"))


def clean_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.collapsed(tx.cleaned(F.col("text"))).alias("text"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.sentence_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.length_histogram(sentences(spark, sf_dir))


def length_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.cumulative(mining.length_histogram(sentences(spark, sf_dir)))


def _thresholds(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int]]:
    rows = [(r["length"], r["n"]) for r in mining.length_histogram(sentences(spark, sf_dir)).collect()]  # one row for each length
    return mining.thresholds(rows, len(TEMPLATE))


def mining_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_thresholds(spark, sf_dir), "vertices int, least long, most long")


def meta_pattern_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.meta_patterns(sentences(spark, sf_dir), TEMPLATE)
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e["u"], e["label"], e["v"])), ",")
    return found.select(F.array_join("labels", " ").alias("labels"), edges.alias("edges"), "freq")


def frequent_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(subgraphs.frequent(parsed(spark, sf_dir), lambda rows: mining.thresholds(rows, len(TEMPLATE))))


def _forms(found: DataFrame) -> DataFrame:
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e["u"], e["label"], e["v"])), ",")
    return found.select(F.array_join("labels", " ").alias("labels"), edges.alias("edges"), "freq")


def frequent_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(mining.frequent(parsed(spark, sf_dir), 3, 10, 1 << 62))


def frequent_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(mining.frequent(parsed(spark, sf_dir), 4, 20, 1 << 62))


def _shown(found: DataFrame, k: int) -> DataFrame:
    return found.select("sid", *[F.col("mapping")[i].cast("long").alias(f"p{i}") for i in range(k)])


def subgraph_match_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(matching.find(parsed(spark, sf_dir), [PATH]), 3)


def subgraph_match_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.count(parsed(spark, sf_dir), [FORK]).select("matches", "sentences")


def subgraph_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark).table(matching.arcs(parsed(spark, sf_dir), PATH))  # the result reads it
    return matching.by_arcs(stored, PATH).select("sid", *[F.col(f"p{i}").cast("long").alias(f"p{i}") for i in range(3)])


def edge_label_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = sentences(spark, sf_dir).select("sid", F.explode("dependencies").alias("d"))
    return edges.groupBy("sid", F.col("d.rel").alias("label")).agg(F.count("*").alias("n"))


def vf2_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).where(matching.large_enough(PATH)).select("sid")


def separator_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with and without a separator; "and", tagged CC here, is taken for a clause separator."""
    rows = sentences(spark, sf_dir)
    found = matching.find(rows, [FORK]).join(rows.select("sid", F.transform("pos_tags", lambda t: F.when(t == "CC", "WP").otherwise(t)).alias("tags")), "sid")
    return found.groupBy(matching.within_clause(F.col("mapping"), matching.separators(F.col("tags"))).alias("kept")).agg(F.count("*").alias("n"))


def coverage_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir)
    return mining.first_match(matching.find(rows, [PATH, FORK, TWO], limit=1), rows.count())


def canonical_pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by the pattern as it is placed in the sentence. At most as many placements as the pattern has permutations come to the driver."""
    rank = F.transform("mapping", lambda x: F.size(F.filter("mapping", lambda y: y < x)))
    placements = matching.find(sentences(spark, sf_dir), [PATH]).groupBy(rank.alias("at")).agg(F.count("*").alias("n")).collect()
    shown = [(matching.placed(PATH, tuple(r["at"])), r["n"]) for r in placements]
    rows = [(" ".join(p.labels), ",".join(f"{u} {x} {v}" for u, x, v in p.edges), n) for p, n in shown]
    return spark.createDataFrame(rows, "labels string, edges string, n long").groupBy("labels", "edges").agg(F.sum("n").alias("n"))


def predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by whether their first two places are neighbours, and whether no edge leads out to a must tag."""
    rows = sentences(spark, sf_dir)
    found = matching.find(rows, [FORK]).join(rows.select("sid", "pos_tags", "dependencies"), "sid")
    kept = [matching.prefix_holds(F.col("mapping"), 2).alias("prefix"), matching.must_holds(F.col("mapping"), F.col("dependencies"), F.col("pos_tags")).alias("must"), matching.ends_well(F.transform("mapping", lambda i: F.get("pos_tags", i))).alias("ends")]
    return found.select(*kept).groupBy("prefix", "must", "ends").agg(F.count("*").alias("n"))


def degree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that pass the necessary conditions on label counts and on the edges that enter and leave each vertex."""
    return sentences(spark, sf_dir).where(matching.large_enough(PATH) & matching.degrees_suffice(PATH)).select("sid")


def pattern_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.shortest_matches(parsed(spark, sf_dir), [PATH, TWO])


def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir)
    n = rows.count()
    return mining.coverage(mining.first_match(matching.find(rows, [PATH, TWO], limit=1), n), n).select(F.round("coverage", 9).alias("coverage"))


def frequent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(mining.frequent(parsed(spark, sf_dir), 2, 10, 1 << 62))


def event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent entity type of each word of each event, where nouns count as PERSON or CITY by their first letter."""
    rows = sentences(spark, sf_dir).withColumn("lemmas", F.col("tokens")).withColumn("mentions", F.array().cast("array<struct<start:int,end:int,text:string,ner:string>>"))
    ner = lambda t: F.when(F.substring(t, 1, 1) < "h", "PERSON").when(F.substring(t, 1, 1) < "t", "CITY").otherwise("O")
    found = extraction.extract(rows.withColumn("ners", F.transform("tokens", ner)), [TWO])
    return extraction.main_entity(extraction.entity_counts(found)).groupBy("ner").agg(F.count("*").alias("n"))


def template_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all "the" in a sentence, and tags that stand for their kind."""
    rows = sentences(spark, sf_dir)
    return rows.select("sid", F.array_join(tx.indices_from(F.col("tokens"), F.lit("the"), 2), " ").alias("places"), F.array_join(F.transform("pos_tags", tx.fuzzy_tag), " ").alias("tags"))


def eventualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.merge(extraction.extract(parsed(spark, sf_dir), [PATH, TWO], kept=("eid", "pattern", "words", "pos_tags", "frequency")))
    return found.select("eid", "pattern", F.array_join("words", " ").alias("words"), "frequency", "sentences")


def pattern_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent sub-graphs of three words as a library, matched in all sentences: in how many each of them lies. They come to the driver, which a library must fit."""
    rows = parsed(spark, sf_dir)
    mined = mining.frequent(rows, 3, 10, 1 << 62).collect()
    library = [Pattern(tuple(r["labels"]), tuple((e["u"], e["label"], e["v"]) for e in r["edges"])) for r in mined]
    counts = matching.find(rows, library, limit=1).groupBy("pattern_id").agg(F.count("*").alias("sentences"))
    names = pattern_index.table(spark, library).drop("freq")
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e["u"], e["label"], e["v"])), ",")
    return names.join(counts, "pattern_id").select(F.array_join("labels", " ").alias("labels"), edges.alias("edges"), "sentences")


def optional_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the optional words that depend on them, directly or not."""
    found = pattern_index.matched(parsed(spark, sf_dir), [TWO]).select("sid", F.explode("matches").alias("m"))
    inside, place = F.col("m.inside"), lambda i: F.get("m.places", i)
    words = extraction.optional_closure(extraction.optional_edges(F.col("m.near"), F.col("m.tags"), inside), inside, True)
    return found.select("sid", place(inside[0]).cast("long").alias("p0"), place(inside[1]).cast("long").alias("p1"), F.array_join(F.transform(F.array_sort(words), place), " ").alias("words"))


def event_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a short and a long pattern, without the short ones inside a long one and without repeats."""
    return extraction.extract(parsed(spark, sf_dir), [CHAIN, DET], kept=("eid", "pattern", "words")).select("sid", "eid", "pattern", F.array_join("words", " ").alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        template_suffix, template_rejects, clean_text, clean_turns, sentence_split, length_histogram, length_cumulative, mining_thresholds, meta_pattern_mining, frequent_subgraphs,
        subgraph_match_path, subgraph_match_wildcard, subgraph_match_join, edge_label_multiset, vf2_prefilter, separator_filter, coverage_first_match, canonical_pattern_count, eventualities,
        predicate_counts, degree_filter, pattern_example, pattern_coverage, frequent_edges, frequent_triples, frequent_quads, event_entities, template_prefix,
        pattern_library, optional_closure, event_containment,
    )
}
_MADE = f"""{vocab.relations_sql()},
    made AS (SELECT p_partkey, p_size, relation, template, 'He bought it because ' || CASE WHEN p_partkey % 7 = 0 THEN 'of ' ELSE template || ' ' END || p_name AS assertion FROM part CROSS JOIN relations),
    cut AS (SELECT *, CASE WHEN template = '' THEN substr(assertion, strpos(assertion, 'because ') + 8) WHEN strpos(assertion, template) > 0 THEN substr(assertion, strpos(assertion, template)) END AS text FROM made)"""


def _cleaned(c: str) -> str:
    """The specification in pieces: schemes, addresses with an at sign, hosts, other runs of host characters, single characters; the first and third kind are URLs."""
    url, host = tx.SCHEME_URL.replace("'", "''"), tx.HOST_URL.replace("'", "''")
    ascii_ = f"regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]+', ' ', 'g'), '<ref[^>\\n]*>', '<ref>', 'g')"
    pieces = f"regexp_extract_all({ascii_}, '(?is){url}|[a-z0-9.-]*@[a-z0-9.@-]*|{host}|[a-z0-9.-]+|.')"
    out = f"array_to_string(list_transform({pieces}, lambda x: CASE WHEN regexp_full_match(x, '(?i){url}|{host}') THEN '<url>' ELSE x END), '')"
    return f"regexp_replace(regexp_replace({out}, '<url>[()\\[\\]]*<url>', '<url>', 'g'), '^\\s+|\\s+$', '', 'g')"


_TAGGED = f"tagged AS (SELECT sid, tokens, list_transform(tokens, lambda t: CASE {CASES} ELSE 'NN' END) AS tags FROM sentences)"
#: Edges with the labels of both ends, and the matches of the patterns as joins of them.
_ARCS = "arcs AS (SELECT e.sid, u, e.label, e.v, a.label AS lu, b.label AS lv FROM edges e JOIN nodes a ON a.sid = e.sid AND a.v = e.u JOIN nodes b ON b.sid = e.sid AND b.v = e.v)"
_PATH = f"""{_ARCS},
    path AS (SELECT d.sid, d.v AS p0, d.u AS p1, n.v AS p2 FROM arcs d JOIN arcs n ON n.sid = d.sid AND n.u = d.u WHERE d.label = 'det' AND d.lv = 'DT' AND d.lu LIKE 'NN%' AND n.label = 'next' AND n.lv = 'VBG')"""
_TWO = "two AS (SELECT sid, u AS p0, v AS p1 FROM arcs WHERE label = 'next' AND lu LIKE 'NN%' AND lv = 'VBD')"
_FORK = "fork AS (SELECT x.sid, x.u, x.v, y.v AS w, y.lv AS last FROM arcs x JOIN arcs y ON y.sid = x.sid AND y.u = x.v WHERE x.label = 'next' AND y.label = 'next' AND x.lu LIKE 'NN%' AND x.lv = 'IN')"
#: Events of matches raw (sid, pattern, m): their edges, those to optional words included, renumbered and written out.
_OPTIONAL = ", ".join(f"'{t}'" for t in vocab.OPTIONAL_POS_TAGS)
_SHOWN = f"""
    chosen AS (SELECT r.sid, pattern, m, u, a.label AS rel, v FROM raw r JOIN arcs a ON a.sid = r.sid WHERE list_contains(m, u) AND (list_contains(m, v) OR lv IN ({_OPTIONAL}))),
    placed_ AS (SELECT sid, pattern, m, list({{'u': u, 'v': v, 'rel': rel}}) AS es, list_sort(list_distinct(list_concat(list(u), list(v)))) AS ps FROM chosen GROUP BY sid, pattern, m),
    shown AS (
        SELECT sid, pattern, m, list_transform(ps, lambda i: tokens[i + 1]) AS ws, list_transform(ps, lambda i: tags[i + 1]) AS ts,
            list_sort(list_transform(es, lambda e: {{'u': list_position(ps, e.u) - 1, 'v': list_position(ps, e.v) - 1, 'rel': e.rel}})) AS es FROM placed_ JOIN tagged USING (sid)),
    ided AS (
        SELECT sid, pattern, m, array_to_string(ws, ' ') AS words, sha1('[[' || array_to_string(list_transform(es, lambda e: '[[' || e.u || ', "' || ws[e.u + 1] || '", "' || ts[e.u + 1] || '"], "' || e.rel || '", [' || e.v || ', "' || ws[e.v + 1] || '", "' || ts[e.v + 1] || '"]]'), ', ')
            || '], ["' || array_to_string(ws, '", "') || '"], ["' || array_to_string(ts, '", "') || '"]]') AS eid FROM shown)"""
_EVENTS = f"raw AS (SELECT sid, 'DT NN VBG' AS pattern, [p0, p1, p2] AS m FROM path UNION ALL SELECT sid, 'NN VBD', [p0, p1] FROM two), {_SHOWN}"


def _fits(label: str, wanted: str) -> str:
    """SQL: a sentence's label fits a pattern's."""
    return f"({label} = {wanted} OR ({wanted} IN ('NN', 'RB', 'JJ') AND starts_with({label}, {wanted})))"


def _walks(edges: int, least: int) -> str:
    """SQL: the frequent connected sub-graphs of so many edges, without circles: all depth-first walks over all sentences, the first of each set of vertices by its steps.

    Of equal leaves of a vertex as many are walked as a sub-graph has edges. A step is written in fixed widths: the label of the first vertex, then for each edge 9 less the vertex it leaves from, its way, its label and the new vertex's label.
    """
    pad = lambda c: f"rpad({c}, 8, ' ')"
    field = lambda at, n=8: f"rtrim(substr(steps, {at}, {n}))"
    out = ["leaves AS (SELECT sid, x FROM (SELECT sid, u AS x FROM arcs UNION ALL SELECT sid, v FROM arcs) GROUP BY sid, x HAVING count(*) = 1)"]
    out.append(f"ranked AS (SELECT a.*, CASE WHEN x IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY a.sid, u, label, lv, x IS NULL ORDER BY v) END AS r FROM arcs a LEFT JOIN leaves l ON l.sid = a.sid AND x = v), few AS (SELECT * FROM ranked WHERE r <= {edges})")
    out.append(f"both_ AS (SELECT sid, u AS a, v AS b, {pad('lu')} AS la, '1' || {pad('label')} || {pad('lv')} AS s FROM few UNION ALL SELECT sid, v, u, {pad('lv')}, '0' || {pad('label')} || {pad('lu')} FROM few)")
    out.append("walk1 AS (SELECT sid, [a, b] AS vs, [0, 1] AS line, la || '9' || s AS steps FROM both_)")
    for k in range(2, edges + 1):
        out.append(
            f"""walk{k} AS (
            SELECT w.sid, list_append(vs, b) AS vs, list_append(line[1:i], {k}) AS line, steps || (9 - line[i]) || s AS steps
            FROM (SELECT *, unnest(range(1, len(line) + 1)) AS i FROM walk{k - 1}) w JOIN both_ ON both_.sid = w.sid AND a = vs[line[i] + 1] AND NOT list_contains(vs, b))"""
        )
    out.append(f"first_ AS (SELECT sid, min(steps) AS steps FROM walk{edges} GROUP BY sid, list_sort(vs))")
    out.append(f"totals AS (SELECT steps, count(DISTINCT sid) AS freq FROM first_ GROUP BY steps HAVING count(DISTINCT sid) >= {least})")
    arc = lambda k: f"CASE {field(10 + 18 * (k - 1), 1)} WHEN '1' THEN {{'u': 9 - {field(9 + 18 * (k - 1), 1)}::INT, 'v': {k}, 'e': {field(11 + 18 * (k - 1))}}} ELSE {{'u': {k}, 'v': 9 - {field(9 + 18 * (k - 1), 1)}::INT, 'e': {field(11 + 18 * (k - 1))}}} END"
    labels = " || ' ' || ".join([field(1), *(field(19 + 18 * (k - 1)) for k in range(1, edges + 1))])
    out.append(f"counted AS (SELECT {labels} AS labels, list_transform(list_sort([{', '.join(arc(k) for k in range(1, edges + 1))}]), lambda x: x.u || ' ' || x.e || ' ' || x.v) AS es, freq FROM totals)")
    return ", ".join(out)


ORACLES = {
    "template_suffix": f"WITH {_MADE} SELECT concat_ws('-', p_partkey, relation, p_size) || '|' || p_partkey AS sid, text FROM cut WHERE text IS NOT NULL",
    "template_rejects": f"WITH {_MADE} SELECT relation, count(*) AS n FROM cut WHERE text IS NULL GROUP BY relation",
    "clean_text": f"SELECT page_id, md5({_cleaned('html')}) AS cleaned_md5, length({_cleaned('html')}) AS n FROM pages",
    "clean_turns": f"SELECT conv_id, turn, regexp_replace({_cleaned('text')}, '\\s+', ' ', 'g') AS text FROM conversations",
    "length_histogram": f"WITH {SENTENCES_SQL} SELECT CAST(len(tokens) AS INT) AS length, count(*) AS n FROM sentences GROUP BY 1",
    "length_cumulative": f"WITH {SENTENCES_SQL}, h AS (SELECT CAST(len(tokens) AS INT) AS length, count(*) AS n FROM sentences GROUP BY 1) SELECT length, n, CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS upto FROM h",
    "meta_pattern_mining": f"""
        WITH {SENTENCES_SQL},
        places AS (SELECT sid, min(v) FILTER (t = 'the') AS a FROM nodes GROUP BY sid),
        both_ AS (SELECT p.sid, a, min(v) AS b FROM places p JOIN nodes n ON n.sid = p.sid AND n.t = 'of' AND n.v >= a GROUP BY p.sid, a),
        arcs AS (SELECT x.sid, string_agg((CASE WHEN u = a THEN 0 ELSE 1 END) || ' ' || label || ' ' || (CASE WHEN v = a THEN 0 ELSE 1 END), ',') AS e FROM both_ x JOIN edges e ON e.sid = x.sid AND u IN (a, b) AND v IN (a, b) GROUP BY x.sid)
        SELECT 'DT IN' AS labels, coalesce(e, '') AS edges, count(*) AS freq FROM both_ LEFT JOIN arcs USING (sid) GROUP BY 2""",
    "subgraph_match_path": f"WITH {SENTENCES_SQL}, {_PATH} SELECT sid, p0, p1, p2 FROM path",
    "subgraph_match_join": f"WITH {SENTENCES_SQL}, {_PATH} SELECT sid, p0, p1, p2 FROM path",
    "subgraph_match_wildcard": f"WITH {SENTENCES_SQL}, {_ARCS}, {_FORK} SELECT count(*) AS matches, count(DISTINCT sid) AS sentences FROM fork",
    "edge_label_multiset": f"WITH {SENTENCES_SQL} SELECT sid, label, count(*) AS n FROM edges GROUP BY sid, label",
    "vf2_prefilter": f"""
        WITH {SENTENCES_SQL},
        n AS (SELECT sid, count(*) AS k, count(*) FILTER (label = 'DT') AS d, count(*) FILTER (label LIKE 'NN%') AS nn, count(*) FILTER (label = 'VBG') AS g FROM nodes GROUP BY sid),
        e AS (SELECT sid, count(*) AS k, count(*) FILTER (label = 'det') AS d, count(*) FILTER (label = 'next') AS x FROM edges GROUP BY sid)
        SELECT n.sid FROM n JOIN e USING (sid) WHERE n.k >= 3 AND e.k >= 2 AND n.d >= 1 AND nn >= 1 AND g >= 1 AND e.d >= 1 AND x >= 1""",
    "separator_filter": f"WITH {SENTENCES_SQL}, {_TAGGED}, {_ARCS}, {_FORK} SELECT len(list_filter(tags[u + 1:w + 1], lambda t: t = 'CC')) = 0 AS kept, count(*) AS n FROM fork JOIN tagged USING (sid) GROUP BY 1",
    "coverage_first_match": f"""
        WITH {SENTENCES_SQL}, {_PATH}, {_TWO}, {_FORK},
        claims AS (SELECT sid, 0 AS k FROM path UNION SELECT sid, 1 FROM fork UNION SELECT sid, 2 FROM two),
        firsts AS (SELECT sid, min(k) AS k FROM claims GROUP BY sid)
        SELECT CAST(k AS INT) AS pattern_id, count(*) AS n FROM firsts GROUP BY k""",
    "canonical_pattern_count": f"WITH {SENTENCES_SQL}, {_PATH} SELECT 'DT NN VBG' AS labels, '1 det 0,1 next 2' AS edges, count(*) AS n FROM path",
    "predicate_counts": f"""
        WITH {SENTENCES_SQL}, {_ARCS}, {_FORK},
        crossed AS (
            SELECT DISTINCT f.sid, f.u, f.v, f.w FROM fork f JOIN arcs a ON a.sid = f.sid AND (a.u IN (f.u, f.v, f.w)) <> (a.v IN (f.u, f.v, f.w))
            WHERE CASE WHEN a.u IN (f.u, f.v, f.w) THEN a.lv ELSE a.lu END IN ('IN', 'CC', 'TO'))
        SELECT f.v - f.u = 1 AS prefix, c.sid IS NULL AS must, last NOT IN ('IN', 'CC', 'TO') AS ends, count(*) AS n
        FROM fork f LEFT JOIN crossed c ON c.sid = f.sid AND c.u = f.u AND c.v = f.v AND c.w = f.w GROUP BY 1, 2, 3""",
    "degree_filter": f"""
        WITH {SENTENCES_SQL},
        n AS (SELECT sid, count(*) AS k, count(*) FILTER (label = 'DT') AS d, count(*) FILTER (label LIKE 'NN%') AS nn, count(*) FILTER (label = 'VBG') AS g FROM nodes GROUP BY sid),
        e AS (SELECT sid, count(*) AS k, count(*) FILTER (label = 'det') AS d, count(*) FILTER (label = 'next') AS x FROM edges GROUP BY sid),
        deg AS (SELECT sid, sum((label = 'det')::INT) AS d, sum((label = 'next')::INT) AS x, u FROM edges GROUP BY sid, u)
        SELECT n.sid FROM n JOIN e USING (sid) WHERE n.k >= 3 AND e.k >= 2 AND n.d >= 1 AND nn >= 1 AND g >= 1 AND e.d >= 1 AND x >= 1 AND EXISTS (SELECT 1 FROM deg WHERE deg.sid = n.sid AND deg.d >= 1 AND deg.x >= 1)""",
    "pattern_example": f"""
        WITH {SENTENCES_SQL}, {_PATH}, {_TWO}, hits AS (SELECT DISTINCT 0 AS k, sid FROM path UNION SELECT DISTINCT 1, sid FROM two),
        sized AS (SELECT k, h.sid, tokens, row_number() OVER (PARTITION BY k ORDER BY len(tokens), h.sid) AS r FROM hits h JOIN sentences s ON s.sid = h.sid)
        SELECT CAST(k AS INT) AS pattern_id, sid, array_to_string(tokens, ' ') AS text FROM sized WHERE r = 1""",
    "pattern_coverage": f"""
        WITH {SENTENCES_SQL}, {_PATH}, {_TWO}, hits AS (SELECT sid FROM path UNION SELECT sid FROM two)
        SELECT round((SELECT count(*) FROM hits) / (SELECT count(*) FROM sentences)::DOUBLE, 9) AS coverage""",
    "frequent_edges": f"""
        WITH {SENTENCES_SQL}, {_ARCS},
        forms AS (SELECT DISTINCT sid, CASE WHEN lu < lv THEN lu || ' ' || lv ELSE lv || ' ' || lu END AS labels, CASE WHEN lu < lv THEN '0 ' || label || ' 1' ELSE '1 ' || label || ' 0' END AS edges FROM arcs)
        SELECT labels, edges, count(*) AS freq FROM forms GROUP BY 1, 2 HAVING count(*) >= 10""",
    "frequent_triples": f"WITH {SENTENCES_SQL}, {_ARCS}, {_walks(2, 10)} SELECT labels, array_to_string(es, ',') AS edges, freq FROM counted",
    "frequent_quads": f"WITH {SENTENCES_SQL}, {_ARCS}, {_walks(3, 20)} SELECT labels, array_to_string(es, ',') AS edges, freq FROM counted",
    "event_entities": f"""
        WITH {SENTENCES_SQL}, {_TAGGED}, {_ARCS}, {_TWO}, raw AS (SELECT sid, 'NN VBD' AS pattern, [p0, p1] AS m FROM two), {_SHOWN},
        ids AS (SELECT DISTINCT eid, words FROM ided), places AS (SELECT eid, unnest(string_split(words, ' ')) AS t FROM ids)
        SELECT CASE WHEN t[1] < 'h' THEN 'PERSON' WHEN t[1] < 't' THEN 'CITY' ELSE 'O' END AS ner, count(*) AS n FROM places GROUP BY 1""",
    "pattern_library": f"""
        WITH {SENTENCES_SQL}, {_ARCS}, {_walks(2, 10)},
        library AS (SELECT labels, es, string_split(labels, ' ') AS l, string_split(es[1], ' ') AS x, string_split(es[2], ' ') AS y FROM counted),
        split AS (SELECT labels, es, x[2] AS xe, y[2] AS ye, l[x[1]::INT + 1] AS xu, l[x[3]::INT + 1] AS xv, l[y[1]::INT + 1] AS yu, l[y[3]::INT + 1] AS yv, x[1] = y[1] AS uu, x[1] = y[3] AS uv, x[3] = y[1] AS vu, x[3] = y[3] AS vv FROM library),
        incident AS (SELECT *, u AS x FROM arcs UNION ALL SELECT *, v FROM arcs),
        pairs AS (SELECT a.sid, a.label AS xe, a.lu AS alu, a.lv AS alv, b.label AS ye, b.lu AS blu, b.lv AS blv, a.u = b.u AS uu, a.u = b.v AS uv, a.v = b.u AS vu, a.v = b.v AS vv
            FROM incident a JOIN incident b ON a.sid = b.sid AND a.x = b.x AND (a.u, a.v) <> (b.u, b.v)),
        shapes AS (SELECT sid, xe, alu, alv, ye, blu, blv, uu, uv, vu, vv FROM pairs GROUP BY ALL),
        hits AS (SELECT DISTINCT labels, es, sid FROM split JOIN shapes USING (xe, ye, uu, uv, vu, vv) WHERE {_fits('alu', 'xu')} AND {_fits('alv', 'xv')} AND {_fits('blu', 'yu')} AND {_fits('blv', 'yv')})
        SELECT labels, array_to_string(es, ',') AS edges, count(*) AS sentences FROM hits GROUP BY labels, es""",
    "optional_closure": f"""
        WITH RECURSIVE {SENTENCES_SQL}, {_ARCS}, {_TWO},
        reach(sid, p0, p1, v) AS (SELECT sid, p0, p1, unnest([p0, p1]) FROM two UNION SELECT r.sid, p0, p1, a.v FROM reach r JOIN arcs a ON a.sid = r.sid AND a.u = r.v AND a.lv IN ({_OPTIONAL}))
        SELECT sid, p0, p1, coalesce(string_agg(v::VARCHAR, ' ' ORDER BY v) FILTER (v NOT IN (p0, p1)), '') AS words FROM reach GROUP BY sid, p0, p1""",
    "event_containment": f"""
        WITH {SENTENCES_SQL}, {_TAGGED}, {_PATH}, chain AS (SELECT p.*, a.v AS p3 FROM path p JOIN arcs a ON a.sid = p.sid AND a.u = p2 AND a.label = 'next' AND a.lv LIKE 'NN%'),
        raw AS (SELECT sid, 'DT NN VBG NN' AS pattern, [p0, p1, p2, p3] AS m FROM chain UNION ALL SELECT sid, 'DT NN', [v, u] FROM arcs WHERE label = 'det' AND lv = 'DT' AND lu LIKE 'NN%'), {_SHOWN},
        long AS (SELECT * FROM ided WHERE len(m) = 4 QUALIFY row_number() OVER (PARTITION BY sid, eid ORDER BY m) = 1),
        inner_ AS (SELECT DISTINCT i.sid, i.m FROM ided i JOIN long l ON l.sid = i.sid AND len(i.m) = 2 AND list_has_all(l.m, i.m)),
        rest AS (SELECT i.* FROM ided i LEFT JOIN inner_ x ON x.sid = i.sid AND x.m = i.m WHERE len(i.m) = 2 AND x.sid IS NULL)
        SELECT DISTINCT sid, eid, pattern, words FROM (SELECT * FROM long UNION ALL SELECT r.* FROM rest r WHERE NOT EXISTS (SELECT 1 FROM long l WHERE l.sid = r.sid AND l.eid = r.eid))""",
    "template_prefix": f"""
        WITH {SENTENCES_SQL}, {_TAGGED}
        SELECT sid, array_to_string(list_transform(list_filter(range(3, len(tokens) + 1), lambda i: tokens[i] = 'the'), lambda i: CAST(i - 1 AS VARCHAR)), ' ') AS places,
            array_to_string(list_transform(tags, lambda t: CASE WHEN t LIKE 'NN%' THEN 'NN' WHEN t LIKE 'RB%' THEN 'RB' WHEN t LIKE 'JJ%' THEN 'JJ' ELSE t END), ' ') AS tags FROM tagged""",
    "eventualities": f"""
        WITH {SENTENCES_SQL}, {_TAGGED}, {_PATH}, {_TWO}, {_EVENTS}, once AS (SELECT DISTINCT sid, eid, pattern, words FROM ided)
        SELECT eid, min(pattern) AS pattern, min(words) AS words, CAST(count(*) AS DOUBLE) AS frequency, count(*) AS sentences FROM once GROUP BY eid""",
    "sentence_split": f"""
        WITH c AS (SELECT doc_id, {_cleaned('text')} AS c FROM documents),
        a AS (SELECT doc_id, CASE WHEN length(c) <= {vocab.MAX_LEN} THEN [c] ELSE string_split(c, chr(10) || chr(10)) END AS p FROM c),
        b AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {vocab.MAX_LEN} THEN [x] ELSE string_split(x, chr(10)) END)) AS p FROM a),
        d AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {vocab.MAX_LEN} THEN [x] ELSE string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)) END)) AS p FROM b),
        e AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM d)
        SELECT doc_id, CAST(unnest(range(0, len(p))) AS INT) AS part, unnest(p) AS text FROM e""",
    "mining_thresholds": f"""
        WITH {SENTENCES_SQL}, h AS (SELECT len(tokens) AS k, count(*) AS n FROM sentences GROUP BY 1), c AS (SELECT k, sum(n) OVER (ORDER BY k) AS upto FROM h UNION ALL SELECT 0, 0),
        t AS (SELECT sum(n) AS total, sum(k * n) / sum(n) AS mean FROM h),
        d AS (SELECT unnest(range(1, CAST(ceil(mean) AS BIGINT) - {len(TEMPLATE)})) AS delta, total FROM t),
        near AS (
            SELECT delta, total, coalesce((SELECT min(upto) FROM c WHERE k >= {len(TEMPLATE)} + delta - 1), (SELECT max(upto) FROM c)) AS lo,
                coalesce((SELECT min(upto) FROM c WHERE k >= {len(TEMPLATE)} + 2 * delta - 1), (SELECT max(upto) FROM c)) AS hi FROM d),
        s AS (SELECT *, ln(1 + (hi - lo) / total::DOUBLE) * 0.1::DOUBLE AS share FROM near), u AS (SELECT *, CAST(trunc((total - lo) * share) AS BIGINT) AS least FROM s)
        SELECT CAST({len(TEMPLATE)} + delta AS INT) AS vertices, least, CAST(trunc((total - lo) * 0.97::DOUBLE) AS BIGINT) AS most FROM u
        WHERE delta < coalesce((SELECT min(delta) FROM u WHERE share < 1e-6 OR least < total * 1e-4), 1 << 30)""",
}
