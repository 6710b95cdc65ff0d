"""Queries on scored assertions, concepts, features and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.vocab import PERSON_PRONOUNS
from ..operators import concepts, features, recommend, scoring
from ..sources.shared import Scratch
from .tables import RATINGS_SQL, SCORED_SQL, SENTENCES_SQL, part_taxonomy, ratings, scored, sentences, table


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def threshold_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.relabel(scored(spark, sf_dir), 0.7).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.metrics(scored(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.pr_curve(scored(spark, sf_dir)), "precision", "recall")


def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.precision_at_recall(scoring.pr_curve(scored(spark, sf_dir)), scoring.THRESHOLDS), "precision", "recall")


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without bounds, as margins or logits are."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.when(F.col("quality") == 1, "v").otherwise("i").alias("label"), ((F.col("n_chars") - 700) / 8.0).alias("score"))


def pr_curve_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.pr_curve(_margins(spark, sf_dir), 64), "precision", "recall")


def precision_at_recall_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.precision_at_recall(scoring.pr_curve(_margins(spark, sf_dir), 64), scoring.THRESHOLDS), "precision", "recall")


def score_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("y", (F.col("label") == "v").cast("double"))
    return _rounded(scoring.mean_squared_error(rows, "score", "y"), "mse")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.sha1("p_type").alias("cid"), F.col("p_type").alias("concept"), F.sha1("p_name").alias("eid"), F.col("p_brand").alias("pattern"), (F.col("p_size") / 50.0).alias("score"), F.lit(2.0).alias("frequency"))


def concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(concepts.concept_table(_pairs(spark, sf_dir)), "score")


def concept_mode_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.common_pattern(_pairs(spark, sf_dir))


def concept_pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.pair_table(_pairs(spark, sf_dir)).select("pid", "cid", "eid").distinct()


def word_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(concepts.word_concepts(part_taxonomy(spark, sf_dir), 2), "score")


def seed_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).withColumn("ners", F.transform("tokens", lambda t: F.when(t.like("th%"), "CITY").when(t.like("an%"), "DATE").otherwise("O")))
    return rows.select("sid", F.md5(F.array_join(concepts.seeded(F.col("tokens"), F.col("ners")), " ")).alias("seeded"))


def item_text_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = features.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select(F.col("key").alias("label"), F.posexplode("features").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", F.round(F.array_max(vx.softmax(F.col("e"))), 6).alias("top"), vx.arg_max(F.col("e")).alias("at"), F.round(vx.norm(F.col("e"), 1), 4).alias("l1"), F.round(vx.norm(F.col("e")), 6).alias("l2"))


def transe_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    at = lambda k: v.select((F.col("vec_id") - k).alias("vec_id"), F.col("e").alias(f"e{k}"))
    rows = v.join(at(1), "vec_id").join(at(2), "vec_id").join(at(3), "vec_id")
    good = vx.translation_distance(F.col("e"), F.col("e1"), F.col("e2"))
    pair = vx.pair_distance(F.col("e"), F.col("e3"), F.col("e1"), F.col("e2"))
    bad = vx.translation_distance(F.col("e3"), F.col("e1"), F.col("e2"))
    return rows.select("vec_id", F.round(good, 4).alias("distance"), F.round(pair, 4).alias("pair_distance"), F.round(vx.margin_loss(good, bad), 4).alias("loss"))


def rating_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vocabulary(ratings(spark, sf_dir), "item")


def rating_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir)
    vocab = features.vocabulary(rows.where("split < 8"), "item")
    return features.encode(rows.where("split >= 8"), "item", vocab, "idx").groupBy((F.col("idx") == 0).alias("unknown")).agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"))


def rating_features_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("features"))
    rows = features.with_features(ratings(spark, sf_dir).select("item").distinct(), "item", known, 64)
    return rows.select("item", F.size("features").alias("size"), F.round(vx.total(F.col("features")), 4).alias("total"))


def rmse_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).withColumn("prediction", F.lit(25.0))
    return _rounded(recommend.rmse(rows.where("split = 9")), "rmse")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") % 5).cast("int").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("step"), F.col("l_quantity").alias("valid"), F.col("l_discount").alias("test"))


def best_test_at_min_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.test_at_best(_history(spark, sf_dir))


def mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.over_runs(recommend.test_at_best(_history(spark, sf_dir))), "mean", "std")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rel = F.map_from_arrays(F.array("l_returnflag", F.concat(F.lit("is"), "l_linestatus")), F.array(F.lit(1.0), F.lit(1.0)))
    return line.select(F.col("l_partkey").cast("string").alias("asin_1"), F.col("l_suppkey").cast("string").alias("asin_2"), F.col("l_linestatus").alias("eventuality"), rel.alias("relations"), F.col("l_discount").alias("plausibility"), F.col("l_tax").alias("typicality"))


def kg_threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.above(_edges(spark, sf_dir), 0.05, 0.05).groupBy("eventuality").agg(F.count("*").alias("n"))


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.triples(_edges(spark, sf_dir)).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("heads"), F.countDistinct("tail").alias("tails"))


def conceptualized(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words, o = F.array(F.lit("buy"), "p_name"), F.array(F.lit("O"), F.lit("O"))
    tags = F.array(F.lit("VB"), F.lit("NN"))
    events = part.select(F.col("p_partkey").cast("string").alias("eid"), F.transform(words, F.lower).alias("words"), o.alias("ners"), tags.alias("pos_tags"), F.transform(words, F.lower).alias("phrases"), o.alias("phrase_ners"), tags.alias("phrase_tags"))
    lower = part_taxonomy(spark, sf_dir).withColumn("instance", F.lower("instance"))
    return _rounded(concepts.conceptualize(events, lower, 2), "score")


def concept_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' parts of three following lines as events of three nouns, whose nine best replacements are shown as one text."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    named = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.min(F.lower("p_name")).alias("w"))
    at = lambda k: named.select("l_orderkey", (F.col("l_linenumber") - k).alias("l_linenumber"), F.col("w").alias(f"w{k}"))
    rows = at(0).join(at(1), ["l_orderkey", "l_linenumber"]).join(at(2), ["l_orderkey", "l_linenumber"])
    words, o = F.array(F.lit("buy"), "w0", "w1", "w2"), F.array(*[F.lit("O")] * 4)
    tags = F.array(F.lit("VB"), *[F.lit("NN")] * 3)
    eid = F.concat_ws("-", "l_orderkey", "l_linenumber")
    events = rows.select(eid.alias("eid"), words.alias("words"), o.alias("ners"), tags.alias("pos_tags"), words.alias("phrases"), o.alias("phrase_ners"), tags.alias("phrase_tags"))
    lower = part_taxonomy(spark, sf_dir).withColumn("instance", F.lower("instance"))
    best = concepts.conceptualize(events, lower, 2, limit=9)
    ranked = F.sort_array(F.collect_list(F.struct(F.col("score").alias("s"), F.col("concept").alias("c"))), asc=False)
    return best.groupBy("eid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.md5(F.array_join(F.transform(ranked, lambda x: x["c"]), "|")).alias("concepts"))


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = features.text_vectors(table(spark, sf_dir, "part"), "p_name", 16)
    return vec.select("key", F.posexplode("features").alias("place", "value")).select("key", "place", F.round("value", 6).alias("value"))


def trained_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nations and nations in regions, by relation."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    lives = customer.select(F.col("c_custkey").cast("int").alias("h"), F.lit(0).alias("r"), F.col("c_nationkey").alias("t"))
    lies = nation.select(F.col("n_nationkey").alias("h"), F.lit(1).alias("r"), (F.col("n_regionkey") + 25).alias("t"))
    most = customer.agg(F.max("c_custkey")).first()[0] or 0
    triples = lives.withColumn("h", F.col("h") + 30).unionByName(lies).withColumn("g", F.lit("all"))
    return features.train_translation(triples, most + 31, 2, "g", size=16, epochs=5).select("kind", "idx", F.size("vector").alias("size"), F.round("loss", 6).alias("loss"))


def rating_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two runs of a wide and deep network on the ratings, users and items numbered by their keys."""
    rows = Scratch(spark).table(ratings(spark, sf_dir).select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), "rating", "split"))  # read five times
    top = rows.agg(F.max("user"), F.max("item")).first()
    part = lambda *s: rows.where(F.col("split").isin(*s)).drop("split")
    return recommend.train_wide_deep(part(*range(8)), part(8), part(9), (top[0] or 0) + 1, (top[1] or 0) + 1, size=8, steps=60, batch=256, every=30, runs=2).select("run", "step", F.round("valid", 6).alias("valid"), F.round("test", 6).alias("test"))


QUERIES = {
    f.__name__: f
    for f in (
        conceptualized, concept_combinations, pr_curve_margins, precision_at_recall_margins, text_features, trained_translation, rating_network, threshold_relabel, threshold_metrics, pr_curve, precision_at_recall, score_mse, concept_scores, concept_mode_pattern, concept_pair_ids, word_concepts, seed_rule_index, item_text_mean,
        softmax_scores, transe_margin, rating_vocab, rating_encoded, rating_features_default, rmse_nonzero, best_test_at_min_valid, mean_std, kg_threshold_filter, kg_triples,
    )
}
_RUNNING = """,
    counts AS (SELECT score, sum((label = 'v')::INT) AS pos, sum((label = 'i')::INT) AS neg FROM scored GROUP BY score),
    curve AS (SELECT score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS p,
        sum(pos) OVER w / (SELECT greatest(sum(pos), 1) FROM counts) AS r FROM counts WINDOW w AS (ORDER BY score DESC))"""
_CURVE = SCORED_SQL + _RUNNING
_MARGINS = "scored AS (SELECT CASE WHEN quality = 1 THEN 'v' ELSE 'i' END AS label, (n_chars - 700) / 8.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))" + _RUNNING
_PAIRS = "pairs AS (SELECT sha1(p_type) AS cid, p_type AS concept, sha1(p_name) AS eid, p_brand AS pattern, p_size / 50.0::DOUBLE AS score FROM part)"
_VOCAB = "vocab AS (SELECT item, row_number() OVER (ORDER BY substr(md5(CAST(item AS VARCHAR)), 1, 3), item) AS idx FROM (SELECT DISTINCT item FROM {0}))"
_HISTORY = """history AS (SELECT CAST(l_orderkey % 5 AS INT) AS run, l_orderkey * 10 + l_linenumber AS step, l_quantity AS valid, l_discount AS test FROM lineitem),
    best AS (SELECT run, step, valid, test FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY valid, step, test) AS k FROM history) WHERE k = 1)"""
_E = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_DIST = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: abs({0}[i] + {1}[i] - {2}[i])))"
_POINTS = "WITH {curve} SELECT threshold, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall FROM curve"
_AT_RECALL = """
        WITH {curve}, t(target) AS (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)),
        k AS (SELECT target, threshold, p, r, row_number() OVER (PARTITION BY target ORDER BY threshold) AS n FROM curve JOIN t ON r <= target)
        SELECT target, threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM k WHERE n = 1"""
ORACLES = {
    "text_features": """
        WITH keys AS (SELECT DISTINCT p_name AS key FROM part), w AS (SELECT key, unnest(string_split(lower(key), ' ')) AS w FROM keys),
        h AS (SELECT key, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS h FROM w WHERE w <> ''), summed AS (SELECT key, CAST(h % 16 AS INT) AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM h GROUP BY 1, 2),
        n AS (SELECT key, sqrt(sum(x * x)) AS n FROM summed GROUP BY 1), places AS (SELECT key, CAST(unnest(range(0, 16)) AS INT) AS place FROM keys)
        SELECT p.key, p.place, round(CASE WHEN n > 0 THEN coalesce(x, 0) / n ELSE 0 END, 6) + 0 AS value FROM places p LEFT JOIN summed USING (key, place) LEFT JOIN n USING (key)""",
    "threshold_relabel": f"WITH {SCORED_SQL} SELECT label, CASE WHEN score >= 0.7 THEN 'v' ELSE 'i' END AS prediction, count(*) AS n FROM scored GROUP BY 1, 2",
    "threshold_metrics": f"""
        WITH {SCORED_SQL}, t(threshold) AS (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)),
        c AS (SELECT threshold, count(*) FILTER (label = 'v' AND score >= threshold) AS tp, count(*) FILTER (label = 'i' AND score >= threshold) AS fp,
            count(*) FILTER (label = 'v' AND score < threshold) AS fn, count(*) FILTER (label = 'i' AND score < threshold) AS tn FROM scored CROSS JOIN t GROUP BY threshold),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c)
        SELECT threshold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r""",
    "pr_curve": _POINTS.format(curve=_CURVE),
    "pr_curve_margins": _POINTS.format(curve=_MARGINS),
    "precision_at_recall": _AT_RECALL.format(curve=_CURVE),
    "precision_at_recall_margins": _AT_RECALL.format(curve=_MARGINS),
    "concept_combinations": """
        WITH t AS (SELECT p_type AS concept, lower(p_name) AS instance, count(*) AS freq FROM part GROUP BY 1, 2),
        s AS (SELECT instance, replace(concept, ' ', '-') AS concept, freq / sum(freq) OVER (PARTITION BY instance) AS score FROM t),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY score DESC, concept) AS r FROM s) WHERE r <= 2),
        o AS (SELECT instance, concept, score, false AS kept FROM b UNION ALL SELECT DISTINCT instance, instance, 1.0, true FROM b),
        named AS (SELECT l_orderkey AS k, l_linenumber AS n, min(lower(p_name)) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
        e AS (SELECT x.k || '-' || x.n AS eid, x.w AS x, y.w AS y, z.w AS z FROM named x JOIN named y ON y.k = x.k AND y.n = x.n + 1 JOIN named z ON z.k = x.k AND z.n = x.n + 2),
        ways AS (
            SELECT eid, a.score * CASE WHEN y = x THEN 1 ELSE b.score END * CASE WHEN z IN (x, y) THEN 1 ELSE c.score END AS s, ['buy', a.concept, b.concept, c.concept] AS w
            FROM e JOIN o a ON a.instance = x JOIN o b ON b.instance = y AND (y <> x OR b.concept = a.concept AND b.kept = a.kept)
            JOIN o c ON c.instance = z AND (z <> x OR c.concept = a.concept AND c.kept = a.kept) AND (z <> y OR c.concept = b.concept AND c.kept = b.kept)
            WHERE NOT (a.kept AND b.kept AND c.kept)),
        best AS (SELECT eid, s, array_to_string(w, ' ') AS c FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY s DESC, w DESC) AS r FROM ways) WHERE r <= 9)
        SELECT eid, count(*) AS n, round(sum(s), 6) AS score, md5(string_agg(c, '|' ORDER BY s DESC, c DESC)) AS concepts FROM best GROUP BY eid""",
    "score_mse": f"WITH {SCORED_SQL} SELECT round(avg(pow(score - (label = 'v')::INT, 2)), 6) AS mse FROM scored",
    "concept_scores": f"WITH {_PAIRS} SELECT cid, concept, round(sum(score * 2.0), 6) AS score, count(*) AS instances FROM (SELECT DISTINCT * FROM pairs) GROUP BY cid, concept",
    "conceptualized": """
        WITH t AS (SELECT p_type AS concept, lower(p_name) AS instance, count(*) AS freq FROM part GROUP BY 1, 2),
        s AS (SELECT instance, replace(concept, ' ', '-') AS concept, freq / sum(freq) OVER (PARTITION BY instance) AS score FROM t),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY score DESC, concept) AS r FROM s) WHERE r <= 2)
        SELECT CAST(p_partkey AS VARCHAR) AS eid, 'buy ' || concept AS concept, sha1('buy ' || concept) AS cid, round(score, 6) AS score FROM part JOIN b ON instance = lower(p_name)""",
    "concept_mode_pattern": f"WITH {_PAIRS}, c AS (SELECT cid, pattern, count(*) AS n FROM pairs GROUP BY cid, pattern) SELECT cid, pattern FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, pattern) AS r FROM c) WHERE r = 1",
    "concept_pair_ids": f"WITH {_PAIRS} SELECT DISTINCT sha1(cid || '$' || eid) AS pid, cid, eid FROM pairs",
    "word_concepts": """
        WITH t AS (SELECT p_type AS concept, p_name AS instance, count(*) AS freq FROM part GROUP BY 1, 2),
        s AS (SELECT instance, replace(concept, ' ', '-') AS concept, freq / sum(freq) OVER (PARTITION BY instance) AS score FROM t)
        SELECT instance, concept, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY score DESC, concept) AS r FROM s) WHERE r <= 2""",
    "seed_rule_index": f"""
        WITH {SENTENCES_SQL},
        k AS (SELECT sid, v, t, CASE WHEN t LIKE 'th%' THEN 'CITY' WHEN t LIKE 'an%' THEN 'DATE' WHEN t IN ({", ".join(f"'{w}'" for w in PERSON_PRONOUNS)}) THEN 'PERSON' END AS kind FROM nodes),
        f AS (SELECT sid, kind, t, min(v) AS first_at FROM k WHERE kind IS NOT NULL GROUP BY sid, kind, t),
        r AS (SELECT sid, kind, t, row_number() OVER (PARTITION BY sid, kind ORDER BY first_at) - 1 AS n FROM f)
        SELECT sid, md5(string_agg(CASE WHEN kind IS NULL THEN t ELSE '__' || kind || '__' || n END, ' ' ORDER BY v)) AS seeded FROM k LEFT JOIN r USING (sid, kind, t) GROUP BY sid""",
    "item_text_mean": "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i",
    "softmax_scores": f"""
        WITH {_E}
        SELECT vec_id, round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS top, CAST(list_position(e, list_max(e)) - 1 AS INT) AS at,
            round(list_sum(list_transform(e, lambda x: abs(x))), 4) AS l1, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS l2 FROM v""",
    "transe_margin": f"""
        WITH {_E}, q AS (SELECT a.vec_id, a.e AS e, b.e AS e1, c.e AS e2, d.e AS e3 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 JOIN v d ON d.vec_id = a.vec_id + 3),
        m AS (SELECT *, list_transform(range(1, len(e) + 1), lambda i: (e[i] + e3[i]) / 2) AS h FROM q)
        SELECT vec_id, round({_DIST.format("e", "e1", "e2")}, 4) AS distance, round({_DIST.format("h", "e1", "e2")}, 4) AS pair_distance,
            round(greatest(0, {_DIST.format("e", "e1", "e2")} - {_DIST.format("e3", "e1", "e2")} + 1), 4) AS loss FROM m""",
    "rating_vocab": f"WITH {RATINGS_SQL}, {_VOCAB.format('ratings')} SELECT item AS value, idx FROM vocab",
    "rating_encoded": f"""
        WITH {RATINGS_SQL}, train AS (SELECT * FROM ratings WHERE split < 8), {_VOCAB.format('train')}
        SELECT coalesce(idx, 0) = 0 AS unknown, count(*) AS n, CAST(sum(coalesce(idx, 0)) AS BIGINT) AS idx_sum FROM ratings LEFT JOIN vocab USING (item) WHERE split >= 8 GROUP BY 1""",
    "rating_features_default": f"""
        WITH {RATINGS_SQL} SELECT item, CAST(coalesce(len(embedding), 64) AS INT) AS size, round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0.0), 4) AS total
        FROM (SELECT DISTINCT item FROM ratings) LEFT JOIN embeddings ON item = vec_id""",
    "rmse_nonzero": f"WITH {RATINGS_SQL} SELECT round(sqrt(avg(pow(25.0 - rating, 2))), 6) AS rmse FROM ratings WHERE rating <> 0 AND split = 9",
    "best_test_at_min_valid": f"WITH {_HISTORY} SELECT * FROM best",
    "mean_std": f"WITH {_HISTORY} SELECT round(avg(test), 6) AS mean, round(stddev_pop(test), 6) AS std FROM best",
    "kg_threshold_filter": "SELECT l_linestatus AS eventuality, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_tax >= 0.05 GROUP BY 1",
    "kg_triples": """
        SELECT relation, count(*) AS n, count(DISTINCT l_partkey) AS heads, count(DISTINCT l_suppkey) AS tails FROM (
            SELECT l_returnflag AS relation, l_partkey, l_suppkey FROM lineitem UNION ALL SELECT 'is' || l_linestatus, l_partkey, l_suppkey FROM lineitem) GROUP BY relation""",
}
