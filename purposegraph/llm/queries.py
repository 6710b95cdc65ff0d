"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, embedding_dedup, line_dedup, minhash, packing, pii, pitman_yor, quality, ranked_search, secret_scan, token_count, vector_codes

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, digest=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir), settings=pitman_yor.Settings(burn=1))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_token_counts, op3_pii, op4_bpe_codec, op5_quality_rules, op6_secret_scan, op7_packing, op8_embedding_dedup, op9_lm_scores, op10_minhash_dedup,
        op11_ranked_search, op12_vector_codes, op13_decontaminate,
    )
}
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _nearest(k: int) -> str:
    """SQL: a{k}, the nearest entry of codebook c{k} for each vector's part in x."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"a{k} AS (SELECT vec_id, p, z.e AS e, z.d AS d, v FROM (SELECT vec_id, x.p AS p, any_value(x.v) AS v, min({{'d': {far}, 'e': c.e}}) AS z FROM x JOIN c{k} c ON x.p = c.p GROUP BY vec_id, x.p))"


def _round(k: int, following: int) -> str:
    """SQL: a{k}, and c{following} of the floored means of what it assigns."""
    mean = f"SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(v[i]) / count(*)::DOUBLE)::BIGINT AS m FROM a{k}, range(1, 513) AS r(i) WHERE i <= len(v) GROUP BY p, e, i) GROUP BY p, e"
    return f"{_nearest(k)}, m{k} AS ({mean}), c{following} AS (SELECT p, e, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (p, e))"


ORACLES: dict[str, str] = {
    "op8_embedding_dedup": """
        WITH RECURSIVE
        v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.98),
        reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
        component AS (SELECT v, min(r) AS c FROM reach GROUP BY v),
        degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
        FROM embeddings JOIN component ON vec_id = v LEFT JOIN degree ON vec_id = a""",
    "op10_minhash_dedup": """
        WITH RECURSIVE
        w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
            FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM overlap WHERE 100 * k >= 75 * (na + nb - k)),
        reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
        component AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN component ON doc_id = v""",
    "op11_ranked_search": rf"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM documents),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
        items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM benchmark),
        tf AS (SELECT doc_id, t, count(*) AS tf FROM t WHERE t IN (SELECT t FROM items) GROUP BY doc_id, t),
        w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, stats GROUP BY t, docs),
        part AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS s FROM tf JOIN n USING (doc_id) JOIN w USING (t), stats),
        scored AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM part JOIN items USING (t) GROUP BY item_id, doc_id HAVING sum(s) > 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op12_vector_codes": f"""
        WITH good AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM good, range(16) AS r(p)),
        c0 AS (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM good ORDER BY vec_id LIMIT 64) USING (vec_id)),
        {_round(0, 1)}, {_round(1, 2)}, {_nearest(2)},
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 JOIN good USING (vec_id) GROUP BY vec_id, label),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books""",
    "op13_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
        grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))),
        hits AS (SELECT doc_id, item_id, i, k FROM grams JOIN windows USING (k, g)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
