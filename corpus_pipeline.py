"""The corpus pipeline: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes the documents that the one before kept, written as Parquet and read again, and works on all of them.
All but the last return the columns of documents, n_chars being the length of the text as it is then. Further columns are
carried along, whatever they are called. A null or empty text fails the quality rules, so none comes to the later stages
but for texts that line dedup has emptied, which near-dedup links with nothing and packing gives one end id each. An empty
table gives empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purposegraph.llm import line_dedup, minhash, packing, pii, quality
from purposegraph.llm.common import mark, shared_dir, sweep


def _same_columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has too are deleted; a document stays, if need be with an empty text."""
    return _same_columns(line_dedup.dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return minhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    return _same_columns(pii.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4,096 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: Posterior probabilities, patience diff and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/purposegraph-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        sweep(spark, since)  # what the stage has stored on its way
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
