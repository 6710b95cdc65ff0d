"""The stateless stages on streams, and once-only processing of keys. An extension: the batch operators serve streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import concepts, parsing
from ..sources.key_cache import KeyCache


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def once_per_key(prompts: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Each key's first row; keys are remembered for the delay, so state stays bounded."""
    return prompts.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def annotated(sentences: DataFrame, annotator=parsing.simple_annotator) -> DataFrame:
    return parsing.annotate(sentences, annotator)


def seeded(events: DataFrame) -> DataFrame:
    """Events with their words after the seed rule."""
    return events.withColumn("seeded", concepts.seeded(events["words"], events["ners"]))


def conceptualized(events: DataFrame, write, taxonomy: DataFrame, k: int = 3):
    """A query that conceptualizes each micro-batch against the static taxonomy and hands the result to write(df, batch id)."""
    return events.writeStream.foreachBatch(lambda batch, i: write(concepts.conceptualize(batch, taxonomy, k), i))


def once_ever(prompts: DataFrame, cache: KeyCache, write):
    """A stream of prompts of which each key is answered once for all time, across restarts: write(df, batch id) gets each micro-batch's first
    rows of keys that no earlier batch has cached, and their keys are cached after it. A batch that is repeated gives the same rows; write
    should be idempotent by batch id. Unlike once_per_key, nothing is kept in state."""

    def step(batch: DataFrame, i: int) -> None:
        new = cache.missing(batch.dropDuplicates(["key"]), i)
        write(new, i)
        cache.add(new, i)

    return prompts.writeStream.foreachBatch(step)
