"""Readers and writers of the formats that the stages exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import PUNCTUATION
from ..operators import concepts, recommend
from ..operators.matching import Pattern

RAW, GENERATED = "sid string, text string", "text string, key string, output array<string>"
TRIPLES = "array<array<string>>"
EVENTS = "eid string, words array<string>, ners array<string>, pos_tags array<string>, phrases array<string>, phrase_ners array<string>, phrase_tags array<string>"


def item_meta_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(asin, title, cate, top_cate, line) of lines `asin \\t title \\t categories...`, stripped; cate has the fields after the title, and
    top_cate is what stands before the first pipe of them joined by blanks. line orders the lines of all files by file name and place."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t").alias("p"), at.alias("line"))
    cate = F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))
    rest = F.array_join(cate, " ")
    return rows.where(F.size("p") >= 2).select(F.get("p", 0).alias("asin"), F.get("p", 1).alias("title"), cate.alias("cate"), F.substring_index(rest, "|", 1).alias("top_cate"), "line")


def item_meta_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows without repeats; an asin that still occurs twice is an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').dropDuplicates()
    twice = rows.groupBy("asin").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"asin occurs again: {twice[0]['asin']}")
    return rows


def pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="item_a string, item_b string")


def assertions_csv(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """The columns that a stage needs, with row, an id in file order."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select("item_a_id", "relation", "item_b_id", "assertion", *more, F.monotonically_increasing_id().alias("row"))


def raw_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def parsed_sentences(spark: SparkSession, path: str, relation: str | None = None) -> DataFrame:
    """Parsed sentences of JSON lines; header lines go, and dependencies may be arrays [gov, rel, dep]. relation: only files of exactly that relation."""
    kinds = "sid string, text string, tokens array<string>, lemmas array<string>, pos_tags array<string>, ners array<string>, mentions array<struct<start:int,end:int,text:string,ner:string>>, dependencies array<array<string>>"
    rows = spark.read.schema(kinds).json(path)
    if relation is not None:
        rows = rows.where(F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1) == relation)
    deps = F.transform("dependencies", lambda d: F.struct(d[0].cast("int").alias("gov"), d[1].alias("rel"), d[2].cast("int").alias("dep")))
    return rows.where("tokens is not null").withColumn("dependencies", deps)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_generated(df: DataFrame, path: str) -> None:
    """Adds completions; the folder's keys are the cache that later prompts are checked against."""
    df.select("text", "key", "output").write.mode("append").json(path)


def key_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENERATED).json(path).select("key").distinct()


def taxonomy_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="concept string, instance string, freq int")


def predictions_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="index int, label string, prediction string, score double")


def write_predictions(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; scores with five decimals."""
    df.select("index", "label", "prediction", F.format_string("%.5f", "score").alias("score")).write.csv(path, sep="\t", header=True)


def ratings(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(item, user, rating, split) of Parquet, with split as a partition column."""
    out = spark.read.parquet(path)
    return out if split is None else out.where(F.col("split") == split)


def write_metrics(best: DataFrame, path: str) -> None:
    """The runs' test errors with mean and deviation, one JSON line."""
    write_json(recommend.report(best), path)


def conceptualize_file(spark: SparkSession, source: str, target: str, taxonomy: DataFrame, k: int = 3, start: int = 0) -> None:
    """Events of JSON lines to their concepts as JSON lines (eid, concept, cid, score)."""
    write_json(concepts.conceptualize(spark.read.schema(EVENTS).json(source), taxonomy, k, start), target)


def kg_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("key", "features").write.mode(mode).parquet(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path; computed and written first where there is none. Existence is asked of the path's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parse_patterns(text: str, fuzzy: bool = False) -> list[Pattern]:
    """Patterns of the text form: `t # freq`, `v id label`, `e u v label`. Punctuation vertices go, labels end at their colon; fuzzy shortens NN*, RB* and JJ*."""
    out: list[Pattern] = []
    for block in text.split("t #")[1:]:
        head, *lines = block.strip().split("\n")
        labels = {int(i): x for i, x in (line.split(" ")[1:3] for line in lines if line.startswith("v "))}
        arcs = [(int(u), x.split(":")[0], int(v)) for u, v, x in (line.split(" ")[1:4] for line in lines if line.startswith("e "))]
        stay = [i for i in sorted(labels) if labels[i] not in PUNCTUATION]
        at = {x: i for i, x in enumerate(stay)}
        short = lambda x: next((p for p in ("NN", "RB", "JJ") if fuzzy and x.startswith(p)), x)
        if stay:
            out.append(Pattern(tuple(short(labels[i]) for i in stay), tuple((at[u], x, at[v]) for u, x, v in arcs if u in at and v in at), int(head.strip())))
    return out


def read_patterns(spark: SparkSession, path: str, fuzzy: bool = False) -> list[Pattern]:
    """Pattern files are the engine's small dictionary; they are read whole."""
    texts = spark.read.text(path, wholetext=True).collect()
    return [p for r in texts for p in parse_patterns(r["value"], fuzzy)]


def pattern_text(patterns: list[Pattern]) -> str:
    """The text form, by falling frequency."""
    out = []
    for p in sorted(patterns, key=lambda p: -p.freq):
        out.append(f"t # {p.freq}")
        out += [f"v {i} {x}" for i, x in enumerate(p.labels)]
        out += [f"e {u} {v} {x}" for u, x, v in p.edges]
    return "".join(f"{line}\n" for line in out)


def write_patterns(spark: SparkSession, patterns: list[Pattern], path: str) -> None:
    spark.createDataFrame([(pattern_text(patterns).rstrip("\n"),)], "value string").coalesce(1).write.text(path)


PATTERN_ROWS = "labels array<string>, edges array<struct<u:int,label:string,v:int>>, freq long"


def pattern_table(spark: SparkSession, path: str, fuzzy: bool = False) -> DataFrame:
    """(labels, edges, freq) of pattern files as rows, for libraries that the driver should not hold: files are split at record marks,
    large ones among many tasks, and records are read by column functions. The rules are those of parse_patterns; empty files and
    records without a vertex give no row."""
    records = spark.read.option("lineSep", "\nt #").text(path)
    lines = F.transform(F.split(F.regexp_replace("value", r"^t #", ""), "\n"), lambda x: F.split(F.trim(x), " "))
    rows = records.select(lines.alias("lines")).select(F.expr("TRY_CAST(lines[0][0] AS LONG)").alias("freq"), "lines")
    of_kind = lambda kind: F.filter("lines", lambda x: (F.get(x, F.lit(0)) == kind) & (F.size(x) > 2))
    short = lambda x: F.when(x.startswith("NN"), "NN").when(x.startswith("RB"), "RB").when(x.startswith("JJ"), "JJ").otherwise(x)
    vertices = F.array_sort(F.transform(of_kind("v"), lambda x: F.struct(x[1].cast("int").alias("i"), x[2].alias("label"))))
    arcs = F.transform(of_kind("e"), lambda x: F.struct(x[1].cast("int").alias("u"), F.substring_index(x[3], ":", 1).alias("label"), x[2].cast("int").alias("v")))
    stay = F.filter(vertices, lambda x: ~x["label"].isin(*PUNCTUATION))
    rows = rows.select("freq", F.transform(stay, lambda x: x["i"]).alias("ids"), F.transform(stay, lambda x: short(x["label"]) if fuzzy else x["label"]).alias("labels"), arcs.alias("arcs"))
    at = lambda x: (F.array_position("ids", x) - 1).cast("int")
    kept = F.filter("arcs", lambda e: F.array_contains("ids", e["u"]) & F.array_contains("ids", e["v"]))
    edges = F.transform(kept, lambda e: F.struct(at(e["u"]).alias("u"), e["label"].alias("label"), at(e["v"]).alias("v")))
    return rows.where(F.size("labels") > 0).select("labels", edges.cast("array<struct<u:int,label:string,v:int>>").alias("edges"), "freq")


def write_pattern_table(patterns: DataFrame, path: str) -> None:
    """The text form of (labels, edges, freq), sorted by falling frequency over all files in the order of their names."""
    vertices = F.transform("labels", lambda x, i: F.concat_ws(" ", F.lit("v"), i, x))
    arcs = F.transform("edges", lambda e: F.concat_ws(" ", F.lit("e"), e["u"], e["v"], e["label"]))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("t # "), F.col("freq").cast("string"))), vertices, arcs), "\n")
    patterns.orderBy(F.desc("freq"), "labels", "edges").select(text.alias("value")).write.text(path)
