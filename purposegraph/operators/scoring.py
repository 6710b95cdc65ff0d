"""Scored assertions: relabelling, metrics, precision-recall curves, thresholds, and a default scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import numbered

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)


def relabel(scored: DataFrame, threshold: float) -> DataFrame:
    """prediction: v from the threshold on, else i."""
    return scored.withColumn("prediction", F.when(F.col("score") >= threshold, "v").otherwise("i"))


def with_label(assertions: DataFrame, order: list | None = None) -> DataFrame:
    """label from majority_answer, else from quality; without either dummy ones, v and i in turn by the given order (by default all columns)."""
    for name in ("majority_answer", "quality"):
        if name in assertions.columns:
            return assertions.withColumnRenamed(name, "label")
    rows = numbered(assertions, order or [F.col(f"`{c}`") for c in assertions.columns], "__number")
    return rows.withColumn("label", F.when(F.col("__number") % 2 == 0, "v").otherwise("i")).drop("__number")


def _ratios(df: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumn("accuracy", div(tp + tn, tp + fp + fn + tn)).withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, fn, tn, accuracy, precision, recall, f1): one pass over the scores, all thresholds as columns of one aggregate."""
    v, sums = F.col("label") == "v", []
    for i, t in enumerate(thresholds):
        p = F.col("score") >= t
        sums += [F.sum(c.cast("long")).alias(f"{n}{i}") for n, c in (("tp", v & p), ("fp", ~v & p), ("fn", v & ~p), ("tn", ~v & ~p))]
    one = scored.agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.coalesce(F.col(f"{n}{i}"), F.lit(0)).alias(n) for n in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    return _ratios(one.select(F.explode(rows).alias("x")).select("x.*"))


def score_range(scored: DataFrame, ranges: int):
    """A function that adds cell, the range that a score falls into, counted from below: cuts are quantiles from a sketch, so ranges hold about as many rows each whatever
    the scale of the scores; a score that many rows share is in one range."""
    from pyspark.ml.feature import Bucketizer

    found = scored.approxQuantile("score", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    cuts = sorted({x for x in found if abs(x) < float("inf")})
    return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="score", outputCol="cell").transform if cuts else lambda df: df.withColumn("cell", F.lit(0.0))


def pr_curve(scored: DataFrame, ranges: int = 1024) -> DataFrame:
    """(threshold, tp, fp, precision, recall) for each distinct score, counted from above. Scores may be any doubles, infinite ones too.

    Scores are pre-aggregated to counts; running sums are taken within ranges of the score and added to the totals of
    the ranges above, so no single task holds all scores. Rows whose score is null or NaN are never retrieved: they
    make no point, but their v count in the total that recall is of.
    """
    v = (F.col("label") == "v").cast("long")
    rows = scored.withColumn("score", F.col("score").cast("double"))
    known = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    counts = score_range(known, ranges)(known.groupBy("score").agg(F.sum(v).alias("pos"), F.sum(1 - v).alias("neg")))
    cells = counts.groupBy("cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    cells = cells.select("cell", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    total = rows.agg(F.coalesce(F.sum(v), F.lit(0)).alias("all_p"))
    own = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("tp", F.sum("pos").over(own)).withColumn("fp", F.sum("neg").over(own)).join(cells, "cell").join(F.broadcast(total))  # one row
    tp, fp = F.col("tp") + F.col("p0"), F.col("fp") + F.col("n0")
    return run.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (tp / (tp + fp)).alias("precision"), (tp / F.greatest(F.col("all_p"), F.lit(1))).alias("recall"))


def precision_at_recall(curve: DataFrame, targets) -> DataFrame:
    """(target, threshold, precision, recall): for each target the first point, by rising threshold, whose recall is at most the target."""
    spark = curve.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(float(t),) for t in targets], "target double"))  # as many rows as targets given
    point = F.min(F.struct("threshold", "precision", "recall"))
    return curve.join(wanted, F.col("recall") <= F.col("target")).groupBy("target").agg(point.alias("x")).select("target", "x.*")


def mean_squared_error(scored: DataFrame, prediction: str, label: str) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col(prediction) - F.col(label), 2)).alias("mse"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The feature to run on the first n rows only, by a stated order."""
    return df.orderBy(*order).limit(n)


def train_scorer(labelled: DataFrame, features: int = 1 << 16, iterations: int = 50):
    """A logistic-regression scorer on hashed words of `assertion` for label v or i: a pyspark.ml pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer

    stages = [
        RegexTokenizer(inputCol="assertion", outputCol="__words", pattern=r"\W+"),
        HashingTF(inputCol="__words", outputCol="__features", numFeatures=features),
        StringIndexer(inputCol="label", outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled.select("assertion", "label").na.fill("", ["assertion"]))


def predict(model, assertions: DataFrame) -> DataFrame:
    """assertions with prediction (v or i) and score, the probability of v."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assertions.withColumn("label", F.lit("i")).na.fill("", ["assertion"]))
    score = vector_to_array("probability")[1]
    return out.select(*[F.col(f"`{c}`") for c in assertions.columns if c not in ("score", "prediction")], score.alias("score"), F.when(score >= 0.5, "v").otherwise("i").alias("prediction"))
