"""Classification quality from pairs of true and predicted classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def confusion(pairs: DataFrame, true: str = "label", predicted: str = "prediction", normalize: str | None = None) -> DataFrame:
    """Counts per (true, predicted), or shares of the true class, the predicted class or all rows.

    Rows are counted first; the shares are computed on at most one row per class pair.
    """
    counts = pairs.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    if normalize is None:
        return counts
    over = {"true": Window.partitionBy("true"), "pred": Window.partitionBy("predicted"), "all": Window.partitionBy(F.lit(0))}
    return counts.select("true", "predicted", (F.col("n") / F.sum("n").over(over[normalize])).alias("share"))


def confusion_matrix(counts: DataFrame, classes: list, value: str = "n") -> DataFrame:
    """Wide matrix with one row per true class."""
    return counts.groupBy("true").pivot("predicted", classes).agg(F.first(value)).fillna(0)


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts; 0 where undefined."""
    per = counts.select(F.col("true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"),
                        F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        counts.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                      F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hit")))
    sums = per.groupBy("class").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    both = F.col("support") + F.col("chosen")
    return sums.select("class", share("hit", "chosen").alias("precision"), share("hit", "support").alias("recall"),
                       F.coalesce(F.try_divide(2 * F.col("hit"), both), F.lit(0.0)).alias("f1"), "support", "hit")


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class rows and the rows `accuracy`, `macro avg` and `weighted avg`."""
    rows = class_scores(counts)
    names = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in names], total)
    weighted = rows.agg(*[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], total)
    share = F.try_divide(F.sum("hit"), F.sum("support"))
    accuracy = rows.agg(*[share.alias(c) for c in names], total)
    shape = lambda df, name: df.select(F.lit(name).alias("class"), *names, "support")
    return rows.select(F.col("class").cast("string").alias("class"), *names, "support").unionByName(
        shape(accuracy, "accuracy")).unionByName(shape(macro, "macro avg")).unionByName(shape(weighted, "weighted avg"))


def scores(counts: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 in one row."""
    return class_scores(counts).agg(
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def long_report(report: DataFrame) -> DataFrame:
    """(class, metric, value) rows of a report."""
    names = ("precision", "recall", "f1", "support")
    return report.select("class", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(
        "class", "m.metric", "m.value")
