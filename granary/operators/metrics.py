"""Quality figures from gold and predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ensemble import refuse


def confusion(rows: DataFrame, labels: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """gold, pred, n over the whole grid of labels (the stated set), zeros included."""
    names = labels.select("label").distinct()
    grid = names.withColumnRenamed("label", "gold").crossJoin(F.broadcast(names.withColumnRenamed("label", "pred")))
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["gold", "pred"], "left").na.fill(0, ["n"])


def class_report(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """label, precision, recall, f1, support over the labels of gold or pred; 0 where nothing is divided."""
    both = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("g").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)
    long = both.select(F.col("g").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("hits")).unionByName(both.select(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits")))
    sums = long.groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("support", "predicted", "hits")])
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits")


def f1_summary(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """accuracy, macro_f1, weighted_f1 and n."""
    report = class_report(rows, gold, pred)
    total = F.sum("support")
    return report.agg((F.sum("hits") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), total.alias("n"))


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a class report."""
    total = F.sum("support")
    macro = report.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    weighted = report.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    return macro.unionByName(weighted)


def class_weights(rows: DataFrame, label: str, labels: DataFrame | None = None) -> DataFrame:
    """label, n, weight = rows / (classes * n).  With ``labels``, one that has no row raises."""
    if labels is not None:
        refuse(missing_classes(rows, labels, label), "classes without a row")
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(whole)).select("label", "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def missing_classes(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Labels without a row: their weight would be infinite."""
    return labels.select("label").distinct().join(rows.select(F.col(label).alias("label")).distinct(), "label", "left_anti")
