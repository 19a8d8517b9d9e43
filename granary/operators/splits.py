"""Train, dev and test sets from a labelled corpus and an augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import label_text
from granary.operators.ensemble import refuse


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, which must have the columns (more are fine)."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns {missing}")
    return df


def with_label_ids(rows: DataFrame, taxonomy: DataFrame, label: str = "label", check: bool = True) -> DataFrame:
    """Adds label_id and parent; with ``check``, labels outside the taxonomy raise."""
    dims = taxonomy.select(F.col("label").alias(label), "label_id", "parent_id", "parent")
    if check:
        refuse(rows.join(dims, label, "left_anti").select(label).distinct(), "labels outside the taxonomy")
    return rows.join(F.broadcast(dims), label, "left")  # one row per label of the taxonomy


def unknown_labels(rows: DataFrame, taxonomy: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(taxonomy.select(F.col("label").alias(label)), label, "left_anti").select(label).distinct()


def build_splits(corpus: DataFrame, augmentation: DataFrame | None = None, dev_in_train: bool = True, positive: str = "sexist") -> DataFrame:
    """part (train, dev, test), ord, text, label: train rows, then augmentation, then dev rows if asked for.

    corpus: text, label_sexist, label, split, ord; augmentation: text, label, ord.
    """
    rows = corpus.filter((F.col("label_sexist") == positive) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    rows = rows.select("split", "ord", "text", label_text("label").alias("label"))
    pieces = [rows.filter("split = 'train'").withColumn("piece", F.lit(0))]
    if augmentation is not None:
        pieces.append(augmentation.select(F.lit("train").alias("split"), "ord", "text", label_text("label").alias("label"), F.lit(1).alias("piece")))
    if dev_in_train:
        pieces.append(rows.filter("split = 'dev'").withColumn("piece", F.lit(2)))
    train = pieces[0]
    for p in pieces[1:]:
        train = train.unionByName(p)
    parts = train.withColumn("part", F.lit("train"))
    for name in ("dev", "test"):
        parts = parts.unionByName(rows.filter(F.col("split") == name).withColumn("piece", F.lit(0)).withColumn("part", F.lit(name)))
    return parts.select("part", "piece", "ord", "text", "label")


def test_slice(corpus: DataFrame, expected: int) -> DataFrame:
    """The test rows of the positive class, whose number must be as expected."""
    rows = corpus.filter("split = 'test' AND label_sexist = 'sexist'")
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} test rows instead of {expected}")
    return rows
