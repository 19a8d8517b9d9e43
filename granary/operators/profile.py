"""Profiles of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import word_count
from granary.operators.layout import dealt, running


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n and its percentage to one decimal."""
    counts = value_counts(df, column)
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).withColumn("pct", F.round(100 * F.col("n") / F.col("_all"), 1)).drop("_all")


def placed_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before, total: how often each value occurs, how many rows of its group are smaller, and how many there are; null does not count."""
    return running(rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, [value], "n")


def percentile(share: float, value: str, among: Column | None = None) -> Column:
    """Aggregate over ``placed_counts``: the percentile between its two neighbours, which no task has to sort for."""
    place = share * (F.col("total") - 1)
    inside = F.lit(True) if among is None else among
    at = lambda p: F.max(F.when(inside & (F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col(value).cast("double")))
    part = F.max(F.when(inside, place - F.floor(place)))
    return at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * part


def length_stats(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Mean (one decimal), median, least and greatest number of words and characters."""
    size = {"words": word_count(text), "chars": F.char_length(F.coalesce(text, F.lit(""))).cast("long")}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), v.alias("_size")) for k, v in size.items()])).alias("_c")
    sizes = placed_counts(dealt(df.select(*by, text)).select(*by, cells).select(*by, "_c.*"), [*by, "_kind"], "_size")
    figures = []
    for c in size:
        own = F.col("_kind") == c
        among = lambda x, own=own: F.when(own, x)
        mean = F.sum(among(F.col("_size") * F.col("n"))) / F.sum(among(F.col("n")))
        figures += [F.round(mean, 1).alias(f"{c}_mean"), percentile(0.5, "_size", own).alias(f"{c}_median"), F.min(among(F.col("_size"))).alias(f"{c}_min"), F.max(among(F.col("_size"))).alias(f"{c}_max")]
    return sizes.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_kind") == "words", F.col("n"))), F.lit(0)).alias("n"), *figures)


def distinct_ratio(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_distinct"), F.count(F.lit(1)).alias("n")).withColumn("ratio", F.when(F.col("n") > 0, F.col("n_distinct") / F.col("n")).otherwise(F.lit(0.0)))


def crosstab(df: DataFrame, a: str, b: str, margin: str = "All") -> DataFrame:
    """a, b, n with the margins of both."""
    cube = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).cube("a", "b").agg(F.sum("n").alias("n"), F.grouping("a").alias("_a"), F.grouping("b").alias("_b"))
    name = lambda c: F.when(F.col(f"_{c}") == 1, F.lit(margin)).otherwise(F.col(c).cast("string"))
    return cube.select(name("a").alias("a"), name("b").alias("b"), "n")


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, non_null, nulls, null_pct, n_distinct.

    One pass: a row becomes a cell per column, which holds a 96-bit hash of its
    value, and only distinct cells are shuffled.
    """
    cells = [F.struct(F.lit(i).alias("i"), F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("h"), F.when(F.col(c).isNotNull(), F.hash(c)).alias("g")) for i, c in enumerate(f"`{c}`" for c in df.columns)]
    distinct = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.i", "c.h", "c.g").agg(F.count(F.lit(1)).alias("n"))
    found = distinct.groupBy("i").agg(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))).alias("full"), F.sum("n").alias("all"), F.count("h").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "i int, column string, type string")
    full, n = F.coalesce("full", F.lit(0)), F.coalesce("all", F.lit(0))
    return names.join(found, "i", "left").select("column", "type", full.alias("non_null"), (n - full).alias("nulls"), F.round(F.when(n > 0, 100.0 * (n - full) / n).otherwise(0.0), 2).alias("null_pct"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows, and keys, beyond their first occurrence."""
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_keys"))
    return whole.crossJoin(ids)


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """column, count, mean, std, min, quartiles (interpolated), max."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.*")
    plain = cells.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quarters = placed_counts(cells, ["column"], "x").groupBy("column").agg(*[percentile(p / 100, "x").alias(f"p{p}") for p in (25, 50, 75)])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(plain, "column", "left").join(quarters, "column", "left").select("column", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def turns(dialogues: DataFrame, key: str, turn_list: str) -> DataFrame:
    """A row per turn with its number from 1; dialogues without turns give none."""
    return dialogues.select(*[c for c in dialogues.columns if c != turn_list], F.posexplode(turn_list).alias("_at", "_turn")).select(*[c for c in dialogues.columns if c != turn_list], (F.col("_at") + 1).cast("long").alias("turn_number"), "_turn.*")


def group_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median (one decimal) and greatest of a group's values."""
    plain = df.groupBy(*by).agg(F.count(value).alias("count"), F.round(F.avg(value), 1).alias("mean"), F.max(value).alias("max"))
    middle = placed_counts(df, by, value).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.round(percentile(0.5, value), 1).alias("median"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return plain.join(middle, same, "left").select(*by, "count", "mean", "median", "max")


def search(df: DataFrame, text: str, query: str, limit: int = 20, order: str | None = None) -> DataFrame:
    """Rows whose text holds the query, up to case: the first ``limit``."""
    found = df.filter(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(query.lower())))
    return (found.orderBy(order) if order else found).limit(limit)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def size_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_b"))).withColumn("ratio", F.when(F.col("n_b") > 0, F.col("n_a") / F.col("n_b")).otherwise(F.lit(0.0)))
