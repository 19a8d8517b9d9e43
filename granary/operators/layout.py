"""How rows lie over tasks; nothing here changes a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.paths import new_path

SMALL = 16 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A table of less than 16 MB per core lies in few row groups, so its work would fall to few tasks: deal it over all cores.  Larger ones stay as they are."""
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: made once, and joins with it can be split where a key is hot."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing reads it any more."""
    path = getattr(df, "_granary_path", None)
    if path:
        drop_folder(df.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def folders(spark: SparkSession, path: str, done: bool = True) -> list[str]:
    """Names of what lies in a folder; with ``done`` only folders with a writer's success mark."""
    sc = spark.sparkContext
    new = sc._jvm.org.apache.hadoop.fs.Path
    root = new(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if not done or fs.exists(new(s.getPath(), "_SUCCESS")))


def running(rows: DataFrame, by: list[str], order: list[str], amount: str) -> DataFrame:
    """``rows`` with before (the sum of ``amount`` over the rows that stand earlier in their group) and total (over the group).

    Rows are dealt by ranges of group and order, so a hot group lies in many
    ranges; only one sum per range meets in a window.  Stores the dealt rows.
    """
    placed = stored(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "running")
    earlier = (Window.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(*earlier)), F.lit(0)))
    sums = placed.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum"))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(*earlier)), F.lit(0)).alias("_offset"), F.sum("_sum").over(group).alias("total"))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(offsets, same).withColumn("before", F.col("_own") + F.col("_offset")).drop("_part", "_at", "_own", "_offset", *[f"_{c}" for c in by])
