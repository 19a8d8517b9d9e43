"""Integrity checks and look-ups that a run makes before it starts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.ensemble import refuse


def check_chunks(chunks: DataFrame) -> None:
    """Chunk ids are there and unique, texts are not empty."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    refuse(chunks.filter(blank("chunk_id") | blank("text")).select("chunk_id"), "chunks without id or text")
    refuse(chunks.groupBy("chunk_id").count().filter("count > 1"), "repeated chunk ids")


def check_index(chunks: DataFrame, index: DataFrame) -> None:
    """Chunks and their vectors name the same ids."""
    both = chunks.select("chunk_id", F.lit(1).alias("_a")).join(index.select("chunk_id", F.lit(1).alias("_b")), "chunk_id", "full")
    refuse(both.filter("_a IS NULL OR _b IS NULL").select("chunk_id"), "chunks and vectors differ")


def check_profiles(profiles: DataFrame, labels: DataFrame) -> None:
    """Every label has a profile with a definition."""
    known = profiles.filter(F.length(F.trim(F.coalesce("definition", F.lit("")))) > 0)
    refuse(labels.join(known, "label", "left_anti").select("label"), "labels without definition")


def shared_labels(asked: DataFrame, retrieved: DataFrame, profiles: DataFrame) -> DataFrame:
    """The labels asked for, each of which must be retrieved and have a profile."""
    for name, other in (("retrieved", retrieved), ("profiled", profiles)):
        refuse(asked.join(other.select("label").distinct(), "label", "left_anti").select("label"), f"labels not {name}")
    return asked.select("label").distinct()


def point(rows: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """The first row of a key, which must exist."""
    found = rows.filter(F.col(key) == value).orderBy(order).limit(1)
    if found.isEmpty():
        raise ValueError(f"no {key} {value}")
    return found


def _files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Path and size of every file below a folder of the session's file systems, or of the file itself."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen()))
    return out


def resolve_checkpoint(spark: SparkSession, root: str, name: str) -> str:
    """A model file under ``root``: in a folder of the name, beside it, or the only one anywhere below."""
    found = sorted(p for p, _ in _files(spark, root) if p.endswith(f"/{name}"))
    base = root.rstrip("/")
    for direct in (f"{base}/{name}/{name}", f"{base}/{name}"):
        if hits := [p for p in found if p.endswith(direct)]:
            return hits[0]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files named {name} under {root}")
    return found[0]


def is_complete(spark: SparkSession, paths: list[str]) -> bool:
    """All artifacts of a run are there and hold something."""
    return all(sum(n for _, n in _files(spark, p)) > 0 for p in paths)


def label_names(config: dict[int, str], taxonomy: list[str]) -> dict[int, str]:
    """A model's own label names, or the taxonomy's where it has only place-holders."""
    if all(v.lower().startswith("label_") for v in config.values()):
        return dict(enumerate(taxonomy))
    return config


def metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, accuracy, macro_f1, weighted_f1 of all metric files that match."""
    rows = spark.read.option("multiLine", True).schema("accuracy double, macro_f1 double, weighted_f1 double").json(pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), "*")


def clamp(position: int, n: int) -> int:
    return max(0, min(position, n - 1))


def clamped(position: Column, n: int) -> Column:
    """The same for a column."""
    return F.greatest(F.lit(0), F.least(position, F.lit(n - 1)))


def sorted_distinct(rows: DataFrame, column: str) -> DataFrame:
    """The different values, sorted."""
    return rows.select(column).distinct().orderBy(column)
