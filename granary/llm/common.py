"""Shared helpers: table access, written intermediate tables, Arrow building blocks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from granary.sources.paths import new_path, shared_dir  # noqa: F401  the operators take them from here


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` or ``bucketed`` once nothing reads it any more."""
    path, spark = getattr(df, "_granary_path", None), df.sparkSession
    if name := getattr(df, "_granary_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The whole texts of a batch; null becomes the empty text."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def release() -> None:
    """Give freed memory back to the system, so that workers kept for later tasks stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``max_bytes`` of data or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        per_row = max(1, batch.nbytes // batch.num_rows)
        step = max(1, max_bytes // per_row)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    release()


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key``: later joins on it move the other side only."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._granary_path, out._granary_table = path, name
    return out


SPACE_BYTE = re.compile(rb"[ \t-\r]")
SPACE_CHAR = re.compile("[ \t-\r]")
LONG = 1 << 20


def cut_at_spaces(text, size: int = LONG):
    """Pieces of about ``size`` that begin at ASCII white space, so no word is cut and very long texts need little work space."""
    spaces = SPACE_BYTE if isinstance(text, bytes) else SPACE_CHAR
    start = 0
    while len(text) - start > size:
        found = spaces.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]
