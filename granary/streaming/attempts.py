"""The append-only attempt log, resuming from it, and latest-wins notes, as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.layout import drop_folder, folders
from granary.streaming.keyed import KeyedTable


def follow(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has come to the log, each row once, and stop when all is in."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def remaining(planned: DataFrame, log: DataFrame, *keys: str) -> DataFrame:
    """Planned work without an attempt in the log."""
    return planned.join(log.select(*keys).distinct(), list(keys), "left_anti")


def all_attempted(planned: DataFrame, log: DataFrame, *keys: str) -> bool:
    return remaining(planned, log, *keys).isEmpty()


def tallies() -> list[Column]:
    """accepted, rejected, errors, skipped and attempts (all but the skipped)."""
    kinds = {"accepted": "accepted", "rejected": "rejected", "errors": "error", "skipped": "skipped"}
    return [*[F.count_if(F.col("status") == v).alias(k) for k, v in kinds.items()], F.count_if(F.col("status") != "skipped").alias("attempts")]


def counters(log: DataFrame, *by: str, planned: DataFrame | None = None, before: DataFrame | None = None, keys: tuple[str, ...] = ("label", "chunk_id")) -> DataFrame:
    """accepted, rejected, errors and attempts; with ``planned`` also skipped: planned work that the log had before."""
    kinds = {"accepted": "accepted", "rejected": "rejected", "errors": "error"}
    counts = log.groupBy(*by).agg(*[F.count_if(F.col("status") == v).alias(k) for k, v in kinds.items()], F.count(F.lit(1)).alias("attempts"))
    if planned is None or before is None:
        return counts
    skipped = planned.join(before.select(*by, *keys).distinct(), [*by, *keys], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("skipped"))
    return counts.join(skipped, list(by), "full").na.fill(0)


def may_resume(stored: str | None, now: str) -> bool:
    """A run goes on only over the input it began with (its fingerprint)."""
    return stored is None or stored == now


def keep_latest(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Fold each batch into a ``KeyedTable``; a batch that is repeated changes nothing."""
    held = KeyedTable(stream.sparkSession, folder, key, order)
    return stream.writeStream.foreachBatch(held.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, key: str, order: str) -> DataFrame:
    """What ``keep_latest`` has folded so far."""
    return KeyedTable(spark, folder, key, order).latest()


def summarise(stream: DataFrame, folder: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Counters of a run kept by a stateful stream: they go on from the checkpoint after any stop.

    The counters after batch n lie in ``after=n``; the last but one goes with the next.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        for name in folders(spark, folder, done=False):
            if int(name.removeprefix("after=")) < number - 1:
                drop_folder(spark, f"{folder}/{name}")
        batch.write.mode("overwrite").parquet(f"{folder}/after={number}")

    counts = stream.groupBy(*by).agg(*tallies())
    return counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of ``summarise`` after the newest batch."""
    newest = max(int(name.removeprefix("after=")) for name in folders(spark, folder))
    return spark.read.parquet(f"{folder}/after={newest}")
