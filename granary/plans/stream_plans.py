"""Queries over the attempt log: counters, resuming, and the same as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.base import query, table
from granary.sources.paths import new_path
from granary.streaming import attempts

KINDS = "CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'error' END"


def _log(events: DataFrame) -> DataFrame:
    """Events as attempts."""
    n = F.pmod("event_id", F.lit(3))
    return events.select("event_id", "user_id", F.col("event_type").alias("model_alias"), F.when(n == 0, "accepted").when(n == 1, "rejected").otherwise("error").alias("status"))


@query(f"SELECT event_type AS model_alias, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'error') AS errors, count(*) AS attempts FROM (SELECT event_type, {KINDS} AS s FROM events) GROUP BY event_type")
def attempt_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.counters(_log(table(spark, sf_dir, "events")), "model_alias")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any event are what remains to be done."""
    planned = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return attempts.remaining(planned, _log(table(spark, sf_dir, "events")), "user_id")


@query(f"SELECT event_type AS model_alias, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'error') AS errors, count(*) AS attempts FROM (SELECT event_type, {KINDS} AS s FROM events) GROUP BY event_type")
def stream_attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended by a stream that runs twice; the second run finds nothing new."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), new_path(spark, "stream")
    events.write.parquet(f"{folder}/in")
    for _ in range(2):
        stream = attempts.follow(spark, f"{folder}/in", "event_id long, user_id long, event_type string", "parquet")
        attempts.append_log(_log(stream), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return attempts.counters(spark.read.parquet(f"{folder}/log"), "model_alias")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest note per user, folded from several batches."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), new_path(spark, "stream")
    events.repartition(3).write.parquet(f"{folder}/in")
    stream = attempts.follow(spark, f"{folder}/in", "event_id long, user_id long, event_type string", "parquet", files_per_trigger=1)
    attempts.keep_latest(stream, f"{folder}/table", f"{folder}/checkpoint", "user_id", "event_id").awaitTermination()
    return attempts.latest(spark, f"{folder}/table", "user_id", "event_id")


SUMMARY_SQL = """
SELECT event_type AS model_alias, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'error') AS errors,
  count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s <> 'skipped') AS attempts
FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'error' ELSE 'skipped' END AS s FROM events) GROUP BY event_type"""


@query(SUMMARY_SQL)
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that stops after half of its attempts and goes on from its checkpoint."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "event_type"), new_path(spark, "stream")
    for half in (0, 1):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).write.mode("append").parquet(f"{folder}/in")
        stream = attempts.follow(spark, f"{folder}/in", "event_id long, event_type string", "parquet")
        status = F.element_at(F.array(*map(F.lit, ("accepted", "rejected", "error", "skipped"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
        attempts.summarise(stream.select(F.col("event_type").alias("model_alias"), status.alias("status")), f"{folder}/out", f"{folder}/checkpoint", "model_alias").awaitTermination()
    return attempts.summary(spark, f"{folder}/out")
