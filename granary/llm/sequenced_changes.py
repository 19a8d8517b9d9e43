"""Applying numbered changes in order, with a stateful stream started anew per batch.

Every client has a number ``next``; a change is held until its number is next,
and rejected if its number is held already or has gone by.  The state of a
client is one value with at most ``INLINE`` held changes, and a map from number to
change for what it holds beyond.  What waited too long lets a client's number
jump; a client without rows would never be woken, so before each start the clients
that hold expired changes are found, and a clock row goes to those alone.  What is
held follows from what went in and what came out, batch by batch: each store is opened
once a start, for an opened store never gives all its memory back to its executor.
A start commits every store, so a commit writes one file of what changed; and tables
between the starts are dealt to as many tasks as their rows or the cores ask for, not
to one file a shuffle partition, of which every later start would read each.

Nothing but ten numbers (the largest day of each batch) comes to the driver.
Numbers are dense ranks found over ranges of (client, seq), so a hot client lies
in many tasks; of equal numbers in a batch only the first can be applied, so the
later ones are found by an aggregate and never reach the state.  What is left of one client
is applied in order, by one task at a time: that is the operator's meaning.  Its
changes stay in the state store; a task holds at most ``FRESH`` of them, and the
numbers and days of those held when it jumps.

Defined cases: wholly repeated rows count once; a null client is a client of
its own; a null seq stands first in its client; rows with a null change_id or
valid_at take no part (nor do those the caller leaves out); equal change_ids on a
day are ordered by a hash of the row; an operation other than I, U and D (null
too) is applied and changes nothing; balances that are no number or beyond all
limits give null or the nearest long as cents; long texts are carried whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from granary.llm.common import discard, new_path, written
from granary.operators.layout import running

COLUMNS = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
FEED = "client_id long, n long, change_id long, day int, op string, city string, balance double, batch int, later boolean, clock int"
OUTPUT = "change_id long, client_id long, n long, op string, status string, batch int, missed long, city string, balance double"
BATCHES, WAIT, FRESH, INLINE = 10, 8, 20_000, 32
TASK_ROWS = 50_000
Told = Row(*[part.split()[0] for part in OUTPUT.split(", ")])
END_OF_TIME = (1 << 31) - 1
MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
#: Settings of the stream: a state store is closed with its task, for the next start opens it anew, and those of an executor share a bounded memory.
#: A commit writes the changes alone, without a snapshot of the store and without a second file for their checksum, by FileSystem: by FileContext
#: each file of a local folder took some 70 ms more where it was measured.  A manager that the session names for its own store stays.
SETTINGS = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    MANAGER: "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


class Applier(StatefulProcessor):
    """Rows of one client and batch, each number once; a row with ``clock`` tells the largest day of earlier batches."""

    def __init__(self, fresh: int, inline: int):
        self.most_fresh, self.most_kept = fresh, inline

    def init(self, handle: StatefulProcessorHandle) -> None:
        # kept: held changes; spilled: how many more are in the map; earliest: no day of theirs is smaller
        self.client = handle.getValueState("client", "next long, city string, balance double, last long, kept array<struct<n:long,change_id:long,day:int,op:string,city:string,balance:double>>, spilled long, earliest int")
        self.beyond = handle.getMapState("beyond", "n long", "change_id long, day int, op string, city string, balance double, batch int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.client.get()
        self.next, self.city, self.balance, self.last, kept, self.spilled, self.earliest = before or (1, None, None, None, (), 0, END_OF_TIME)
        self.kept = {row[0]: tuple(row[1:]) for row in kept}
        self.changed = before is None
        fresh: dict[int, tuple] = {}
        batch = clock = None
        full = False
        for row in rows:
            batch = row.batch
            if row.clock is not None:
                clock = row.clock
                continue
            change = (row.change_id, row.day, row.op, row.city, row.balance)
            if row.n < self.next or self.holds(row.n):
                yield self.told(key, row.n, change, "rejected", batch)
                continue
            fresh[row.n] = change
            if len(fresh) >= self.most_fresh:
                full = True
                for n, change in fresh.items():
                    self.spill(n, change, batch)
                fresh.clear()
        if clock is not None and (self.kept or self.spilled):
            days = {n: change[1] for n, change in self.kept.items()}
            if self.spilled:
                held = {n: (day, since) for (n,), (_, day, _, _, _, since) in self.beyond.iterator()}
                self.earliest = min(day for day, _ in held.values())
                days |= {n: day for n, (day, since) in held.items() if since < batch}
            upto = max((n for n, day in days.items() if day + WAIT <= clock), default=0)
            for n in sorted(days):
                if n > max(upto, self.next):
                    break
                yield self.apply(key, n, self.take(n), batch)
            if full:
                for n in sorted(n for n in held if n < self.next and n not in days):
                    yield self.told(key, n, self.take(n), "rejected", batch)
        moved = full
        for n in sorted(fresh):
            if n < self.next:
                yield self.told(key, n, fresh[n], "rejected", batch)
                continue
            while moved and self.next < n and self.holds(self.next):
                yield self.apply(key, self.next, self.take(self.next), batch)
            moved = n == self.next
            if moved:
                yield self.apply(key, n, fresh[n], batch)
            elif len(self.kept) < self.most_kept:
                self.kept[n] = fresh[n]
                self.changed = True
            else:
                self.spill(n, fresh[n], batch)
        while moved and self.holds(self.next):
            yield self.apply(key, self.next, self.take(self.next), batch)
        if self.changed:
            self.client.update((self.next, self.city, self.balance, self.last, [(n, *change) for n, change in self.kept.items()], self.spilled, self.earliest))

    def holds(self, n: int) -> bool:
        return n in self.kept or self.spilled > 0 and self.beyond.containsKey((n,))

    def spill(self, n: int, change: tuple, batch: int) -> None:
        self.beyond.updateValue((n,), (*change, batch))
        self.spilled += 1
        self.earliest = min(self.earliest, change[1])
        self.changed = True

    def take(self, n: int) -> tuple:
        self.changed = True
        if n in self.kept:
            return self.kept.pop(n)
        change = self.beyond.getValue((n,))
        self.beyond.removeKey((n,))
        self.spilled -= 1
        if not self.spilled:
            self.earliest = END_OF_TIME
        return change[:5]

    def apply(self, key, n: int, change: tuple, batch: int) -> Row:
        _, _, op, city, balance = change
        missed = n - self.next
        if op == "I":
            self.city, self.balance = city, balance
        elif op == "U":
            self.city = self.city if city is None else city
            self.balance = self.balance if balance is None else balance
        elif op == "D":
            self.city = self.balance = None
        self.next, self.last, self.changed = n + 1, n, True
        return self.told(key, n, change, "applied", batch, missed, self.city, self.balance)

    def told(self, key, n: int, change: tuple, status: str, batch: int, missed: int = 0, city=None, balance=None) -> Row:
        return Told(change[0], key[0], n, change[2], status, batch, missed, city, balance)

    def close(self) -> None:
        pass


def tasks_for(changes: DataFrame) -> int:
    """Tasks that write a table of at most these rows: enough for all cores, and for ``TASK_ROWS`` a task."""
    return max(changes.sparkSession.sparkContext.defaultParallelism, math.ceil(changes.count() / TASK_ROWS))


def numbered(changes: DataFrame, day: Column, batch: Column, tasks: int) -> DataFrame:
    """The distinct changes of a batch with the columns of FEED; ``later``: an earlier change of the batch has its number."""
    rows = changes.select(*COLUMNS).distinct().withColumn("day", day).withColumn("batch", F.when(F.col("change_id").isNotNull(), batch))
    rows = written(rows.withColumn("_tie", F.xxhash64(*COLUMNS)).coalesce(tasks), "changes-rows")
    keys = rows.groupBy("client_id", "seq").agg(F.first(F.lit(1).cast("long")).alias("one"))
    ranks = written(running(keys, ["client_id"], ["seq"], "one").select(F.col("client_id").alias("_client"), F.col("seq").alias("_seq"), (F.col("before") + 1).alias("n")).coalesce(tasks), "changes-ranks")
    rank = F.struct("day", "change_id", "_tie")
    left = rows.filter("batch IS NOT NULL")
    firsts = written(left.groupBy(F.col("client_id").alias("_c"), F.col("seq").alias("_s"), F.col("batch").alias("_b")).agg(F.min(rank).alias("_first")).coalesce(tasks), "changes-firsts")
    with_rank = left.join(ranks, left["client_id"].eqNullSafe(F.col("_client")) & left["seq"].eqNullSafe(F.col("_seq")))
    with_first = with_rank.join(firsts, with_rank["client_id"].eqNullSafe(F.col("_c")) & with_rank["seq"].eqNullSafe(F.col("_s")) & (F.col("batch") == F.col("_b")))
    out = with_first.select("client_id", "n", "change_id", F.col("day").cast("int").alias("day"), "op", "city", F.col("balance").cast("double").alias("balance"), F.col("batch").cast("int").alias("batch"), (rank != F.col("_first")).alias("later"), F.lit(None).cast("int").alias("clock")).coalesce(tasks)
    out._parts = (rows, ranks, firsts)
    return out


def waiting(held: DataFrame | None, fed: DataFrame, out: DataFrame, tasks: int = 1) -> DataFrame:
    """client_id, n, day of the changes that are held after a batch: those held before it and ``fed``, without ``out``.

    Of two changes with one number the one held before stays, and the other came out.
    """
    parts = [fed.select("client_id", "n", F.lit(None).cast("int").alias("old"), F.when(~F.col("later"), F.col("day")).alias("new"), F.lit(1).alias("sign"))]
    if held is not None:
        parts.append(held.select("client_id", "n", F.col("day").alias("old"), F.lit(None).cast("int").alias("new"), F.lit(1).alias("sign")))
    parts.append(out.select("client_id", "n", F.lit(None).cast("int").alias("old"), F.lit(None).cast("int").alias("new"), F.lit(-1).alias("sign")))
    rows = reduce(DataFrame.unionByName, parts).groupBy("client_id", "n")
    left = rows.agg(F.coalesce(F.max("old"), F.max("new")).alias("day"), F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")
    return written(left.coalesce(tasks), "changes-held")


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if there is none."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(path(source)) and fs.rename(path(source), path(target))


def apply_changes(changes: DataFrame, day: Column, batch: Column, batches: int = BATCHES) -> DataFrame:
    """``batch``: from 1 to ``batches``, null for changes that take no part; ``day``: int.

    Returns change_id, client_id, status, batch, missed, city, cents, current
    and n: one row per change that takes part.
    """
    spark = changes.sparkSession
    root = new_path(spark, "sequenced")
    feed, checkpoint, output = f"{root}/feed", f"{root}/checkpoint", f"{root}/output"
    tasks = tasks_for(changes)
    rows = numbered(changes, day, batch, tasks)
    rows.withColumn("part", F.col("batch")).write.partitionBy("part").parquet(f"{root}/staged")
    largest = dict(rows._parts[0].filter("batch IS NOT NULL").groupBy("batch").agg(F.max("day")).collect())  # one row per batch
    for old in rows._parts:
        discard(old)
    spark.createDataFrame([], FEED).write.parquet(f"{feed}/rows-0")
    schema = spark.createDataFrame([], FEED).schema
    held: DataFrame | None = None
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        if not (key == MANAGER and before[key]):
            spark.conf.set(key, value)
    try:
        for number in range(1, batches + 2):
            earlier = [largest[b] for b in largest if b < number]
            if earlier:
                today = END_OF_TIME if number > batches else max(earlier)
                expired = held.filter(F.col("day") <= today - WAIT).select("client_id").distinct().coalesce(tasks)
                ticks = expired.withColumn("clock", F.lit(today)).withColumn("batch", F.lit(number)).withColumn("later", F.lit(False))
                ticks.select(*[(F.col(f.name) if f.name in ticks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{feed}/clock-{number}")
            moved(spark, f"{root}/staged/part={number}", f"{feed}/rows-{number}")
            if earlier or number in largest:
                stream(spark, feed).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").partitionBy("batch").trigger(availableNow=True).start(output).awaitTermination()
                fed = spark.read.schema(FEED).parquet(f"{feed}/rows-{number if number in largest else 0}")
                known, held = held, waiting(held, fed, spark.read.schema(OUTPUT).parquet(output).filter(F.col("batch") == number), tasks)
                if known is not None:
                    discard(known)
        if not largest:
            return told(spark.createDataFrame([], OUTPUT), tasks)
        discard(held)
        return told(spark.read.schema(OUTPUT).parquet(output), tasks)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream(spark: SparkSession, feed: str) -> DataFrame:
    rows = spark.readStream.schema(FEED).parquet(f"{feed}/*")
    ordered = rows.filter("NOT later").groupBy("client_id").transformWithState(Applier(FRESH, INLINE), OUTPUT, "append", "none")
    out = rows.filter("later").select("change_id", "client_id", "n", "op", F.lit("rejected").alias("status"), "batch", F.lit(0).cast("long").alias("missed"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("double").alias("balance"))
    return ordered.unionByName(out)


def told(output: DataFrame, tasks: int) -> DataFrame:
    """The stream's rows, with ``current`` from each client's last number, for numbers are applied in ascending order."""
    cents = F.when(~F.isnan("balance"), F.floor(100 * F.col("balance") + 0.5))
    rows = output.withColumn("cents", cents)
    last = written(output.filter("status = 'applied'").groupBy(F.col("client_id").alias("_client")).agg(F.max("n").alias("_n")).coalesce(tasks), "changes-last")
    same = rows["client_id"].eqNullSafe(F.col("_client")) & (rows["n"] == F.col("_n"))
    rows = rows.join(last, same, "left").withColumn("current", F.col("_n").isNotNull() & (F.col("status") == "applied") & ~F.col("op").eqNullSafe("D"))
    return rows.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current", "n")
