"""A table of the latest row per key that is fed by small batches.

Each batch is written as one run of its own rows, in buckets of the key.  When
``fanout`` runs of a level stand side by side they become one run of the
next level, so a row is written once per level and not once per batch.  A run is
named by its level and the batches it covers, and counts once its success mark is
there; what a later run covers is no longer read, and goes with the next batch, so
readers of the state before are not cut off.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.layout import drop_folder, folders
from granary.operators.review import last_wins

RUN = re.compile(r"level(\d+)-(\d+)-(\d+)$")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 16, fanout: int = 4):
        self.spark, self.path, self.key, self.order, self.buckets, self.fanout = spark, path.rstrip("/"), key, order, buckets, fanout

    def found(self, done: bool = True) -> list[tuple[int, int, int]]:
        return sorted(tuple(map(int, m.groups())) for name in folders(self.spark, self.path, done) if (m := RUN.match(name)))

    def runs(self) -> list[tuple[int, int, int]]:
        """level, first and last batch of the runs that make up the table, oldest first."""
        all_ = self.found()
        covered = lambda r: any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in all_)
        return sorted((r for r in all_ if not covered(r)), key=lambda r: r[1])

    def folder(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/level{run[0]}-{run[1]}-{run[2]}"

    def rows(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        """Columns united; of equal keys the latest row."""
        out = None
        for run in runs:
            part = self.spark.read.parquet(self.folder(run)).drop("bucket")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return last_wins(out, self.key, self.order)

    def write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(self.folder(run))

    def fold(self, batch: DataFrame, number: int) -> None:
        """Take in batch ``number``; a batch that was taken in before changes nothing."""
        live = self.runs()
        for run in self.found(done=False):
            if run not in live:
                drop_folder(self.spark, self.folder(run))
        if any(first <= number <= last for _, first, last in live):
            return
        self.write(last_wins(batch, self.key, self.order), (0, number, number))
        while True:
            live = self.runs()
            level = next((x for x in sorted({r[0] for r in live}) if sum(r[0] == x for r in live) >= self.fanout), None)
            if level is None:
                return
            some = [r for r in live if r[0] == level]
            self.write(self.rows(some), (level + 1, some[0][1], some[-1][2]))

    def latest(self) -> DataFrame:
        return self.rows(self.runs())
