"""A table that follows the files of a folder.

A manifest holds path, time and size of every file taken in, and in which version
of the table its rows lie.  ``sync`` compares it with the folder: new files and
those whose time or size differ are read and written as a new version, rows of
files that are gone are no longer read, and all others stay where they are.  The
manifest is written last, so a broken run changes nothing.  A file replaced within
the clock's grain by one of the same size is not noticed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.layout import drop_folder, folders, stored

MANIFEST = "path string, time timestamp, size long, version int"


class FollowedFiles:
    def __init__(self, spark: SparkSession, folder: str, store: str, read: Callable[[list[str]], DataFrame]):
        self.spark, self.folder, self.store, self.read = spark, folder, store.rstrip("/"), read

    def listed(self) -> DataFrame:
        """path, time, size of the files in the folder and below; no file is opened."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder)
        return found.select("path", F.col("modificationTime").alias("time"), F.col("length").alias("size"))

    def version(self) -> int:
        return max((int(name.removeprefix("version=")) for name in folders(self.spark, f"{self.store}/manifest")), default=0)

    def manifest(self) -> DataFrame:
        newest = self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.store}/manifest/version={newest}") if newest else self.spark.createDataFrame([], MANIFEST)

    def sync(self) -> dict[str, int]:
        """Take in what differs; how many files were read, dropped and left as they are."""
        before, now, version = self.manifest(), stored(self.listed(), "listing"), self.version() + 1
        same = stored(now.join(before, ["path", "time", "size"]).select("path", "time", "size", "version"), "listing-same")
        changed = [r["path"] for r in now.join(same, "path", "left_anti").select("path").collect()]  # names that the reader has to be given
        left, dropped = same.count(), before.join(now, "path", "left_anti").count()
        if changed:
            rows = self.read(changed)
            rows.select("*", F.col("_metadata.file_path").alias("_path")).write.mode("overwrite").parquet(f"{self.store}/rows/version={version}")
        if changed or dropped:
            new = now.join(same, "path", "left_anti").withColumn("version", F.lit(version))
            same.unionByName(new.select("path", "time", "size", "version")).write.mode("overwrite").parquet(f"{self.store}/manifest/version={version}")
            used = {r["version"] for r in self.manifest().select("version").distinct().collect()}
            for name in folders(self.spark, f"{self.store}/rows"):  # the version before may still be read
                if int(name.removeprefix("version=")) not in used | {version - 1}:
                    drop_folder(self.spark, f"{self.store}/rows/{name}")
        return {"read": len(changed), "dropped": dropped, "left": left}

    def rows(self) -> DataFrame:
        """The rows of all files of the manifest."""
        held = self.spark.read.option("basePath", f"{self.store}/rows").parquet(f"{self.store}/rows")
        live = self.manifest().select(F.col("path").alias("_live"), F.col("version").alias("_version"))
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two sources write local paths differently
        return held.join(live, (plain("_path") == plain("_live")) & (F.col("version") == F.col("_version")), "left_semi").drop("_path", "version")
