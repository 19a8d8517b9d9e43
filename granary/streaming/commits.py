"""Outputs of one run that become valid together.

A run writes each output to a folder ``run=<id>`` under its root, and at the end a
manifest that names it.  Only runs with a manifest are read; what a run
that broke off has left is dropped when the next one begins.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.operators.layout import drop_folder, folders
from granary.sources import sinks


class Commits:
    def __init__(self, spark: SparkSession, folder: str, *roots: str):
        self.spark, self.folder, self.roots = spark, folder.rstrip("/"), [r.rstrip("/") for r in roots]

    def runs(self) -> list[str]:
        return sorted(name.removesuffix(".json") for name in folders(self.spark, self.folder, done=False) if name.endswith(".json"))

    def begin(self) -> str:
        """The id of a new run; leftovers of broken runs go."""
        whole = {f"run={r}" for r in self.runs()}
        for root in self.roots:
            for name in folders(self.spark, root, done=False):
                if name.startswith("run=") and name not in whole:
                    drop_folder(self.spark, f"{root}/{name}")
        return uuid.uuid4().hex

    def commit(self, run: str) -> None:
        sinks.put_text(self.spark, f"{self.folder}/{run}.json", json.dumps({"run": run, "outputs": [f"{root}/run={run}" for root in self.roots]}))

    def read(self, root: str, schema: str) -> DataFrame:
        """JSON lines of all committed runs."""
        paths = [f"{root.rstrip('/')}/run={r}" for r in self.runs()]
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)
