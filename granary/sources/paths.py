"""Where intermediate tables may lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

OLD = ".old"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary
    folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="granary-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def resolved(path: str, root: str) -> str:
    """A path as it is if it is absolute or has a scheme, else under ``root``."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/granary-{label}-{uuid.uuid4().hex}"
