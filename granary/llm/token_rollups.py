"""Token totals by source, language and tokenizer version, kept up by deltas.

A change is an insert, a delete or a revision of a document's count.  A batch
of changes becomes signed rows (a revision: the old count leaves its key, the
new one enters its own), summed per key before they are written.  A batch is one folder
named by its id; its writer's success mark is the commit.  A batch id
that is committed is skipped, one that broke off is written anew, so a replay
changes nothing.  Totals are sums over committed batches; ``compact`` folds those into a
base that names them, so that a long history stays cheap to read.

Defined cases: null source, language or version are key values; null counts
are 0; repeated changes of one batch count each; an operation of another name (or
null) is an error; keys whose documents and tokens have gone are left out of the
totals; very long texts are counted whole by ``with_counts``; extra columns of
changes are not read, and one named like the count is refused; an empty batch is
committed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import sliced, texts_of

KEYS = ["source", "lang", "tokenizer"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"
DELTA_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes: op, source, lang, tokenizer, n_tokens (new), old_tokens and, if a key changes, old_source, old_lang, old_tokenizer."""
    has = set(changes.columns)
    old_key = [F.coalesce(F.col(f"old_{k}"), F.col(k)).alias(k) if f"old_{k}" in has else F.col(k) for k in KEYS]
    enters = F.struct(*[F.col(k) for k in KEYS], F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("tokens"))
    leaves = F.struct(*old_key, F.lit(-1).cast("long").alias("docs"), (-F.coalesce(F.col("old_tokens"), F.lit(0))).cast("long").alias("tokens"))
    rows = F.when(F.col("op") == INSERT, F.array(enters)).when(F.col("op") == DELETE, F.array(leaves)).when(F.col("op") == REVISE, F.array(leaves, enters))
    unknown = F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(F.col("op"), F.lit("null"))))
    rows = rows.otherwise(unknown.cast("array<struct<source:string,lang:string,tokenizer:string,docs:bigint,tokens:bigint>>"))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


class Rollup:
    """A folder of committed batches on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _exists(self, path: str) -> bool:
        target = self._fs_path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _finished(self, kind: str, mark: str) -> list[str]:
        root = self._fs_path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(n.removeprefix(kind) for n in names if n.startswith(kind) and self._exists(f"{self.path}/{n}/{mark}"))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches in it."""
        bases = self._finished("base=", "batches/_SUCCESS")
        if not bases:
            return None, set()
        path = f"{self.path}/base={bases[-1]}"
        return path, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{path}/batches").collect()}  # one row per batch

    def committed(self) -> list[str]:
        return sorted({*self._finished("batch=", "_SUCCESS"), *self._base()[1]})

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        target = f"{self.path}/batch={batch_id}"
        if self._exists(f"{target}/_SUCCESS") or batch_id in self._base()[1]:
            return False
        delta = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.filter("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(target)
        return True

    def totals(self) -> DataFrame:
        base, inside = self._base()
        paths = [f"{self.path}/batch={b}" for b in self._finished("batch=", "_SUCCESS") if b not in inside]
        paths += [f"{base}/totals"] if base else []
        rows = self.spark.read.schema(DELTA_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA_SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


    def compact(self) -> None:
        """Fold all committed batches into a new base.  The list of its batches is written last and makes it valid; folded batches and older bases go after that."""
        batches, bases = self.committed(), self._finished("base=", "batches/_SUCCESS")
        path = f"{self.path}/base={int(bases[-1]) + 1 if bases else 0:012d}"
        self.totals().write.mode("overwrite").parquet(f"{path}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/batches")
        for old in [*(f"batch={b}" for b in batches), *(f"base={b}" for b in bases)]:
            target = self._fs_path(f"{self.path}/{old}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def with_counts(docs: DataFrame, ranks_path: str, pattern: str, name: str = "n_tokens", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and the byte-level BPE token count of every whole text."""
    from granary.llm.byte_bpe import encode_piece

    rest = [f for f in docs.schema.fields if f.name != text_col]
    if name in [f.name for f in rest]:
        raise ValueError(f"the column {name} is there already")
    rows = docs.select(*[f.name for f in rest], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = [len(encode_piece(t, ranks_path, pattern)) for t in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], name])

    return rows.mapInArrow(count, f"{schema}, `{name}` long")
