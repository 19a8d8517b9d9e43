"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import safe_column, strip_control
from granary.functions.vectors import wide
from granary.operators.review import arranged, upsert
from granary.sources.paths import OLD


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def card_lines(df: DataFrame, path: str) -> None:
    """Cards as JSON lines under the published names."""
    from granary.sources.readers import PUBLISHED

    jsonl(df.select(*[F.col(c).alias(next((p for p, own in PUBLISHED.items() if own == c), c)) for c in df.columns]), path)


def csv(df: DataFrame, path: str) -> None:
    """A sheet whose texts stand in it as they are: white space around them and NUL stay, empty text is quoted and null is not."""
    rows = df.write.mode("overwrite").option("header", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"')
    rows.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """Replace a small file at once: write beside it, then rename over it."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(content.encode()))
        out.hsync()
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def put_folder(spark: SparkSession, beside: str, path: str) -> None:
    """Put a finished folder in the place of another.  If this stops half-way, the old one is at ``path`` or ``path``.old; nothing is deleted before the new one is in place."""
    sc = spark.sparkContext
    fs_path = sc._jvm.org.apache.hadoop.fs.Path
    target, old = fs_path(path), fs_path(path + OLD)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"cannot set {path} aside")
    if not fs.rename(fs_path(beside), target):
        raise OSError(f"cannot rename {beside} to {path}")
    fs.delete(old, True)


def json_report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report of few rows as one indented JSON list; more than ``most`` rows are refused."""
    import json

    rows = [json.loads(r) for r in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write JSON lines instead")
    put_text(df.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2))


def label_maps(labels: DataFrame, path: str) -> None:
    """label2id and id2label of a taxonomy."""
    import json

    rows = labels.select("label", "label_id").orderBy("label_id").collect()
    put_text(labels.sparkSession, path, json.dumps({"label2id": {r["label"]: r["label_id"] for r in rows}, "id2label": {str(r["label_id"]): r["label"] for r in rows}}, ensure_ascii=False, indent=2))


def annotation_tables(annotations: DataFrame, summary: DataFrame, path: str) -> None:
    """Two tables under one path, control characters dropped; both are replaced at once."""
    beside = path + ".part"
    for name, df in (("annotations", annotations), ("summary", summary)):
        texts = {c: strip_control(c) for c, t in df.dtypes if t == "string"}
        df.withColumns(texts).write.mode("overwrite").parquet(f"{beside}/{name}")
    put_folder(annotations.sparkSession, beside, path)


def upsert_csv(spark: SparkSession, path: str, incoming: DataFrame, preferred: list[str], key: str = "card_id") -> None:
    """Merge rows into a sheet: columns united, latest row of a key, sorted by key; the new sheet replaces the old."""
    from granary.sources.readers import annotations

    current = annotations(spark, path).withColumn("_at", F.lit(0))
    merged = upsert(current, incoming.withColumn("_at", F.lit(1)), key, "_at").drop("_at").na.fill("")
    beside = path + ".part"
    csv(arranged(merged, preferred).orderBy(key), beside)
    put_folder(spark, beside, path)


def embedding_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def wide_probabilities(df: DataFrame, probs: str, labels: list[str] | None, n: int) -> DataFrame:
    """Flat columns prob_0 .. or prob_0_<label>."""
    names = [f"prob_{i}" + (f"_{safe_column(labels[i])}" if labels else "") for i in range(n)]
    return df.select(*[c for c in df.columns if c != probs], *wide(probs, names))
