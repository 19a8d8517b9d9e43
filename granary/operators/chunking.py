"""Overlapping word chunks with identifiers that count through a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import chunk_id, split_words
from granary.operators.layout import dealt, running


def chunk_words(docs: DataFrame, text: str = "text", size: int = 350, overlap: int = 80, least: int = 40) -> DataFrame:
    """A row per chunk: the input columns but the text, start (words before it), chunk (text), n_words.

    Chunks start at every step of size - overlap words; those of fewer than
    ``least`` words are dropped, a tail inside the chunk before it is not.
    """
    step = max(1, size - overlap)
    rest = [c for c in docs.columns if c != text]
    words = dealt(docs.select(*rest, text)).select(*rest, split_words(text).alias("_words")).filter(F.size("_words") >= least)
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step))))
    parts = starts.withColumn("_part", F.slice("_words", F.col("start") + 1, F.lit(size))).filter(F.size("_part") >= least)
    return parts.select(*rest, F.col("start").cast("long").alias("start"), F.array_join("_part", " ").alias("chunk"), F.size("_part").cast("long").alias("n_words"))


def number_chunks(chunks: DataFrame, source: str, order: str, start: str = "start") -> DataFrame:
    """``chunks`` with chunk_number (from 1 through each source) and chunk_id.

    Only one count per document is ordered within a source, by ranges (a source
    may hold most of the corpus); the chunks of a document are then numbered by
    themselves.
    """
    within = Window.partitionBy(source, order).orderBy(start)
    own = chunks.withColumn("_n", F.row_number().over(within))
    sizes = chunks.groupBy(source, order).agg(F.count(F.lit(1)).alias("_all"))
    offsets = running(sizes, [source], [order], "_all").select(F.col(source).alias("_source"), F.col(order).alias("_order"), "before")
    same = F.col(source).eqNullSafe(F.col("_source")) & F.col(order).eqNullSafe(F.col("_order"))
    out = own.join(offsets, same).withColumn("chunk_number", F.col("before") + F.col("_n")).drop("_n", "before", "_source", "_order")
    return out.withColumn("chunk_id", chunk_id(source, "chunk_number"))
