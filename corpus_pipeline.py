"""From raw documents to token ids: five stages, each one operator of ``granary.llm``.

Every stage but the last takes and returns the columns of ``documents``:

1. quality: documents over the perplexity threshold of their language go;
2. near duplicates: SimHash components (and MinHash bands, for what two bits miss) propose;
   texts whose sets of five-word shingles have a Jaccard similarity
   of 0.8 or more are linked; of each component the document of the smallest id stays;
3. repeated passages: of every passage of over 50 words that repeats the first copy
   stays (white space between words does not count); documents with nothing left
   go, ``n_chars`` is counted anew;
4. decontamination: documents that hold a benchmark item go;
5. byte-level BPE: ids of the remaining texts, and a digest of what they decode to.

Rows without id stay in stages 1 and 4 like any others, in stage 2 as distinct
rows, and in stage 3 as copies of the first row with their text.  Null text is
empty; very long texts are taken whole; columns beyond those of documents are
dropped first, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_bpe, decontaminate, kneser_ney, near_copies, simhash, suffix_dedup
from granary.llm.common import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    trusted = read_table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    judged = kneser_ney.classify(docs, trusted)
    gone = judged.filter(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text").dropDuplicates(["digest"])
    groups = simhash.near_duplicates(texts, id_col="digest")
    found = near_copies.near_copies(docs, words=5, similarity=0.8, proposed=groups)
    # ids may repeat with other texts: of each component one text stays, whatever its id has elsewhere
    stay = found.filter("doc_id = component AND digest = first_digest").select("doc_id", "digest").distinct()
    rows = docs.withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = rows.join(stay, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS).distinct())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = suffix_dedup.Repeats(docs, WORDS, keep_first=True, unit="word")
    kept = found.texts.join(found.firsts(), "text_key").select("text_key", "n_symbols", "first", F.size("spans").alias("n_spans"), F.col("kept").cast("string").alias("kept"))
    rows = docs.withColumn("text_key", suffix_dedup.text_key(F.col("text"))).drop("text", "n_chars").join(kept, "text_key")
    copy = (F.coalesce("n_symbols", F.lit(0)) >= WORDS) & (F.coalesce("doc_id", F.lit(suffix_dedup.NULL_FIRST)) != F.col("first"))
    rows = rows.filter(~copy & ((F.col("n_spans") == 0) | F.col("kept").rlike("[^ \\t-\\r]")))
    return rows.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded.withColumn("packed", F.col("ids")), path, keep=("n_tokens", "packed"))
    return decoded.select("doc_id", "n_tokens", F.col("packed").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", benchmark_free),
    ("byte_bpe", token_ids),
]

#: Perplexities, shingles and merges are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
