"""Registration of queries with the SQL that checks them, and views of the test tables as the library's entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The label taxonomy (id, label, parent id, parent).
TAXONOMY = [
    (0, "1.1 threats of harm", 0, "1. threats, plans to harm and incitement"),
    (1, "1.2 incitement and encouragement of harm", 0, "1. threats, plans to harm and incitement"),
    (2, "2.1 descriptive attacks", 1, "2. derogation"),
    (3, "2.2 aggressive and emotive attacks", 1, "2. derogation"),
    (4, "2.3 dehumanising attacks & overt sexual objectification", 1, "2. derogation"),
    (5, "3.1 casual use of gendered slurs, profanities, and insults", 2, "3. animosity"),
    (6, "3.2 immutable gender differences and gender stereotypes", 2, "3. animosity"),
    (7, "3.3 backhanded gendered compliments", 2, "3. animosity"),
    (8, "3.4 condescending explanations or unwelcome advice", 2, "3. animosity"),
    (9, "4.1 supporting mistreatment of individual women", 3, "4. prejudiced discussions"),
    (10, "4.2 supporting systemic discrimination against women as a group", 3, "4. prejudiced discussions"),
]

TERMS = {"de": ["der die und", "nicht mit"], "en": ["the of and", "that with"], "es": ["de la que", "los con"], "fr": ["le les des", "que dans"]}

TAXONOMY_SQL = "taxonomy(label_id, label, parent_id, parent) AS (VALUES " + ", ".join(f"({i}, '{label}', {p}, '{parent}')" for i, label, p, parent in TAXONOMY) + ")"
TERMS_SQL = "term_sets(label, terms) AS (VALUES " + ", ".join(f"('{k}', '{' '.join(v)}')" for k, v in TERMS.items()) + ")"
WORDS = "regexp_extract_all({}, '[A-Za-zÀ-ÿ0-9'']+')"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"list_transform({WORDS.format(x)}, lambda t: lower(t))"


def flat_sql(x: str) -> str:
    return FLAT.format(x)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "label_id int, label string, parent_id int, parent string")


def term_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERMS.items()), "label string, terms array<string>")


def label_of(number: Column) -> Column:
    """A label of the taxonomy by number."""
    return F.element_at(F.array(*[F.lit(t[1]) for t in TAXONOMY]), (F.pmod(number, F.lit(len(TAXONOMY))) + 1).cast("int"))


def label_sql(number: str) -> str:
    return "list_extract([" + ", ".join(f"'{t[1]}'" for t in TAXONOMY) + f"], (({number}) % {len(TAXONOMY)} + 1)::INT)"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence cards; expert scores come from the labels."""
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(marks, "doc_id", "left")
    null = F.lit(None)
    return rows.select(
        F.concat(F.lit("card_"), F.col("doc_id")).alias("card_id"),
        F.col("doc_id").alias("ord"),
        "doc_id",
        F.when(F.col("quality") == 1, "").otherwise("candidate").alias("status"),
        F.struct(F.col("source").alias("source_id"), F.concat(F.lit("Report "), "source").alias("title"), F.lit("").alias("publisher"), (F.lit(1990) + F.pmod("doc_id", F.lit(35))).cast("int").alias("year"), null.cast("int").alias("page"), null.cast("string").alias("section"), F.concat(F.lit("https://example.org/"), "source").alias("url"), F.lit("").alias("file_name")).alias("source"),
        F.col("text").alias("source_quote"),
        F.concat(F.lit("  A claim\n in "), "lang").alias("claim"),
        label_of(F.col("doc_id")).alias("primary_label"),
        F.when(F.col("quality") == 1, F.array(label_of(F.col("doc_id") + 3))).alias("secondary_labels"),
        F.concat(F.lit("EDOS definition: the "), "lang", F.lit(" one ")).alias("edos_alignment"),
        F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("source"), F.lit(" "), F.col("lang")).alias("keywords"),
        F.struct(F.lit("").alias("status"), (5 * F.col("quality")).cast("double").alias("faithfulness"), (5 - F.col("toxic")).cast("double").alias("edos_alignment"), (3.5 + F.col("quality")).cast("double").alias("usefulness"), null.cast("string").alias("notes")).alias("validation"),
        "lang",
    )


CARDS_SQL = f"""cards AS (
  SELECT 'card_' || d.doc_id AS card_id, d.doc_id AS ord, d.doc_id, CASE WHEN quality = 1 THEN '' ELSE 'candidate' END AS status,
    d.source AS source_id, 'Report ' || d.source AS title, 1990 + d.doc_id % 35 AS year, 'https://example.org/' || d.source AS url,
    d.text AS source_quote, '  A claim' || chr(10) || ' in ' || lang AS claim, {label_sql("d.doc_id")} AS primary_label,
    CASE WHEN quality = 1 THEN {label_sql("d.doc_id + 3")} END AS secondary_label,
    'EDOS definition: the ' || lang || ' one ' AS edos_alignment, lang, quality, toxic
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Made-up classifier output of whole numbers: a vote and eleven probabilities per document."""
    docs = table(spark, sf_dir, "documents")
    n = len(TAXONOMY)
    vote = F.pmod(F.floor(F.col("doc_id") / shift), F.lit(4)).cast("int")
    probs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == vote, F.lit(0.5)).otherwise((F.pmod(F.col("doc_id") * shift + i, F.lit(7)) + 1) / 100.0))
    return docs.select("doc_id", vote.alias("pred_id"), probs.alias("probs"))


def prob_sql(shift: int, index: str) -> str:
    return f"CASE WHEN {index} = (doc_id // {shift}) % 4 THEN 0.5 ELSE ((doc_id * {shift} + {index}) % 7 + 1) / 100.0 END"


VOTERS = {"m1": 1, "m2": 2, "m3": 3, "m4": 5}
FALLBACK = ("m5", 7)
