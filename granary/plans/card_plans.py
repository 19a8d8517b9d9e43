"""Queries over cards, sheets and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import keyword_set, label_text, strip_control
from granary.operators import cards as card_ops
from granary.operators import ensemble, review, splits
from granary.plans.base import CARDS_SQL, TAXONOMY_SQL, cards, flat_sql, label_of, label_sql, query, table, taxonomy


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.normalize_cards(cards(spark, sf_dir))


NORMAL_SQL = f"""{CARDS_SQL}, normal AS (SELECT *, {flat_sql('claim')} AS claim_n, {flat_sql('source_quote')} AS quote_n, {flat_sql('edos_alignment')} AS alignment_n FROM cards)"""


@query(f"WITH {NORMAL_SQL} SELECT card_id, 'candidate' AS status, claim_n AS claim, md5(quote_n) AS quote_md5, lower(lang) || '|' || source_id AS keywords, coalesce(secondary_label, '') AS secondary, 'not_validated' AS validation_status, source_id FROM normal")
def normalize_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("card_id", "status", "claim", F.md5("source_quote").alias("quote_md5"), F.array_join("keywords", "|").alias("keywords"), F.array_join("secondary_labels", "|").alias("secondary"), F.col("validation.status").alias("validation_status"), F.col("source.source_id").alias("source_id"))


KEPT_SQL = f"""WITH {NORMAL_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY lang, source_id, lower(quote_n) ORDER BY ord) AS n FROM normal),
kept AS (SELECT * FROM firsts WHERE n = 1 AND length(quote_n) >= 10)"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normal(spark, sf_dir).withColumn("source_id", F.col("source.source_id"))
    keys = [F.col("lang"), F.col("source_id"), F.lower("source_quote")]
    return card_ops.dedupe_cards(rows, keys, "ord", F.char_length("source_quote") >= 10)


@query(KEPT_SQL + " SELECT card_id, lang, source_id FROM kept")
def dedupe_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("card_id", "lang", "source_id")


@query(KEPT_SQL + " SELECT primary_label, count(*) AS num_cards, count(DISTINCT source_id) AS num_sources, string_agg(card_id, ' | ' ORDER BY ord) AS card_ids FROM kept GROUP BY primary_label")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.coverage(_kept(spark, sf_dir))


@query(KEPT_SQL + """ SELECT primary_label, count(*) AS num_candidate_cards, count(DISTINCT source_id) AS num_sources, string_agg(DISTINCT source_id, '; ' ORDER BY source_id) AS source_ids,
  count(secondary_label)::BIGINT AS num_secondary_links, array_to_string(list(card_id ORDER BY ord)[1:3], '; ') AS example_card_ids FROM kept GROUP BY primary_label""")
def pack_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.pack_coverage(_kept(spark, sf_dir))


@query(f"""WITH {NORMAL_SQL} SELECT card_id, primary_label AS primary_edos_label, coalesce(secondary_label, '') AS secondary_edos_labels, source_id, title AS source_title, '' AS source_publisher, year::VARCHAR AS source_year, '' AS source_page, url AS source_url,
  md5(quote_n) AS source_quote, claim_n AS claim, alignment_n AS edos_alignment_text, lower(lang) || ' | ' || source_id AS retrieval_keywords, '' AS faithfulness_1_5, '' AS edos_alignment_1_5, '' AS usefulness_1_5, '' AS decision_accept_reject_revision, '' AS expert_notes FROM normal""")
def expert_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.expert_sheet(_normal(spark, sf_dir)).withColumn("source_quote", F.md5("source_quote"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the labelled documents; every ninth carries a decision in words."""
    said = F.when(F.pmod("doc_id", F.lit(9)) == 0, " Accepted with thanks").when(F.pmod("doc_id", F.lit(9)) == 1, "reject").otherwise("")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("card_"), "doc_id").alias("card_id"), said.alias("decision"), (3 + F.col("quality")).cast("string").alias("faithfulness"), F.when(F.col("toxic") == 1, "").otherwise("4.5").alias("alignment"), (3 + F.col("quality")).cast("string").alias("usefulness"))


@query(f"""WITH {CARDS_SQL}, sheet AS (SELECT 'card_' || doc_id AS card_id, doc_id, quality, toxic FROM labels)
SELECT card_id, primary_label, CASE WHEN s.doc_id % 9 = 0 THEN true WHEN s.doc_id % 9 = 1 THEN false ELSE 3 + s.quality >= 4 AND s.toxic = 0 AND 3 + s.quality >= 3.5 END AS accepted FROM sheet s JOIN cards USING (card_id)""")
def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.adjudicate(_sheet(spark, sf_dir), cards(spark, sf_dir)).select("card_id", "primary_label", "accepted")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes per user; those of one type come later as a second frame with a column of its own."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    early, late = events.filter("event_type <> 'purchase'"), events.filter("event_type = 'purchase'").withColumn("extra", F.lit("x"))
    return review.upsert(early, late, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {CARDS_SQL} SELECT card_id, CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'revised_candidate' ELSE 'validated' END AS status,
  CASE WHEN toxic = 1 THEN 'new claim' ELSE claim END AS claim, CASE WHEN toxic = 1 THEN 'a;b' ELSE ' ' || upper(lang) || ';' || source_id || '; ;' || lang END AS keywords, NULL::VARCHAR AS source_revised FROM cards WHERE quality IS NOT NULL""")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    bad = F.col("toxic") == 1
    notes = marks.select(F.concat(F.lit("card_"), "doc_id").alias("card_id"), F.when(F.col("quality") == 0, "Reject").when(bad, "Revise").otherwise("Accept").alias("decision"), F.lit("r1").alias("reviewer"), F.lit("").alias("notes"), F.when(bad, "new claim").otherwise("").alias("field_claim_revised"), F.when(bad, "a | b|").alias("field_keywords_revised"), F.lit(" ").alias("field_source_revised"))
    return review.export_reviews(cards(spark, sf_dir), notes).select("card_id", "status", "claim", F.array_join("keywords", ";").alias("keywords"), "source_revised")


@query("SELECT (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS reviewed, (SELECT count(*) FROM documents) AS total, round((SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS ratio")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").withColumn("ratio", F.round("ratio", 6))


@query("SELECT lang, count(*) AS n_open FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def open_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = review.annotated_state(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "open", "doc_id")
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n_open"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN (doc_id % 5)::VARCHAR END AS score, doc_id % 5 IN (1, 2, 3) AS complete FROM documents")
def scores_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(5)).cast("string").alias("s"))
    return rows.select("doc_id", review.score_1_3("s").cast("string").alias("score"), review.complete("s").alias("complete"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'Accept' ELSE lang END AS decision, '3' AS faithfulness_score, CASE WHEN source = 'src1' THEN 'OK' ELSE source END AS field_claim_status FROM documents")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("decision"), F.when(F.col("source") != "src1", F.col("source")).alias("field_claim_status"))
    return review.review_rows(rows).select("doc_id", "decision", "faithfulness_score", "field_claim_status")


@query(f"WITH {NORMAL_SQL} SELECT card_id, source_id AS source_source_id, md5(source_quote) AS chunk_md5, lower(lang) || '; ' || source_id AS keywords FROM normal")
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards(spark, sf_dir).withColumn("keywords", keyword_set("keywords"))
    return review.annotation_rows(rows).select("card_id", "source_source_id", F.md5("chunk").alias("chunk_md5"), "keywords")


@query("SELECT doc_id, lang || 'ab' AS clean, lang || ' x' AS label FROM documents")
def cleaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", strip_control(F.concat("lang", F.lit("a\x07\x1fb"))).alias("clean"), label_text(F.concat(F.lit(" "), "lang", F.lit("\nx "))).alias("label"))


SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"


@query(f"""WITH rows AS (SELECT doc_id AS ord, md5(text) AS text_md5, {label_sql('doc_id')} AS label, {SPLIT} AS split FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND length(trim(text)) > 0)
SELECT 'train' AS part, 0 AS piece, ord, text_md5, label FROM rows WHERE split = 'train'
UNION ALL SELECT 'train', 1, item_id, md5(text), {label_sql('item_id')} FROM benchmark
UNION ALL SELECT 'train', 2, ord, text_md5, label FROM rows WHERE split = 'dev'
UNION ALL SELECT split, 0, ord, text_md5, label FROM rows WHERE split IN ('dev', 'test')""")
def build_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    part = F.pmod("doc_id", F.lit(10))
    corpus = docs.select("text", F.when(F.col("quality") == 1, "sexist").otherwise("not").alias("label_sexist"), label_of(F.col("doc_id")).alias("label"), F.when(part == 0, "test").when(part == 1, "dev").otherwise("train").alias("split"), F.col("doc_id").alias("ord"))
    more = table(spark, sf_dir, "benchmark").select("text", label_of(F.col("item_id")).alias("label"), F.col("item_id").alias("ord"))
    return splits.build_splits(corpus, more).select("part", "piece", "ord", F.md5("text").alias("text_md5"), "label")


@query(f"WITH {TAXONOMY_SQL} SELECT doc_id, label_id, parent_id, parent FROM documents JOIN taxonomy ON label_id = doc_id % 11")
def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", label_of(F.col("doc_id")).alias("label"))
    return splits.with_label_ids(rows, taxonomy(spark), check=False).select("doc_id", "label_id", "parent_id", "parent")


@query("SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the taxonomy."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("label")).filter("label IS NOT NULL").unionByName(taxonomy(spark).select("label"))
    return splits.unknown_labels(rows, taxonomy(spark))


@query("SELECT 0 AS piece, doc_id AS id, md5(text) AS text_md5 FROM documents UNION ALL SELECT 1, item_id, md5(text) FROM benchmark")
def union_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("piece"), F.col("doc_id").alias("id"), F.md5("text").alias("text_md5"))
    return docs.unionByName(table(spark, sf_dir, "benchmark").select(F.lit(1).alias("piece"), F.col("item_id").alias("id"), F.md5("text").alias("text_md5")))


@query("SELECT count(*) AS n, count(*) FILTER (text IS NULL OR length(trim(text)) = 0) AS blank_texts, (count(*) - count(DISTINCT doc_id)) AS repeated_ids, count(*) FILTER (doc_id IS NULL) AS missing_ids FROM documents")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank_texts"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated_ids"), F.count_if(F.col("doc_id").isNull()).alias("missing_ids"))


@query("SELECT doc_id AS id, 'documents' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without counterpart: an exact cover has none."""
    docs, marks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return ensemble.cover_gaps(docs, marks, "id").select("id", F.when(F.col("side") == "corpus", "documents").otherwise("labels").alias("side"))
