"""Queries that retrieve: lexical, dense, diverse, card-aware."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import index, retrieval, scoring
from granary.operators.word_index import WordIndex
from granary.plans.base import cards, label_of, label_sql, query, table, words_sql
from granary.sources.paths import new_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = f"""
dt AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
tf AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dt) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(1e-9, avgdl)))) AS bm25
  FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN size GROUP BY query_id, doc_id)"""

TFIDF_SQL = r"""
tg AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM documents),
qg AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM benchmark),
g AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tg),
gq AS (SELECT query_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM qg),
gtf AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL),
gidf AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM gtf GROUP BY gram),
gw AS (SELECT doc_id, gram, tf * idf AS w FROM gtf JOIN gidf USING (gram)),
gn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM gw GROUP BY doc_id),
gqw AS (SELECT query_id, gram, count(*) * any_value(idf) AS qw FROM gq JOIN gidf USING (gram) GROUP BY ALL),
gqn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM gqw GROUP BY query_id),
ti AS (SELECT query_id, doc_id, sum(w * qw) / (any_value(norm) * any_value(qnorm)) AS tfidf
  FROM gw JOIN gqw USING (gram) JOIN gn USING (doc_id) JOIN gqn USING (query_id) GROUP BY query_id, doc_id)"""

BASIC_SQL = f"""{BM25_SQL}, {TFIDF_SQL},
span AS (SELECT query_id, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN least(min(bm25), 0) ELSE min(bm25) END AS low, max(bm25) AS high FROM bm GROUP BY query_id),
bs AS (SELECT coalesce(ti.query_id, b.query_id) AS query_id, coalesce(ti.doc_id, b.doc_id) AS doc_id, coalesce(tfidf, 0) AS tfidf, coalesce(b.bm25, 0) AS bm25, 0.5 * coalesce(tfidf, 0) + 0.5 * coalesce(b.bm25, 0) AS score
  FROM ti FULL JOIN (SELECT query_id, doc_id, CASE WHEN high > low THEN (bm25 - low) / (high - low) ELSE 0 END AS bm25 FROM bm JOIN span USING (query_id)) b ON ti.query_id = b.query_id AND ti.doc_id = b.doc_id)"""


ALL_SQL = """
every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce({score}, 0) AS {score} FROM benchmark b CROSS JOIN documents d LEFT JOIN {source} s ON s.query_id = b.item_id AND s.doc_id = d.doc_id)"""


def _top(source: str, score: str, k: int) -> str:
    return f"SELECT query_id, doc_id, rank, round({score}, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


@query(f"WITH {BM25_SQL} {_top('bm', 'bm25', 5)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.ranked(scoring.bm25_best(_docs(spark, sf_dir), _queries(spark, sf_dir), 5), 5)
    return best.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


INDEX_SQL = BM25_SQL.replace("FROM documents", "FROM kept")
KEPT_SQL = "kept AS (SELECT CASE WHEN doc_id % 7 = 3 THEN 'again ' || text ELSE text END AS text, doc_id FROM documents WHERE doc_id % 5 <> 1)"


def _followed(spark: SparkSession, sf_dir: str) -> WordIndex:
    """An index that was built, got more documents, new versions and losses, each batch sent twice, and was compacted in between."""
    docs, found = _docs(spark, sf_dir), WordIndex(spark, new_path(spark, "word-index"))
    part = F.pmod("doc_id", F.lit(2)) == 0
    versions = docs.filter(F.pmod("doc_id", F.lit(7)) == 3).withColumn("text", F.concat(F.lit("again "), "text"))
    steps = [("first", docs.filter(part), None), ("more", docs.filter(~part), None), ("versions", versions, None), ("losses", None, docs.filter(F.pmod("doc_id", F.lit(5)) == 1))]
    for name, new, gone in steps:
        if found.apply(name, new, gone) == found.apply(name, new, gone):
            raise ValueError(f"batch {name} counted twice")
        if name == "more":
            found.compact("compacted")
    return found


@query(f"WITH {KEPT_SQL}, {INDEX_SQL} {_top('bm', 'bm25', 5)}")
def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a stored index that followed its library."""
    best = retrieval.ranked(_followed(spark, sf_dir).best(_queries(spark, sf_dir), 5), 5)
    return best.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(f"WITH {KEPT_SQL}, {INDEX_SQL} SELECT any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, (SELECT count(*) FROM df) AS n_words, (SELECT sum(df)::BIGINT FROM df) AS n_postings, (SELECT sum(tf)::BIGINT FROM tf) AS n_tokens FROM size")
def stored_index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and postings of the same index from its sums."""
    found = _followed(spark, sf_dir)
    words = found.read("words").groupBy("word").agg(F.sum("df").alias("df")).filter("df > 0").agg(F.count(F.lit(1)).alias("n_words"), F.sum("df").alias("n_postings"))
    tokens_ = found.read("postings").agg(F.sum(F.col("sign") * F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_tokens"))
    return found.size().select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(words).crossJoin(tokens_)


@query(f"WITH {TFIDF_SQL}, {ALL_SQL.format(source='ti', score='tfidf')} {_top('every', 'tfidf', 5)}")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    best = retrieval.ranked(scoring.tfidf_best(docs, queries, 5), 5)
    return best.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


BASIC_TOP_SQL = f"WITH {BASIC_SQL}, {ALL_SQL.format(source='bs', score='score')} {_top('every', 'score', 5)}"


@query(BASIC_TOP_SQL)
def basic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents for every query, those without a common word last."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    best = retrieval.ranked(scoring.basic_best(docs, queries, 5), 5)
    return best.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean vector of its rows."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = each.groupBy("label", "at").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vec"))


def _pool(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return retrieval.dense_topk(vectors, _centroids(spark, sf_dir), n)


DENSE_SQL = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT label, place, round(avg(x), 9) AS x FROM (SELECT label, unnest(range(1, len(v) + 1)) AS place, unnest(v) AS x FROM e) GROUP BY ALL),
q AS (SELECT label AS query_id, list(x ORDER BY place) AS v FROM m GROUP BY label),
un AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e),
uq AS (SELECT query_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM q),
rel AS (SELECT query_id, vec_id AS item_id, list_dot_product(un.v, uq.v) AS relevance, un.v AS v FROM un CROSS JOIN uq),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, item_id) AS candidate_rank FROM rel) WHERE candidate_rank <= 100)"""


@query(f"WITH {DENSE_SQL} SELECT query_id, item_id, candidate_rank, round(relevance, 5) AS relevance FROM pool WHERE candidate_rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, 10).select("query_id", "item_id", "candidate_rank", F.round("relevance", 5).alias("relevance"))


@query(f"""WITH RECURSIVE {DENSE_SQL},
sel AS (
  SELECT query_id, 0 AS step, []::BIGINT[] AS chosen, NULL::BIGINT AS item_id, 0::DOUBLE AS score FROM uq
  UNION ALL
  SELECT s.query_id, s.step + 1, list_append(s.chosen, b.item_id), b.item_id, b.score FROM sel s, LATERAL (
    SELECT p.item_id, round(0.5 * p.relevance - 0.5 * coalesce((SELECT max(list_dot_product(p.v, o.v)) FROM pool o WHERE o.query_id = s.query_id AND list_contains(s.chosen, o.item_id)), 0), 9) AS score
    FROM pool p WHERE p.query_id = s.query_id AND NOT list_contains(s.chosen, p.item_id) ORDER BY score DESC, p.candidate_rank LIMIT 1) b
  WHERE s.step < 10)
SELECT query_id, step::BIGINT AS rank, item_id, round(score, 5) AS mmr_score FROM sel WHERE step > 0""")
def chunk_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieval.check_arguments(10, 100, 0.5)
    picks = retrieval.mmr(_pool(spark, sf_dir, 100), 10, 0.5)
    return picks.select("query_id", "rank", "item_id", F.round("mmr_score", 5).alias("mmr_score"))


JACCARD = "len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE"
SETS_SQL = f"ws AS MATERIALIZED (SELECT doc_id, list_distinct({words_sql('text')}) AS w FROM documents)"


def _mmr_sql(k: int, own: float, source: str = "ti", score: str = "tfidf") -> str:
    """Step by step over all pairs: relevance and the largest cosine to what is chosen."""
    out = [
        "unit AS MATERIALIZED (SELECT doc_id, gram, w / norm AS w FROM gw JOIN gn USING (doc_id))",
        ALL_SQL.format(source=source, score=score),
        f"st1 AS MATERIALIZED (SELECT query_id, doc_id, {score} AS rel, 0::DOUBLE AS near FROM every)",
    ]
    for step in range(1, k + 1):
        out.append(f"pick{step} AS MATERIALIZED (SELECT query_id, doc_id, gain, rel FROM (SELECT *, round({own} * rel - {round(1 - own, 9)} * near, 9) AS gain FROM st{step}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) = 1)")
        if step < k:
            out.append(f"sim{step} AS MATERIALIZED (SELECT p.query_id, b.doc_id, sum(a.w * b.w) AS sim FROM pick{step} p JOIN unit a ON a.doc_id = p.doc_id JOIN unit b ON b.gram = a.gram GROUP BY ALL)")
            out.append(f"st{step + 1} AS MATERIALIZED (SELECT s.query_id, s.doc_id, s.rel, greatest(near, coalesce(sim, 0)) AS near FROM st{step} s JOIN pick{step} p ON p.query_id = s.query_id AND p.doc_id <> s.doc_id LEFT JOIN sim{step} m ON m.query_id = s.query_id AND m.doc_id = s.doc_id)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT query_id, {step}::BIGINT AS rank, doc_id, {'round(gain, 4) AS mmr_score, ' if source == 'ti' else ''}round(rel, 4) AS relevance FROM pick{step}" for step in range(1, k + 1))


MMR_SQL = f"WITH {TFIDF_SQL}, {_mmr_sql(5, 0.7)}"


@query(MMR_SQL)
def card_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diverse cards of the whole library: TF-IDF cosines are both the relevance and the redundancy."""
    queries, library = _queries(spark, sf_dir), index.Tfidf(_docs(spark, sf_dir))
    picks = retrieval.lexical_mmr(None, queries, library, 5, 0.7)
    return picks.select("query_id", "rank", "doc_id", F.round("mmr_score", 4).alias("mmr_score"), F.round("relevance", 4).alias("relevance"))


SEMANTIC_SQL = """
unit_e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS v FROM embeddings),
sem AS (SELECT query_id, doc_id, similarity FROM (
  SELECT b.item_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.v, d.v) AS similarity, row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.vec_id) AS n
  FROM benchmark b JOIN unit_e q ON q.vec_id = b.item_id CROSS JOIN unit_e d JOIN documents k ON k.doc_id = d.vec_id) WHERE n <= 50)"""


@query(f"WITH {TFIDF_SQL}, {SEMANTIC_SQL}, {_mmr_sql(5, 0.7, 'sem', 'similarity')}")
def semantic_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diverse documents by the similarity of embeddings (here: of the vectors of the same ids), redundancy by TF-IDF."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    asked = queries.join(vectors, F.col("query_id") == F.col("item_id")).select("query_id", "vec")
    held = vectors.join(docs.select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    similar = retrieval.dense_topk(held, asked, 50).select("query_id", F.col("item_id").alias("doc_id"), F.col("relevance").alias("similarity"))
    picks = retrieval.retrieve("dense_mmr", docs, queries, 5, 0.7, semantic=similar)
    return picks.select("query_id", "rank", "doc_id", F.round("score", 4).alias("relevance"))


def library_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "validation"
    quality = retrieval.validation_quality(F.col(f"{v}.faithfulness"), F.col(f"{v}.edos_alignment"), F.col(f"{v}.usefulness"))
    return cards(spark, sf_dir).select("doc_id", F.col("source_quote").alias("text"), F.col("source.source_id").alias("source_id"), F.col("primary_label").alias("primary"), F.coalesce("secondary_labels", F.array().cast("array<string>")).alias("secondary"), "keywords", quality.alias("quality"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).withColumn("label", label_of(F.col("query_id")))


CARD_SQL = f"""{BASIC_SQL}, {SETS_SQL},
lib AS (SELECT d.doc_id, d.source AS source_id, {label_sql('d.doc_id')} AS prim, CASE WHEN quality = 1 THEN {label_sql('d.doc_id + 3')} END AS sec, list_distinct({words_sql("' ' || upper(lang) || ' ' || d.source || '   ' || lang")}) AS kw,
  CASE WHEN quality IS NULL THEN 0.35 ELSE (5 * quality + 5 - toxic + 3.5 + quality) / 3.0 / 5 END AS quality FROM documents d LEFT JOIN labels USING (doc_id)),
ask AS (SELECT item_id AS query_id, {label_sql('item_id')} AS label, list_distinct({words_sql('text')}) AS w FROM benchmark),
sc AS (SELECT query_id, doc_id, source_id, prim, 0.3 * coalesce(score, 0) + 0.2 * coalesce(tfidf, 0) + 0.25 * (prim = label)::INT + 0.08 * coalesce((sec = label)::INT, 0) + 0.07 * {JACCARD.format(a='ask.w', b='lib.kw')} + 0.1 * lib.quality AS score
  FROM lib CROSS JOIN ask LEFT JOIN bs USING (query_id, doc_id))"""


def _portfolio_sql(k: int) -> str:
    """Step by step over all pairs: score, a bonus for a new source, a penalty for common words, at most two cards of a source."""
    out = ["st1 AS MATERIALIZED (SELECT query_id, doc_id, source_id, prim, score, 0::DOUBLE AS near, 0 AS used FROM sc)"]
    near = JACCARD.format(a="x.w", b="y.w")
    for step in range(1, k + 1):
        out.append(f"pick{step} AS MATERIALIZED (SELECT * FROM (SELECT *, round(score + CASE WHEN used = 0 THEN 0.08 ELSE 0 END - 0.15 * near, 9) AS gain FROM st{step}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) = 1)")
        if step < k:
            out.append(f"st{step + 1} AS MATERIALIZED (SELECT s.query_id, s.doc_id, s.source_id, s.prim, s.score, greatest(s.near, {near}) AS near, s.used + (s.source_id = p.source_id)::INT AS used FROM st{step} s JOIN pick{step} p ON p.query_id = s.query_id AND p.doc_id <> s.doc_id JOIN ws x ON x.doc_id = s.doc_id JOIN ws y ON y.doc_id = p.doc_id WHERE s.used + (s.source_id = p.source_id)::INT < 2)")
    union = " UNION ALL ".join(f"SELECT query_id, {step} AS step, doc_id, source_id, prim, score, gain FROM pick{step}" for step in range(1, k + 1))
    return ", ".join([*out, f"sel AS ({union})"])


PORTFOLIO_SQL = f"{CARD_SQL}, {_portfolio_sql(5)}"


CARD_TOP_SQL = f"WITH {PORTFOLIO_SQL} SELECT query_id, step::BIGINT AS rank, doc_id, round(score, 4) AS score FROM sel"


@query(f"WITH {PORTFOLIO_SQL} SELECT query_id, step::BIGINT AS rank, doc_id, source_id, round(gain, 4) AS adjusted FROM sel")
def card_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = library_cards(spark, sf_dir)
    picks = retrieval.portfolio(retrieval.card_scores(library, asked(spark, sf_dir)), library)
    return picks.select("query_id", "rank", "doc_id", "source_id", F.round("adjusted", 4).alias("adjusted"))


@query(f"WITH {PORTFOLIO_SQL} SELECT query_id, count(*) AS n_selected, count(DISTINCT source_id) AS n_sources, string_agg(DISTINCT prim, ' | ' ORDER BY prim) AS labels FROM sel GROUP BY query_id")
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = library_cards(spark, sf_dir)
    return retrieval.report(retrieval.portfolio(retrieval.card_scores(library, asked(spark, sf_dir)), library).drop("source_id"), library)



@query(f"WITH {PORTFOLIO_SQL} SELECT count(DISTINCT query_id) AS n_queries, count(*)::BIGINT AS n_selected FROM sel")
def retrieval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries were given how many cards."""
    return retrieval.totals(retrieval_report(spark, sf_dir))
