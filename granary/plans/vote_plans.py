"""Queries over votes, metrics and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.vectors import argmax, softmax
from granary.operators import ensemble, metrics
from granary.plans.base import FALLBACK, TAXONOMY_SQL, VOTERS, predictions, prob_sql, query, table, taxonomy
from granary.sources.sinks import wide_probabilities


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {name: predictions(spark, sf_dir, shift) for name, shift in {**VOTERS, FALLBACK[0]: FALLBACK[1]}.items()}
    return ensemble.vote(ensemble.aligned(frames, "doc_id", check=False), list(VOTERS), FALLBACK[0])


VOTES_SQL = f"""
v AS (SELECT doc_id, unnest([{', '.join(f'(doc_id // {s}) % 4' for s in VOTERS.values())}]) AS label FROM documents),
c AS (SELECT doc_id, label, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT doc_id, max(n) AS top, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS vote_counts FROM c GROUP BY doc_id),
l AS (SELECT doc_id, any_value(top) AS top, any_value(vote_counts) AS vote_counts, count(*) > 1 AS used_fallback, min(label) AS leader FROM c JOIN t USING (doc_id) WHERE n = top GROUP BY doc_id),
voted AS (SELECT doc_id, CASE WHEN used_fallback THEN (doc_id // {FALLBACK[1]}) % 4 ELSE leader END AS pred_id, used_fallback, top AS top_vote_count, vote_counts FROM l)"""
MEAN_SQL = "(" + " + ".join(prob_sql(s, "pred_id") for s in VOTERS.values()) + f") / {len(VOTERS)}.0"


@query(f"WITH {VOTES_SQL} SELECT doc_id, pred_id::INT AS pred_id, used_fallback, top_vote_count, vote_counts, round(CASE WHEN used_fallback THEN {prob_sql(FALLBACK[1], 'pred_id')} ELSE {MEAN_SQL} END, 6) AS confidence FROM voted")
def vote_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).select("doc_id", "pred_id", "used_fallback", "top_vote_count", "vote_counts", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {VOTES_SQL} SELECT count(*) FILTER (used_fallback) AS fallback_used_count, round(avg(used_fallback::INT), 6) AS fallback_used_rate FROM voted")
def fallback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.fallback_rate(_voted(spark, sf_dir)).withColumn("fallback_used_rate", F.round("fallback_used_rate", 6))


@query("""
WITH p AS (SELECT doc_id, 'L' || doc_id // 2 % 3 AS a, 'L' || doc_id // 3 % 3 AS b, 'L' || doc_id % 3 AS f, (doc_id % 10) / 10.0 AS ca, (doc_id % 7) / 10.0 AS cb, 0.25 AS cf FROM documents)
SELECT doc_id, a <> b AS used_fallback, CASE WHEN a <> b THEN f ELSE a END AS label_pred, round(CASE WHEN a <> b THEN cf ELSE greatest(ca, cb) END, 6)::DOUBLE AS confidence, f AS fallback_pred, '["' || a || '","' || b || '"]' AS base_votes FROM p""")
def vote_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def frame(step: int, confidence) -> DataFrame:
        return docs.select("doc_id", F.concat(F.lit("L"), F.pmod(F.floor(F.col("doc_id") / step), F.lit(3))).alias("label"), confidence.alias("confidence"))

    tenth = lambda m: F.pmod("doc_id", F.lit(m)) / 10.0
    rows = ensemble.aligned({"a": frame(2, tenth(10)), "b": frame(3, tenth(7)), "f": frame(1, F.lit(0.25))}, "doc_id", check=False)
    return ensemble.vote_generic(rows, ["a", "b"], "f").select("doc_id", "used_fallback", "label_pred", F.round("confidence", 6).alias("confidence"), "fallback_pred", "base_votes")


GOLD_SQL = f"{VOTES_SQL}, {TAXONOMY_SQL}, r AS (SELECT doc_id, doc_id % 4 AS gold, pred_id AS pred FROM voted)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).select(F.pmod("doc_id", F.lit(4)).cast("int").alias("gold"), F.col("pred_id").alias("pred"))


@query(f"WITH {GOLD_SQL} SELECT a.label_id AS gold, b.label_id AS pred, count(doc_id) AS n FROM taxonomy a CROSS JOIN taxonomy b LEFT JOIN r ON r.gold = a.label_id AND r.pred = b.label_id GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_judged(spark, sf_dir), taxonomy(spark).select(F.col("label_id").alias("label")))


REPORT_SQL = f"""{GOLD_SQL}, k AS (SELECT gold AS label FROM r UNION SELECT pred FROM r),
cr AS (SELECT label::INT AS label, (SELECT count(*) FROM r WHERE gold = label) AS support, (SELECT count(*) FROM r WHERE pred = label) AS predicted, (SELECT count(*) FROM r WHERE gold = label AND pred = label) AS hits FROM k),
rep AS (SELECT label, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1, support, hits FROM cr)"""


@query(f"WITH {REPORT_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(_judged(spark, sf_dir)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {REPORT_SQL} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS n FROM rep")
def f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.f1_summary(_judged(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "n")


@query("SELECT lang AS label, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*))::DOUBLE, 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 'q' || quality END AS label_pred, CASE WHEN quality IS NOT NULL THEN 0.5 + toxic / 4.0 END::DOUBLE AS confidence FROM documents d LEFT JOIN labels USING (doc_id)")
def annotate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction comes twice; the later one counts."""
    marks = table(spark, sf_dir, "labels")
    later = marks.select("doc_id", F.lit(1).alias("ord"), F.concat(F.lit("q"), "quality").alias("label_pred"), (0.5 + F.col("toxic") / 4.0).alias("confidence"), F.lit(False).alias("used_fallback"))
    early = later.withColumn("ord", F.lit(0)).withColumn("label_pred", F.lit("old"))
    noted = ensemble.annotate(table(spark, sf_dir, "documents").select("doc_id"), early.unionByName(later), "task_c", "doc_id")
    return noted.select("doc_id", F.col("task_c.label_pred").alias("label_pred"), F.col("task_c.confidence").alias("confidence"))


@query("SELECT conv_id, role, text_md5 FROM (SELECT conv_id, role, md5(text) AS text_md5, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def last_wins_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.operators.review import last_wins

    return last_wins(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "role", F.md5("text").alias("text_md5"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS w FROM e)
SELECT vec_id, (list_position(v, list_max(v)) - 1)::INT AS pred_id, round(list_max(w) / list_sum(w), 6) AS confidence FROM p""")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", argmax("v").alias("pred_id"), F.round(F.array_max(softmax("v")), 6).alias("confidence"))


@query(f"SELECT doc_id, {prob_sql(3, '0')}::DOUBLE AS prob_0, {prob_sql(3, '10')}::DOUBLE AS prob_10 FROM documents")
def wide_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_probabilities(predictions(spark, sf_dir, 3), "probs", None, 11).select("doc_id", "prob_0", "prob_10")


@query("SELECT source AS run, arg_max(epoch, (n, -epoch))::BIGINT AS epoch, max(n) AS macro_f1 FROM (SELECT source, length(lang) * 0 + (ascii(lang) % 5) AS epoch, count(*)::DOUBLE AS n FROM documents GROUP BY ALL) GROUP BY source")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run"), F.pmod(F.ascii("lang"), F.lit(5)).cast("long").alias("epoch")).agg(F.count(F.lit(1)).cast("double").alias("macro_f1"))
    return ensemble.best_epoch(runs)
