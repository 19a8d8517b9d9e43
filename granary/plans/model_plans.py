"""Queries around models and cards: prompts, assembled cards, attempts, frames of predictions, checks before a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import nested, text
from granary.operators import cards as card_ops, trainer
from granary.operators import checks, ensemble, models, retrieval, review
from granary.plans import retrieval_plans
from granary.plans.base import CARDS_SQL, TAXONOMY_SQL, TERMS, VOTERS, cards, flat_sql, label_of, label_sql, predictions, prob_sql, query, table, taxonomy, words_sql
from granary.streaming import attempts


@query(f"WITH {CARDS_SQL} SELECT doc_id, md5({flat_sql("concat_ws(' ', claim, edos_alignment, source_quote, primary_label, secondary_label, ' ' || upper(lang) || ' ' || source_id || '   ' || lang, title)")}) AS text_md5 FROM cards")
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card is searched by: its non-empty parts in a fixed order."""
    none = F.lit(None).cast("string")
    made = text.card_text(F.col("claim"), none, F.col("edos_alignment"), F.col("source_quote"), F.col("primary_label"), F.col("secondary_labels"), F.col("keywords"), F.col("source.section"), F.col("source.title"))
    return cards(spark, sf_dir).select("doc_id", F.md5(made).alias("text_md5"))


@query(f"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'missing argument' END AS error, CASE WHEN lang = 'de' THEN '' ELSE 'an argument of ' || lang END AS argument, {label_sql('doc_id')} AS primary_label,
  {label_sql('doc_id')} || '. EDOS definition: d' AS edos_alignment, 'not_validated' AS validation_status, md5({flat_sql('text')}) AS chunk_md5 FROM documents WHERE lang IS NOT NULL""")
def assemble_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards from generated fields; the label and the source are the pipeline's, a blank field rejects."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    outputs = docs.select("doc_id", F.col("text").alias("chunk"), F.lit(" because ").alias("reasoning"), F.when(F.col("lang") == "de", "  ").otherwise(F.concat(F.lit(" an  argument of "), "lang")).alias("argument"), label_of(F.col("doc_id")).alias("label"), F.lit("d").alias("definition"))
    made = card_ops.assemble_cards(outputs)
    return made.select("doc_id", "error", "argument", "primary_label", "edos_alignment", F.col("validation.status").alias("validation_status"), F.md5("chunk").alias("chunk_md5"))


@query(f"""WITH {CARDS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY primary_label ORDER BY ord) AS k FROM cards)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN card_id ELSE source_id || '_' || replace(split_part(primary_label, ' ', 1), '.', '_') || '_' || CASE WHEN k < 1000 THEN printf('%03d', k) ELSE k::VARCHAR END END AS card_id FROM n""")
def ensure_card_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second card has no id and gets one."""
    rows = cards(spark, sf_dir).select("doc_id", "ord", "primary_label", "source.source_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("card_id")).otherwise("").alias("card_id"))
    return card_ops.ensure_card_ids(rows).select("doc_id", "card_id")


@query(f"WITH {CARDS_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'claim' ELSE '' END AS missing FROM cards")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields, of which a claim may go by two names."""
    claim = F.when(F.pmod("doc_id", F.lit(3)) == 1, F.col("claim")).otherwise(" ")
    argument = F.when(F.pmod("doc_id", F.lit(3)) == 2, F.col("claim"))
    rows = cards(spark, sf_dir).withColumns({"claim": claim, "argument": argument})
    return rows.select("doc_id", F.array_join(card_ops.missing_fields({"claim": ["argument", "claim"], "label": ["primary_label"]}), ",").alias("missing"))


@query(f"WITH p AS (SELECT doc_id, {label_sql('doc_id // 2 % 4')} AS b, {label_sql('doc_id // 3 % 4')} AS c FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN b END AS task_b_label, CASE WHEN doc_id % 2 = 0 THEN 0.5 END AS task_b_confidence, c AS task_c_label, 0.25 AS task_c_confidence FROM p")
def annotations_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested annotations as flat columns."""
    corpus = table(spark, sf_dir, "documents").select("doc_id")
    for task, step, share, keep in (("task_b", 2, 0.5, F.pmod("doc_id", F.lit(2)) == 0), ("task_c", 3, 0.25, F.lit(True))):
        label = label_of(F.pmod(F.floor(F.col("doc_id") / step), F.lit(4)))
        preds = table(spark, sf_dir, "documents").filter(keep).select("doc_id", label.alias("label_pred"), F.lit(share).alias("confidence"), F.lit(False).alias("used_fallback"), F.lit(0).alias("ord"))
        corpus = ensemble.annotate(corpus, preds, task, "doc_id")
    flat = ensemble.flat(corpus, "task_b", "task_c")
    return flat.select("doc_id", F.col("task_b_label_pred").alias("task_b_label"), "task_b_confidence", F.col("task_c_label_pred").alias("task_c_label"), "task_c_confidence")


def _top_sql(sql: str, method: str, score: str) -> str:
    return f"SELECT '{method}' AS method, query_id, rank, doc_id, {score} AS score FROM ({sql})"


@query(" UNION ALL ".join(_top_sql(sql, m, s) for m, sql, s in (("basic", retrieval_plans.BASIC_TOP_SQL, "score"), ("dense_mmr", retrieval_plans.MMR_SQL, "relevance"), ("card_aware", retrieval_plans.CARD_TOP_SQL, "score"))))
def retrieve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three methods over the same cards."""
    found = retrieval.retrieve("all", retrieval_plans.library_cards(spark, sf_dir), retrieval_plans.asked(spark, sf_dir), 5)
    return found.select("method", "query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, doc_id // 2 % 4 AS m1, doc_id // 5 % 4 AS m2, md5(text) AS text_md5 FROM documents")
def aligned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by key that must hold the same keys, once, and the same texts."""
    docs = table(spark, sf_dir, "documents")
    frame = lambda step: docs.select("doc_id", F.md5("text").alias("text_md5"), F.pmod(F.floor(F.col("doc_id") / step), F.lit(4)).alias("pred"))
    rows = ensemble.aligned({"m1": frame(2), "m2": frame(5)}, "doc_id", same=("text_md5",))
    return rows.select("doc_id", F.col("m1.pred").alias("m1"), F.col("m2.pred").alias("m2"), F.col("m1.text_md5").alias("text_md5"))


@query("SELECT n_nationkey AS row_id, n_name AS a, n_regionkey AS b FROM nation")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets joined by the place of the row, numbered as they are read."""
    from granary.plans.source_plans import new_path, readers, sinks

    paths = [new_path(spark, "sheet") for _ in range(2)]
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    for path, c in zip(paths, ("n_name", "n_regionkey"), strict=True):
        sinks.csv(rows.select(c), path)
    frames = {p: readers.in_order(spark.read.option("header", True).csv(path)).select((F.col("ord") - 1).cast("int").alias("row_id"), c) for p, path, c in zip("ab", paths, ("n_name", "n_regionkey"), strict=True)}
    return ensemble.aligned(frames, "row_id").select("row_id", F.col("a.n_name").alias("a"), F.col("b.n_regionkey").cast("int").alias("b"))


STEP = list(VOTERS.values())[2]


@query(f"WITH {TAXONOMY_SQL} SELECT doc_id, (doc_id // {STEP}) % 4 AS pred_id, label AS label_pred, 0.5 AS confidence, 0.5 AS softmax_max_value, round({prob_sql(STEP, '10')}, 6) AS prob_10 FROM documents JOIN taxonomy ON label_id = (doc_id // {STEP}) % 4")
def prediction_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities as a frame: the first most likely label, its probability under both names, one column each."""
    rows = predictions(spark, sf_dir, STEP).drop("pred_id")
    frame = ensemble.prediction_frame(rows, taxonomy(spark), [f"prob_{i}" for i in range(11)])
    return frame.select("doc_id", F.col("pred_id").cast("long").alias("pred_id"), "label_pred", "confidence", "softmax_max_value", F.round("prob_10", 6).alias("prob_10"))


@query("SELECT count(*) FILTER (user_id IS NULL) = 0 AS all_attempted, true AS may_resume, false AS may_resume_changed FROM (SELECT c_custkey FROM customer) c LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = c_custkey")
def resume_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all planned work is in the log, and whether a run may go on over its input."""
    planned, log = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, sf_dir, "events")
    return spark.createDataFrame([(attempts.all_attempted(planned, log, "user_id"), attempts.may_resume("a", "a"), attempts.may_resume("a", "b"))], "all_attempted boolean, may_resume boolean, may_resume_changed boolean")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 3")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of an id, which must be there."""
    return checks.point(table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id")), "doc_id", 3).select("doc_id", "lang", "source")


@query("SELECT lang AS label, row_number() OVER (ORDER BY lang) AS place FROM (SELECT DISTINCT lang FROM documents WHERE lang IN ('de', 'en', 'es', 'fr'))")
def shared_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that were asked for, retrieved and have a profile, sorted."""
    from pyspark.sql import Window

    profiles = spark.createDataFrame([(k,) for k in TERMS], "label string")
    retrieved = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    shared = checks.sorted_distinct(checks.shared_labels(profiles, retrieved, profiles), "label")
    return shared.withColumn("place", F.row_number().over(Window.orderBy("label")).cast("long"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'error' WHEN doc_id % 4 = 1 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'ValueError: no answer' END AS error, CASE WHEN doc_id % 4 > 0 THEN lang || ' ' || source END AS argument FROM documents")
def routed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation by a stand-in, its errors noted, its outputs judged."""

    def factory():
        echo = models.echo_generator()()

        def model(prompts: list[str]) -> list[str]:
            if any(p.endswith("#0") for p in prompts):
                raise ValueError("no answer")
            return echo([p.rsplit("\n", 1)[0] for p in prompts])

        return model

    prompt = F.concat(F.lit("Say\n"), F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")), F.lit("\n#"), F.pmod("doc_id", F.lit(4)))
    out = models.generate(table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt")), factory, back_off=0.0)
    routed = models.route(out, F.pmod("doc_id", F.lit(4)) == 1)
    return routed.select("doc_id", "status", "error", F.get_json_object("output", "$.argument").alias("argument"))


@query("SELECT 'b' AS alias, 1 AS place UNION ALL SELECT 'a', 2 UNION ALL SELECT 'a', 11")
def selected_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models asked for in their order, else those that are enabled."""
    specs = [{"alias": "a"}, {"alias": "b", "enabled": False}]
    rows = [(s["alias"], i) for i, s in enumerate(models.select_models(specs, ["b", "a"]), 1)] + [(s["alias"], 10 + i) for i, s in enumerate(models.select_models(specs), 1)]
    return spark.createDataFrame(rows, "alias string, place int")


ANSWERED_SQL = """
WITH made AS (SELECT doc_id, lang, source, CASE
    WHEN doc_id % 3 = 0 THEN '{"counter_narrative": " about ' || coalesce(source, '') || ' ", "used_claim": "c' || doc_id || '", "more": 1}'
    WHEN doc_id % 3 = 1 THEN 'Sure: {"counter_narrative": "in words", "grounding_note": " by card "} I hope it helps.'
    ELSE ' no object {, ' || coalesce(source, '') END AS output FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim('about ' || coalesce(source, '')) WHEN 1 THEN 'in words' ELSE trim(output) END AS counter_narrative,
  CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id ELSE '' END AS used_claim,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'by card' ELSE 'Model did not return valid JSON; raw text was stored.' END AS grounding_note,
  lang AS language, 'm' AS model, output AS raw_model_output FROM made"""


@query(ANSWERED_SQL)
def generation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of answers that are an object, hold one amid other text, or are plain text."""
    null = F.lit(None).cast("string")
    source = F.coalesce("source", F.lit(""))
    given = F.concat(F.lit('{"counter_narrative": " about '), source, F.lit(' ", "used_claim": "c'), "doc_id", F.lit('", "more": 1}'))
    amid = F.lit('Sure: {"counter_narrative": "in words", "grounding_note": " by card "} I hope it helps.')
    output = F.when(F.col("doc_id") % 3 == 0, given).when(F.col("doc_id") % 3 == 1, amid).otherwise(F.concat(F.lit(" no object {, "), source))
    model = F.struct(F.lit("ollama").alias("provider"), F.lit("m").alias("model"))
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("hate_speech"), null.alias("strategy"), F.col("lang").alias("language"), F.lit(2).alias("max_sentences"), F.col("doc_id").cast("string").alias("card_id"), *[null.alias(c) for c in ("primary_label", "reasoning", "argument", "claim", "chunk", "source_quote", "source")], model.alias("model"), output.alias("output"))
    made = models.generation_record(rows)
    return made.select(F.col("card.card_id").cast("long").alias("doc_id"), "generation.*", "input.language", "model.model", "raw_model_output")


@query(f"WITH {CARDS_SQL} SELECT doc_id, coalesce(secondary_label, '') AS labels, year::VARCHAR AS year, source_id AS source FROM cards")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of any type as one line of text."""
    rows = cards(spark, sf_dir).select("doc_id", F.col("secondary_labels").alias("labels"), "source.year", F.struct("source.source_id").alias("source"))
    kinds = dict(rows.dtypes)
    shown = rows.select("doc_id", *[F.coalesce(text.display(F.col(c), kinds[c]), F.lit("")).alias(c) for c in ("labels", "year", "source")])
    return shown.withColumn("source", F.get_json_object("source", "$.source_id"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n_turns, CASE WHEN event_id % 3 <> 0 THEN event_type END AS first_text FROM events")
def data_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns under ``data`` of an object, none where there is no such list."""
    turn = F.struct(F.lit("a").alias("speaker"), F.col("event_type").alias("text"))
    made = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct(F.array(turn, turn).alias("data"))))
    rows = table(spark, sf_dir, "events").select("event_id", nested.data_turns(made, "array<struct<speaker:string,text:string>>").alias("t"))
    return rows.select("event_id", F.size("t").alias("n_turns"), F.get("t", 0)["text"].alias("first_text"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'raw ' || event_id END AS answer FROM events")
def fallback_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in an answer, or else the answer in an object."""
    raw = F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit('Sure: {"answer": "'), "event_type", F.lit('",}'))).otherwise(F.concat(F.lit("raw "), "event_id"))
    found = nested.json_object_or(raw, F.struct(raw.alias("answer")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(found, "$.answer", "string").alias("answer"))


@query(f"WITH {CARDS_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' ELSE source_id END AS source_id, CASE WHEN doc_id % 2 = 0 THEN title ELSE 'a file ' || lang END AS title, CASE WHEN doc_id % 2 = 0 THEN year END AS year FROM cards WHERE lang IS NOT NULL")
def source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of any shape brought into one: a title from the file's name, years that are no whole numbers dropped."""
    rows = cards(spark, sf_dir).filter("lang IS NOT NULL")
    even = F.pmod("doc_id", F.lit(2)) == 0
    fields = {"source_id": F.when(F.pmod("doc_id", F.lit(3)) > 0, F.concat(F.lit(" "), "source.source_id")), "title": F.when(even, F.col("source.title")).otherwise(" "), "file_name": F.concat(F.lit("/in/a_file-"), "lang", F.lit(".pdf"))}
    raw = F.concat(F.rtrim(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), F.lit("}")), F.lit(', "year": '), F.when(even, F.col("source.year").cast("string")).otherwise(F.concat(F.lit('"'), "source.year", F.lit('"'))), F.lit("}"))
    made = rows.select("doc_id", card_ops.source_metadata(F.try_parse_json(raw)).alias("s"))
    return made.select("doc_id", "s.source_id", "s.title", "s.year")


@query("SELECT doc_id, greatest(0, least(doc_id - 5, 99)) AS place FROM documents")
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place kept inside a list of 100."""
    return table(spark, sf_dir, "documents").select("doc_id", checks.clamped(F.col("doc_id") - 5, 100).alias("place"))


@query(f"SELECT doc_id, md5('Passage: ' || array_to_string({words_sql('lang')}, ' ')) AS prompt_md5 FROM documents WHERE lang IS NOT NULL")
def query_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that an embedding model is given: a prompt before queries."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    return docs.select("doc_id", F.md5(text.with_prompt(F.array_join(text.tokens("lang"), " "), "Passage: ")).alias("prompt_md5"))


@query()
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts by a stand-in model, queries with a prompt."""
    rows = models.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), models.hash_embedder(32), prompt="query: ")
    return rows.select("doc_id", "embedding")


@query()
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all texts by a stand-in model."""
    rows = models.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), models.hash_embedder(11))
    return rows.select("doc_id", "probs")


@query(f"WITH {CARDS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'validated' ELSE coalesce(nullif(status, ''), 'blank') END AS status FROM cards")
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review states over the card's own, which stay where nothing was decided."""
    decision = F.when(F.pmod("doc_id", F.lit(4)) == 0, "Accept").otherwise("")
    return cards(spark, sf_dir).select("doc_id", F.coalesce(F.nullif(review.review_status(decision, "status"), F.lit("")), F.lit("blank")).alias("status"))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[trainer.Trained, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("label"))
    docs = docs.withColumn("held", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    return trainer.train(docs, F.col("held")), docs


@query()
def trained_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and held-out figures of every epoch of a classifier of the language, and the best of them."""
    found, _ = _trained(spark, sf_dir)
    rows = [(e["epoch"], e["loss"], e["macro_f1"], e["accuracy"], e["epoch"] == found.best) for e in found.epochs]
    return spark.createDataFrame(rows, "epoch int, loss double, macro_f1 double, accuracy double, best boolean")


@query()
def trained_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best epoch's model says of every document."""
    found, docs = _trained(spark, sf_dir)
    return trainer.predict(found, docs, "doc_id", "held", "label")
