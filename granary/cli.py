"""Command line: each command reads files, runs one plan and writes files.

python -m granary.cli COMMAND --help
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import nested
from granary.functions.text import card_id, quote_in_passage, source_line
from granary.operators import cards, checks, chunking, ensemble, metrics, models, prompts, retrieval, review, splits
from granary.operators.layout import stored
from granary.plans import base
from granary.sources import readers, sinks
from granary.streaming import attempts
from granary.streaming.commits import Commits

CHUNK = "chunk_id string, source struct<source_id:string,title:string,publisher:string,year:int,page:int,section:string,url:string>, text string"


def profiles(spark: SparkSession, path: str) -> DataFrame:
    config = readers.yaml_config(spark, path)["labels"]
    return spark.createDataFrame([(k, v["definition"], list(v["search_terms"]), i) for i, (k, v) in enumerate(config.items())], "label string, definition string, terms array<string>, ord int")


def library(rows: DataFrame) -> DataFrame:
    from granary.functions.text import card_text

    c = {name: F.coalesce(F.col(name), F.lit("")) for name in ("argument", "claim", "reasoning", "edos_alignment", "chunk", "source_quote", "primary_label")}
    argument, chunk = F.coalesce(F.nullif(c["argument"], F.lit("")), c["claim"]), F.coalesce(F.nullif(c["chunk"], F.lit("")), c["source_quote"])
    text = card_text(argument, c["reasoning"], c["edos_alignment"], chunk, c["primary_label"], F.col("secondary_labels"), F.col("keywords"), F.col("source.section"), F.col("source.title"))
    quality = retrieval.validation_quality(*[F.col(f"validation.{x}") for x in ("faithfulness", "edos_alignment", "usefulness")])
    return rows.select(F.col("card_id").alias("doc_id"), text.alias("text"), F.col("source.source_id").alias("source_id"), F.col("primary_label").alias("primary"), F.coalesce("secondary_labels", F.array().cast("array<string>")).alias("secondary"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), quality.alias("quality"))


def parse(spark, a):
    if a.pages:
        pages = readers.jsonl(spark, a.pages, "source_id string, page int, text string", strict=True)
    else:
        found = readers.files(spark, a.source_dir, "*.[hH][tT][mM]*")
        pages = found.select("source_id", F.lit(1).alias("page"), readers.parsed_html(F.col("content").cast("string")).alias("text"))
        pdfs = readers.files(spark, a.source_dir)
        if not pdfs.isEmpty():
            pages = pages.unionByName(readers.pdf_pages(pdfs))
    chunks = chunking.chunk_words(pages, size=a.chunk_size, overlap=a.overlap)
    numbered = chunking.number_chunks(chunks, "source_id", "page")
    source = F.struct("source_id", F.col("page").cast("int").alias("page"))
    sinks.jsonl(numbered.select("chunk_id", "source_id", "page", source.alias("source"), F.col("chunk").alias("text")), a.output)


def encode(spark, a):
    rows = models.embed(readers.jsonl(spark, a.chunks, CHUNK, strict=True).select("chunk_id", "text"), models.hash_embedder(a.dim), batch=a.batch_size)
    sinks.embedding_index(rows.select("chunk_id", "embedding", F.lit(a.model).alias("model_name")), a.output)


def retrieve_chunks(spark, a):
    retrieval.check_arguments(a.top_k, a.candidate_pool_size, a.lambda_mult)
    index = readers.embedding_index(spark, a.index).select(F.col("chunk_id").alias("item_id"), F.col("embedding").alias("vec"))
    asked = profiles(spark, a.profiles).select(F.col("label").alias("query_id"), F.concat_ws(". ", "label", "definition").alias("text"))
    queries = models.embed(asked, models.hash_embedder(a.dim), prompt=a.prompt).select("query_id", F.col("embedding").alias("vec"))
    sinks.jsonl(retrieval.mmr(retrieval.dense_topk(index, queries, a.candidate_pool_size), a.top_k, a.lambda_mult), a.output)


def retrieve_cards(spark, a):
    cards_in = library(readers.card_lines(spark, a.cards, strict=True))
    query = spark.createDataFrame([(0, a.hate_speech, a.label)], "query_id int, text string, label string")
    weights = readers.yaml_config(spark, a.weights).get("weights") if a.weights else None
    sinks.jsonl(retrieval.retrieve(a.method, cards_in, query, a.top_k, a.lambda_mult, weights), a.output)


def published(rows: DataFrame) -> Column:
    """Cards as JSON under the published names, for schema checks."""
    names = {own: c for c, own in readers.PUBLISHED.items()}
    return F.to_json(F.struct(*[F.col(c).alias(names.get(c, c)) for c in rows.columns if not c.startswith("_") and c != "ord"]), {"ignoreNullFields": "false"})


def valid(spark: SparkSession, rows: DataFrame, schema_path: str | None) -> Column:
    """Whether a card fits the schema file; without one every card does."""
    if not schema_path:
        return F.lit(True)
    return F.size(nested.schema_errors(published(rows), json.loads(readers.document(spark, schema_path)))) == 0


def extract(spark, a):
    chunks = readers.in_order(spark.read.schema(CHUNK).json(a.chunks))
    labels = profiles(spark, a.profiles)
    chosen = cards.select_passages(chunks.select(F.col("chunk_id").alias("passage_id"), "ord", "text"), labels.select("label", "terms"), a.max_passages).join(labels.select("label", "definition"), "label")
    chosen = chosen.join(chunks.select(F.col("chunk_id").alias("passage_id"), "source"), "passage_id")
    if a.mock:
        made = cards.mock_cards(chosen, F.col("definition")).join(chosen.select("passage_id", F.col("label").alias("primary_label"), "rank", "source", F.col("text").alias("_passage")), ["passage_id", "primary_label"])
    else:
        spec = {"alias": a.model, "url": a.url, "fields": ["source_quote", "claim", "edos_alignment"]}
        asked = chosen.withColumn("prompt", prompts.quote_card(F.col("label"), F.col("definition"), F.col("source"), F.col("text")))
        told = models.generate(asked, models.generator(spec)).withColumn("_o", nested.json_object("output")).filter("_o IS NOT NULL")
        field = lambda c, kind="string": F.try_variant_get("_o", f"$.{c}", kind).alias(c)
        no_list = F.array().cast("array<string>")
        made = told.select(field("card_id"), F.lit("candidate").alias("status"), "passage_id", field("source_quote"), field("claim"), F.col("label").alias("primary_label"), F.coalesce(field("secondary_edos_labels", "array<string>"), no_list).alias("secondary_labels"), field("edos_alignment"), F.coalesce(field("retrieval_keywords", "array<string>"), no_list).alias("keywords"), "rank", "source", F.col("text").alias("_passage"))
    own = made.drop("rank", "passage_id", "_passage")
    fits = valid(spark, own, a.schema)
    if not a.no_enforce_quote_match:
        fits = fits & quote_in_passage("source_quote", "_passage")
    kept = cards.first_accepted(made.withColumn("label", F.col("primary_label")), fits, a.cards_per_label)
    if a.mock:
        kept = kept.withColumn("card_id", cards.mock_id("primary_label", "accepted_rank"))
    else:
        kept = cards.ensure_card_ids(kept.withColumn("ord", F.col("accepted_rank")).withColumn("source_id", F.col("source.source_id"))).drop("ord", "source_id")
    sinks.card_lines(kept.select(*own.columns), a.output)


def generate_cards(spark, a):
    """Cards of every enabled model for the best chunks of every label; what the log has is not tried again."""
    fingerprint, marker = readers.fingerprint(spark, a.retrieved) if a.retrieved.endswith((".json", ".jsonl")) else a.retrieved, f"{a.output_dir}/input.json"
    before = json.loads(readers.document(spark, marker))["input"] if readers.exists(spark, marker) else None
    if before is not None and not a.resume:
        raise ValueError(f"{a.output_dir} holds a run; resume it or choose another folder")
    if not attempts.may_resume(before, fingerprint):
        raise ValueError("the retrieved chunks are others than those the run began with")
    sinks.put_text(spark, marker, json.dumps({"input": fingerprint}))
    specs = models.select_models(readers.yaml_config(spark, a.models)["models"] if a.models else [{"alias": "echo"}], a.aliases)
    found = readers.jsonl(spark, a.retrieved, "query_id string, item_id string, rank long", strict=True).filter(F.col("rank") <= a.cards_per_label)
    labels = profiles(spark, a.profiles).select("label", "definition")
    wanted = spark.createDataFrame([(x,) for x in a.labels], "label string") if a.labels else found.select(F.col("query_id").alias("label")).distinct()
    checks.shared_labels(wanted, found.withColumnRenamed("query_id", "label"), labels)
    chunks = readers.jsonl(spark, a.chunks, CHUNK, strict=True)
    planned = found.select(F.col("query_id").alias("label"), F.col("item_id").alias("chunk_id")).join(wanted, "label", "left_semi").join(labels, "label").join(chunks, "chunk_id")
    log_schema = "status string, model_alias string, label string, chunk_id string, card_id string, error string, raw_output string"
    for spec in specs:
        log, out = f"{a.output_dir}/{spec['alias']}_attempts", f"{a.output_dir}/{spec['alias']}_cards"
        runs = Commits(spark, f"{a.output_dir}/{spec['alias']}_commits", out, log)
        run = runs.begin()
        done = runs.read(log, log_schema)
        left = attempts.remaining(planned, done, "label", "chunk_id")
        if left.isEmpty():
            continue
        asked = left.withColumn("prompt", prompts.argument_card(F.col("label"), F.col("definition"), F.col("source"), F.col("chunk_id"), F.col("text")))
        told = models.generate(asked, models.generator(spec), retries=a.retries).withColumnRenamed("error", "_error").withColumn("_o", nested.json_object("output"))
        fields = {c: F.try_variant_get("_o", f"$.{c}", "string") for c in ("reasoning", "argument")}
        made = cards.assemble_cards(told.withColumns(fields).withColumn("chunk", F.col("text"))).withColumn("card_id", card_id(F.lit(spec["alias"]), F.col("source.source_id"), F.col("label"), F.col("chunk_id")))
        card = ["card_id", "status", "source", "chunk", "reasoning", "argument", "primary_label", "secondary_labels", "edos_alignment", "keywords", "validation"]
        fault = F.when(F.col("_o").isNull(), F.lit("no JSON object")).otherwise(F.col("error"))
        fault = F.coalesce(fault, F.when(~valid(spark, made.select(*card), a.schema), F.lit("schema errors")))
        judged = stored(models.route(made.withColumn("_fault", fault).withColumn("error", F.col("_error")), F.col("_fault").isNotNull()).withColumnRenamed("status", "_status").withColumn("status", F.lit("candidate")).drop("_o"), "attempts")
        sinks.card_lines(judged.filter("_status = 'accepted'").select(*card), f"{out}/run={run}")
        sinks.jsonl(judged.select(F.col("_status").alias("status"), F.lit(spec["alias"]).alias("model_alias"), "label", "chunk_id", "card_id", F.coalesce("error", "_fault").alias("error"), F.col("output").alias("raw_output")), f"{log}/run={run}")
        runs.commit(run)  # cards and attempts count from here on, together
        counts = attempts.counters(runs.read(log, log_schema), "model_alias", planned=planned.withColumn("model_alias", F.lit(spec["alias"])), before=done)
        sinks.json_report(counts, f"{a.output_dir}/{spec['alias']}_summary.json")


def generate_one(spark, a):
    """One answer to a message from one card."""
    if a.card_json:
        chosen = readers.single_card(spark, a.card_json).withColumn("ord", F.lit(1))
    else:
        chosen = checks.point(readers.card_lines(spark, a.cards, strict=True), "card_id", a.card_id)
    lacking = cards.missing_fields({"card_id": ["card_id"], "primary_edos_label": ["primary_label"], "edos_alignment": ["edos_alignment"], "chunk": ["chunk", "source_quote"], "argument": ["argument", "claim"]})
    if missing := chosen.select(lacking.alias("m")).head()["m"]:
        raise ValueError(f"the card lacks {missing}")
    line = source_line(*[F.col(f"source.{c}") for c in ("title", "publisher", "year", "page", "url", "file_name")])
    asked = chosen.withColumn("hate_speech", F.lit(a.hate_speech)).withColumn("prompt", prompts.counter(F.lit(a.hate_speech), line, a.language, a.max_sentences, a.cite_source, a.strategy))
    spec = {"alias": a.model, "url": a.url, "temperature": a.temperature, "timeout": a.timeout, "fields": list(models.ANSWER)}
    told = models.generate(asked, models.generator(spec), retries=2)
    model = F.struct(F.lit("ollama" if a.url else "stand-in").alias("provider"), F.lit(a.model).alias("model"), F.lit(a.temperature).alias("temperature"), F.lit(a.url).cast("string").alias("ollama_url"))
    rows = told.withColumns({"strategy": F.lit(a.strategy).cast("string"), "language": F.lit(a.language), "max_sentences": F.lit(a.max_sentences), "model": model})
    sinks.json_report(models.generation_record(rows), a.output)


def normalize(spark, a):
    rows = cards.normalize_cards(readers.card_lines(spark, a.input)).withColumn("_source_id", F.col("source.source_id"))
    fits = valid(spark, rows, a.schema)
    if a.dedupe:
        rows = cards.dedupe_cards(rows, [F.col("primary_label"), F.col("_source_id"), F.lower("source_quote")], "ord", fits)
    else:
        rows = rows.filter(fits)
    rows = stored(rows.withColumn("source_id", F.col("_source_id")).drop("_source_id"), "normalized")
    sinks.card_lines(rows.orderBy("ord").drop("ord", "source_id"), a.output)
    sinks.csv(cards.coverage(rows), a.coverage_output or f"{a.output}_coverage")


def sheet(spark, a):
    sinks.csv(review.expert_sheet(cards.normalize_cards(readers.card_lines(spark, a.cards, strict=True))), a.output)


def adjudicate(spark, a):
    known = readers.card_lines(spark, a.cards, strict=True)
    rows = readers.csv(spark, a.validation, "card_id", "decision_accept_reject_revision").select("card_id", F.col("decision_accept_reject_revision").alias("decision"), F.col("faithfulness_1_5").alias("faithfulness"), F.col("edos_alignment_1_5").alias("alignment"), F.col("usefulness_1_5").alias("usefulness"))
    judged = review.adjudicate(rows, known)
    sinks.csv(judged, a.report)
    last = review.last_wins(known, "card_id", "ord")
    sinks.card_lines(last.join(judged.filter("accepted").select("card_id").distinct(), "card_id", "left_semi").drop("ord").withColumn("status", F.lit("validated")), a.output)


def prepare(spark, a):
    corpus = readers.in_order(readers.csv(spark, a.corpus, "rewire_id", "text", "label_sexist", "label_category", "label_vector", "split"))
    label = "label_category" if a.task == "b" else "label_vector"
    more = None
    if a.augmentation:
        more = readers.in_order(readers.csv(spark, a.augmentation, "generated_text", "label_vector")).select(F.col("generated_text").alias("text"), F.col("label_vector").alias("label"), "ord")
    parts = splits.build_splits(corpus.withColumn("label", F.col(label)), more, not a.no_dev_in_train)
    for name in ("train", "dev", "test"):
        sinks.csv(parts.filter(F.col("part") == name).orderBy("piece", "ord").select("text", "label"), f"{a.output_dir}/{name}")


def vote(spark, a):
    def frame(path):
        key = "instance_id" if a.align_by == "instance_id" else "row_id"
        return readers.csv(spark, path, key, a.label_column).select(F.col(key).alias("key"), F.col(a.label_column).alias("label"), F.col(a.confidence_column).cast("double").alias("confidence"))

    frames = {f"m{i}": frame(p) for i, p in enumerate(a.base_preds)} | {"fallback": frame(a.fallback_preds)}
    rows = ensemble.vote_generic(ensemble.aligned(frames, "key"), [f"m{i}" for i in range(len(a.base_preds))], "fallback")
    sinks.csv(rows.select("key", "label_pred", "confidence", "used_fallback", "fallback_pred", "base_votes"), a.output)


def predict(spark, a):
    """Labels of a keyed corpus by the stand-in classifier, in place of weights that are not at hand."""
    corpus, labels = readers.strict_corpus(spark, a.input, a.text_field), base.taxonomy(spark)
    if a.task == "b":
        labels = labels.select(F.col("parent_id").alias("label_id"), F.col("parent").alias("label")).distinct()
    n = labels.count()  # the labels of a task
    frame = ensemble.prediction_frame(models.classify(corpus, models.hash_embedder(n)), labels)
    rows = sinks.wide_probabilities(frame, "probs", None, n) if a.include_probs else frame.drop("probs")
    sinks.csv(rows, a.output)


def vote_official(spark, a):
    """Four voters and a fallback by row, which must agree on ids and texts; with gold labels also metrics."""
    n = len(base.TAXONOMY)

    def frame(path):
        rows = readers.csv(spark, path, "row_id", "instance_id", "text", "pred_id", *[f"prob_{i}" for i in range(n)], optional=("gold_label",))
        return rows.select(F.col("row_id").cast("long").alias("row_id"), "instance_id", "text", "gold_label", F.col("pred_id").cast("int").alias("pred_id"), F.array(*[F.col(f"prob_{i}").cast("double") for i in range(n)]).alias("probs"))

    frames = {f"m{i}": frame(p) for i, p in enumerate(a.base_preds, 1)} | {"fallback": frame(a.fallback_preds)}
    voted = ensemble.vote(ensemble.aligned(frames, "row_id", same=("instance_id", "text")), list(frames)[:-1], "fallback")
    named = voted.join(base.taxonomy(spark).select(F.col("label_id").alias("pred_id"), F.col("label").alias("label_pred")), "pred_id")
    out = named.select("row_id", "m1.instance_id", "m1.text", "pred_id", "label_pred", "used_fallback", "top_vote_count", "confidence", "confidence_kind", "vote_counts", F.col("m1.gold_label").alias("gold_label"))
    sinks.csv(out.orderBy("row_id"), a.output)
    if a.metrics_json:
        sinks.json_report(metrics.f1_summary(out, "gold_label", "label_pred").crossJoin(ensemble.fallback_rate(voted)), a.metrics_json)


def evaluate(spark, a):
    rows = readers.csv(spark, a.predictions, a.gold, a.pred)
    sinks.json_report(metrics.f1_summary(rows, a.gold, a.pred), a.output)


def annotate(spark, a):
    corpus = readers.strict_corpus(spark, a.input, a.text_field)
    for task, path in (("TASK_B", a.task_b), ("TASK_C", a.task_c)):
        preds = readers.csv(spark, path, "instance_id", "label_pred", optional=("confidence", "used_fallback"))
        corpus = ensemble.annotate(corpus, readers.in_order(preds), task)
    if readers.exists(spark, a.output) and not a.overwrite:
        raise ValueError(f"{a.output} is there already")
    corpus = stored(corpus, "annotated")
    sinks.jsonl(corpus, a.output)
    if a.output_csv:
        sinks.csv(ensemble.flat(corpus, "TASK_B", "TASK_C").orderBy("row_id"), a.output_csv)


COMMANDS = {
    "parse": (parse, {"--pages": {}, "--source-dir": {}, "--output": {"required": True}, "--chunk-size": {"type": int, "default": 350}, "--overlap": {"type": int, "default": 80}}),
    "encode": (encode, {"--chunks": {"required": True}, "--output": {"required": True}, "--model": {"default": "hash"}, "--dim": {"type": int, "default": 256}, "--batch-size": {"type": int, "default": 8}}),
    "retrieve-chunks": (retrieve_chunks, {"--index": {"required": True}, "--profiles": {"required": True}, "--output": {"required": True}, "--top-k": {"type": int, "default": 10}, "--candidate-pool-size": {"type": int, "default": 100}, "--lambda-mult": {"type": float, "default": 0.5}, "--dim": {"type": int, "default": 256}, "--prompt": {"default": ""}}),
    "retrieve-cards": (retrieve_cards, {"--cards": {"required": True}, "--hate-speech": {"required": True}, "--label": {}, "--output": {"required": True}, "--method": {"choices": ["basic", "dense_mmr", "card_aware", "all"], "default": "card_aware"}, "--top-k": {"type": int, "default": 5}, "--lambda-mult": {"type": float, "default": 0.7}, "--weights": {}}),
    "extract": (extract, {"--chunks": {"required": True}, "--profiles": {"required": True}, "--output": {"required": True}, "--cards-per-label": {"type": int, "default": 5}, "--max-passages": {"type": int, "default": 40}, "--schema": {}, "--mock": {"action": "store_true"}, "--no-enforce-quote-match": {"action": "store_true"}, "--model": {"default": "echo"}, "--url": {}}),
    "generate-cards": (generate_cards, {"--chunks": {"required": True}, "--retrieved": {"required": True}, "--profiles": {"required": True}, "--output-dir": {"required": True}, "--models": {}, "--aliases": {"nargs": "*"}, "--labels": {"nargs": "*"}, "--cards-per-label": {"type": int, "default": 10}, "--schema": {}, "--resume": {"action": "store_true"}, "--retries": {"type": int, "default": 2}}),
    "generate-one": (generate_one, {"--cards": {}, "--card-id": {}, "--card-json": {}, "--hate-speech": {"required": True}, "--strategy": {}, "--language": {"default": "English"}, "--max-sentences": {"type": int, "default": 2}, "--cite-source": {"action": "store_true"}, "--temperature": {"type": float, "default": 0.2}, "--timeout": {"type": float, "default": 120.0}, "--model": {"default": "echo"}, "--url": {}, "--output": {"required": True}}),
    "normalize": (normalize, {"--input": {"required": True}, "--output": {"required": True}, "--dedupe": {"action": "store_true"}, "--coverage-output": {}, "--schema": {}}),
    "sheet": (sheet, {"--cards": {"required": True}, "--output": {"required": True}}),
    "adjudicate": (adjudicate, {"--cards": {"required": True}, "--validation": {"required": True}, "--output": {"required": True}, "--report": {"required": True}}),
    "prepare": (prepare, {"--task": {"choices": ["b", "c"], "required": True}, "--corpus": {"required": True}, "--augmentation": {}, "--output-dir": {"required": True}, "--no-dev-in-train": {"action": "store_true"}}),
    "vote": (vote, {"--base-preds": {"nargs": "+", "required": True}, "--fallback-preds": {"required": True}, "--output": {"required": True}, "--align-by": {"choices": ["row", "instance_id"], "default": "instance_id"}, "--label-column": {"default": "label_pred"}, "--confidence-column": {"default": "confidence"}}),
    "predict": (predict, {"--task": {"choices": ["b", "c"], "required": True}, "--input": {"required": True}, "--text-field": {"default": "HATE_SPEECH"}, "--output": {"required": True}, "--include-probs": {"action": "store_true"}}),
    "vote-official": (vote_official, {"--base-preds": {"nargs": 4, "required": True}, "--fallback-preds": {"required": True}, "--output": {"required": True}, "--metrics-json": {}}),
    "evaluate": (evaluate, {"--predictions": {"required": True}, "--gold": {"default": "gold_label"}, "--pred": {"default": "label_pred"}, "--output": {"required": True}}),
    "annotate": (annotate, {"--input": {"required": True}, "--task-b": {"required": True}, "--task-c": {"required": True}, "--output": {"required": True}, "--output-csv": {}, "--overwrite": {"action": "store_true"}, "--text-field": {"default": "HATE_SPEECH"}}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="granary")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        command = commands.add_parser(name)
        for option, settings in options.items():
            command.add_argument(option, **settings)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("granary").getOrCreate(), a)


if __name__ == "__main__":
    main()
