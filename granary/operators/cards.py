"""Evidence cards: building, normalising, selecting, deduplicating, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import generated_keywords, keyword_set, normalize_space, or_default, overlap, split_words, tokens
from granary.operators.layout import dealt, running


def normalize_cards(cards: DataFrame) -> DataFrame:
    """Defaults for empty values, one space for white space, sorted keyword sets."""
    source = F.struct(
        or_default("source.source_id", "UNKNOWN").alias("source_id"),
        F.coalesce("source.title", F.lit("")).alias("title"),
        F.coalesce("source.publisher", F.lit("")).alias("publisher"),
        *[F.col(f"source.{c}").alias(c) for c in ("year", "page", "section", "url")],
    )
    validation = F.struct(or_default("validation.status", "not_validated").alias("status"), *[F.col(f"validation.{c}").alias(c) for c in ("faithfulness", "edos_alignment", "usefulness", "notes")])
    texts = {c: normalize_space(c) for c in ("source_quote", "claim", "chunk", "reasoning", "argument", "edos_alignment") if c in cards.columns}
    return cards.withColumns({"status": or_default("status", "candidate"), **texts, "secondary_labels": F.coalesce("secondary_labels", F.array().cast("array<string>")), "keywords": keyword_set("keywords"), "source": source, "validation": validation})


def source_metadata(source: Column) -> Column:
    """A JSON source of any shape (VARIANT) as the fixed struct: trimmed texts, whole numbers for year and page or null, the file's stem as the title where there is none."""
    text = lambda c: F.nullif(F.trim(F.try_variant_get(source, f"$.{c}", "string")), F.lit(""))
    whole = lambda c: F.when(F.schema_of_variant(F.try_variant_get(source, f"$.{c}", "variant")).rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), F.try_variant_get(source, f"$.{c}", "int"))
    stem = F.regexp_replace(F.regexp_extract(text("file_name"), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.struct(
        F.coalesce(text("source_id"), F.lit("UNKNOWN")).alias("source_id"),
        F.coalesce(text("title"), F.translate(stem, "_-", "  "), F.lit("")).alias("title"),
        text("publisher").alias("publisher"),
        whole("year").alias("year"),
        whole("page").alias("page"),
        text("section").alias("section"),
        text("url").alias("url"),
        text("file_name").alias("file_name"),
    )


def dedupe_cards(cards: DataFrame, keys: list[Column], order: Column | str = "ord", valid: Column | None = None) -> DataFrame:
    """The first card of each key; validity is judged afterwards, so an invalid first card hides later ones."""
    first = Window.partitionBy(*keys).orderBy(order)
    out = cards.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return out if valid is None else out.filter(valid)


def coverage(cards: DataFrame, label: str = "primary_label", source: str = "source_id", card: str = "card_id", order: str = "ord") -> DataFrame:
    """Per label: cards, sources and the ids in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(card).cast("string").alias("id")))), lambda x: x["id"]), " | ")
    return cards.groupBy(label).agg(F.count(F.lit(1)).alias("num_cards"), F.countDistinct(source).alias("num_sources"), ids.alias("card_ids"))


def pack_coverage(cards: DataFrame, examples: int = 3) -> DataFrame:
    """Coverage with the sorted source ids, the number of secondary links and the first ids as examples."""
    rank = F.row_number().over(Window.partitionBy("primary_label").orderBy("ord", "card_id"))
    first = cards.select("primary_label", "ord", F.col("card_id").cast("string").alias("card_id")).withColumn("_rank", rank).filter(F.col("_rank") <= examples)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "card_id"))), lambda x: x["card_id"]), "; ")
    first = first.groupBy(F.col("primary_label").alias("_label")).agg(shown.alias("example_card_ids"))
    counts = cards.groupBy("primary_label").agg(
        F.count(F.lit(1)).alias("num_candidate_cards"),
        F.countDistinct("source_id").alias("num_sources"),
        F.array_join(F.array_sort(F.collect_set("source_id")), "; ").alias("source_ids"),
        F.sum(F.size("secondary_labels")).cast("long").alias("num_secondary_links"),
    )
    return counts.join(first, F.col("primary_label").eqNullSafe(F.col("_label"))).drop("_label")


def select_passages(passages: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Per label the ``most`` passages of the highest keyword overlap; the first ones if none overlaps.

    passages: passage_id, ord, text; labels: label, terms array (the stated set).
    """
    asked = labels.select("label", tokens(F.array_join("terms", " ")).alias("_wanted"))
    every = F.broadcast(asked.agg(F.array_distinct(F.flatten(F.collect_list("_wanted"))).alias("_every")))  # one row: the words of all labels
    held = dealt(passages.select("passage_id", "ord", "text")).select("passage_id", "ord", tokens("text").alias("_t"))  # words are made once per passage
    held = held.crossJoin(every).select("passage_id", "ord", F.array_intersect("_t", "_every").alias("_held"))
    scored = held.crossJoin(F.broadcast(asked)).select("label", "passage_id", "ord", overlap(F.col("_wanted"), F.col("_held")).alias("score"))
    by = Window.partitionBy("label")
    best = scored.withColumn("rank", F.row_number().over(by.orderBy(F.round("score", 9).desc(), "ord")).cast("long")).filter(F.col("rank") <= most)
    best = best.withColumn("_top", F.max("score").over(by)).filter((F.col("score") > 0) | (F.col("_top") <= 0)).drop("_top", "ord")  # of at most ``most`` rows a label
    return passages.join(F.broadcast(best), "passage_id")  # or else every text is shuffled for some rows


def first_accepted(passages: DataFrame, accepted: Column, n: int) -> DataFrame:
    """Per label the first n accepted passages in the order of their rank."""
    order = Window.partitionBy("label").orderBy("rank")
    return passages.filter(accepted).withColumn("accepted_rank", F.row_number().over(order).cast("long")).filter(F.col("accepted_rank") <= n)


def mock_id(label: str, number: str) -> Column:
    safe = F.replace(F.replace(F.replace(F.replace(label, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")), F.lit("&"), F.lit("and")), F.lit("."), F.lit("_"))
    return F.concat(F.lit("MOCK_"), safe, F.format_string("_%03d", F.col(number)))


def mock_cards(passages: DataFrame, definition: Column) -> DataFrame:
    """A card per selected passage without a model: the first 28 words as its quote.

    The wording of id, claim and alignment is a fixed value.
    """
    words = F.split(F.translate("label", "&.", "  "), " +")
    return passages.select(
        mock_id("label", "rank").alias("card_id"),
        F.lit("candidate").alias("status"),
        "passage_id",
        F.array_join(F.slice(split_words("text"), 1, 28), " ").alias("source_quote"),
        F.concat(F.lit("This source passage provides a quote-grounded candidate claim relevant to "), F.col("label"), F.lit(".")).alias("claim"),
        F.col("label").alias("primary_label"),
        F.array().cast("array<string>").alias("secondary_labels"),
        F.concat(F.lit("This mock card is aligned to "), F.col("label"), F.lit(": "), definition).alias("edos_alignment"),
        F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: F.length(w) > 2))), 1, 8).alias("keywords"),
    )


def ensure_card_ids(cards: DataFrame, label: str = "primary_label") -> DataFrame:
    """Blank card ids become SOURCE_label_NNN, counted in order within the label."""
    placed = running(cards.withColumn("_one", F.lit(1)), [label], ["ord"], "_one")
    code = F.replace(F.element_at(F.split(label, " "), 1), F.lit("."), F.lit("_"))
    made = F.concat_ws("_", or_default("source_id", "SRC"), code, F.format_string("%03d", F.col("before") + 1))
    return placed.withColumn("card_id", F.coalesce(F.nullif("card_id", F.lit("")), made)).select(cards.columns)


def assemble_cards(outputs: DataFrame) -> DataFrame:
    """Cards from generated fields with fixed defaults; ``error`` names the first missing one.

    outputs: card_id, label, chunk, reasoning, argument, definition, source.
    """
    texts = {c: normalize_space(c) for c in ("chunk", "reasoning", "argument")}
    missing = F.coalesce(*[F.when(texts[c] == "", F.lit(f"missing {c}")) for c in ("reasoning", "argument")])
    null = F.lit(None)
    validation = F.struct(F.lit("not_validated").alias("status"), *[null.cast("double").alias(c) for c in ("faithfulness", "edos_alignment", "usefulness")], null.cast("string").alias("notes"))
    return outputs.withColumns(
        {
            **texts,
            "error": missing,
            "status": F.lit("candidate"),
            "primary_label": F.col("label"),
            "secondary_labels": F.array().cast("array<string>"),
            "edos_alignment": F.concat(F.col("label"), F.lit(". EDOS definition: "), F.col("definition")),
            "keywords": generated_keywords("label", texts["argument"]),
            "validation": validation,
        }
    )


def missing_fields(required: dict[str, list[str]]) -> Column:
    """Names of fields whose columns (any of the alternates) are all blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns]).isNull(), F.lit(name)) for name, columns in required.items()]))


def prompt(template: str, **fields: Column) -> Column:
    """The template with ``{name}`` replaced; structs are shown as JSON."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))
