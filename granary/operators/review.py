"""Expert sheets, adjudication, review notes and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import col, join_list, split_list
from granary.operators.layout import running


def expert_sheet(cards: DataFrame) -> DataFrame:
    """Eighteen flat columns, the last five blank for the experts."""
    blanks = ["faithfulness_1_5", "edos_alignment_1_5", "usefulness_1_5", "decision_accept_reject_revision", "expert_notes"]
    text = {"source_id": "source_id", "source_title": "title", "source_publisher": "publisher", "source_year": "year", "source_page": "page", "source_url": "url"}
    return cards.select(
        "card_id",
        F.col("primary_label").alias("primary_edos_label"),
        join_list("secondary_labels").alias("secondary_edos_labels"),
        *[F.coalesce(F.col(f"source.{c}").cast("string"), F.lit("")).alias(name) for name, c in text.items()],
        "source_quote",
        "claim",
        F.col("edos_alignment").alias("edos_alignment_text"),
        join_list("keywords").alias("retrieval_keywords"),
        *[F.lit("").alias(c) for c in blanks],
    )


def accepted(decision: Column | str, faithfulness: Column | str, alignment: Column | str, usefulness: Column | str) -> Column:
    """The decision's first word wins; else all three scores must reach 4, 4 and 3.5."""
    said = F.lower(F.trim(F.coalesce(col(decision).cast("string"), F.lit(""))))
    f, a, u = (F.nullif(col(c).cast("string"), F.lit("")).try_cast("double") for c in (faithfulness, alignment, usefulness))
    scored = F.coalesce((f >= 4) & (a >= 4) & (u >= 3.5), F.lit(False))
    return F.when(said.startswith("reject"), F.lit(False)).when(said.startswith("accept"), F.lit(True)).otherwise(scored)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order."""
    by = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def adjudicate(sheet: DataFrame, cards: DataFrame) -> DataFrame:
    """Sheet rows that have a card (the last one of its id), with ``accepted``."""
    known = last_wins(cards, "card_id", "ord").select("card_id", "primary_label")
    return sheet.join(known, "card_id").withColumn("accepted", accepted("decision", "faithfulness", "alignment", "usefulness"))


def review_status(decision: Column | str, status: Column | str) -> Column:
    return F.when(col(decision) == "Accept", "validated").when(col(decision) == "Reject", "rejected").when(col(decision) == "Revise", "revised_candidate").otherwise(col(status))


def revised(original: Column | str, revision: Column | str, is_list: bool = False) -> Column:
    """The revision if there is one; lists are read from their text."""
    told = F.nullif(F.trim(col(revision)), F.lit(""))
    return F.when(told.isNotNull(), split_list(told) if is_list else told).otherwise(col(original))


def export_reviews(cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed cards with their revisions; a revised source stays beside the structured one."""
    joined = cards.join(reviews, "card_id")
    return joined.select(
        "card_id",
        review_status("decision", "status").alias("status"),
        revised("claim", "field_claim_revised").alias("claim"),
        revised("keywords", "field_keywords_revised", True).alias("keywords"),
        F.nullif(F.trim("field_source_revised"), F.lit("")).alias("source_revised"),
        F.struct(F.col("decision"), F.col("reviewer"), F.col("notes")).alias("expert_review"),
    )


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Union of columns; of equal keys the latest row stays."""
    return last_wins(current.unionByName(incoming, allowMissingColumns=True), key, order)


def arranged(rows: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that exist, then the others by name."""
    return rows.select(*[c for c in preferred if c in rows.columns], *sorted(c for c in rows.columns if c not in preferred))


def in_card_order(rows: DataFrame, key: str = "card_id", order: str = "card_order") -> DataFrame:
    """``rows`` with place (from 1) by ``order``, those without one last, then by key."""
    placed = rows.withColumn("_o", F.coalesce(F.col(order).cast("double"), F.lit(1e9))).withColumn("_one", F.lit(1))
    return running(placed, [], ["_o", key], "_one").withColumn("place", (F.col("before") + 1).cast("long")).drop("_o", "_one", "before", "total")


def score_1_3(x: Column | str) -> Column:
    value = col(x).try_cast("double")
    return F.when(value.isin(1.0, 2.0, 3.0), value.cast("int"))


def complete(*scores: str) -> Column:
    """All scores are given."""
    out = F.lit(True)
    for s in scores:
        out = out & score_1_3(s).isNotNull()
    return out


def annotation_rows(cards: DataFrame) -> DataFrame:
    """Flat rows for the score sheet; lists joined with semicolons, control characters dropped."""
    from granary.functions.text import strip_control

    source = [F.coalesce(F.col(f"source.{c}").cast("string"), F.lit("")).alias(f"source_{c}") for c in ("source_id", "title", "publisher", "year", "page", "section", "url")]
    return cards.select("card_id", "status", *source, strip_control("source_quote").alias("chunk"), strip_control("claim").alias("argument"), F.col("primary_label"), join_list("secondary_labels", "; ").alias("secondary_labels"), join_list("keywords", "; ").alias("keywords"))


def review_rows(reviews: DataFrame) -> DataFrame:
    """Blank review fields take their defaults: Accept, score 3, field status OK."""
    defaults = {"decision": "Accept", "faithfulness_score": "3", "specificity_score": "3", "usefulness_score": "3", "field_claim_status": "OK", "field_keywords_status": "OK"}
    return reviews.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) if c in reviews.columns else F.lit(v) for c, v in defaults.items()})


def progress(cards: DataFrame, annotations: DataFrame, key: str = "card_id") -> DataFrame:
    """reviewed, total, ratio."""
    done = annotations.select(key).distinct().withColumn("_done", F.lit(1))
    return cards.join(done, key, "left").agg(F.count("_done").alias("reviewed"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.when(F.col("total") > 0, F.col("reviewed") / F.col("total")).otherwise(F.lit(0.0)))


def annotated_state(cards: DataFrame, annotations: DataFrame, state: str, key: str = "card_id") -> DataFrame:
    """``all``, ``annotated`` or ``open`` cards."""
    how = {"annotated": "left_semi", "open": "left_anti"}
    if state == "all":
        return cards
    if state not in how:
        raise ValueError(f"unknown state {state}")
    return cards.join(annotations.select(key).distinct(), key, how[state])
