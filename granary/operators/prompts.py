"""What models are asked: card extraction, card writing, and an answer grounded in a card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.operators.cards import prompt

QUOTE_CARD = """Find one piece of evidence for the label below in the passage and return it as a JSON object.

Label: {label}
Definition: {definition}

Return the fields source_quote, claim, edos_alignment, secondary_edos_labels and retrieval_keywords.
source_quote is copied word for word from the passage, {least} to {most} characters long if possible.
claim says one thing only, which the quote supports; edos_alignment says why it serves this label and no other.
Do not answer anybody, keep drafts and thoughts to yourself, and return nothing if the passage has no such evidence.

Source: {source}

Passage:
{text}"""

ARGUMENT_CARD = """Write one evidence card against the kind of hate named below, from the passage alone.

Label: {label}
Definition: {definition}

Return a JSON object of two texts and nothing else:
reasoning: two to four sentences on how the passage bears on the idea behind the label;
argument: one argument of its own against that idea, factual, specific to the label, without insult.
Invent no facts, figures, laws or sources, and show no drafts.

Source: {source}
Chunk: {chunk_id}

Passage:
{text}"""

COUNTER_RULES = """You write short answers to hate against women, in {language}, of at most {sentences} sentences.
Use the card as the ground and add no facts. Do not insult, do not claim experience of your own, do not repeat the hateful idea.
Answer the idea itself, and never speak of being a machine or a model.
{cite}
Return a JSON object with counter_narrative, used_claim and grounding_note, and nothing before or after it."""

COUNTER = """Message:
{message}

Label: {label}
Strategy: {strategy}

Card {card_id}, from {source}
Passage: {chunk}
Reasoning: {reasoning}
Argument: {argument}
Alignment: {alignment}
Keywords: {keywords}

Write one answer to the message."""


def quote_card(label: Column, definition: Column, source: Column, text: Column, least: int = 20, most: int = 280) -> Column:
    return prompt(QUOTE_CARD, label=label, definition=definition, source=F.to_json(source), text=text, least=F.lit(least), most=F.lit(most))


def argument_card(label: Column, definition: Column, source: Column, chunk_id: Column, text: Column) -> Column:
    return prompt(ARGUMENT_CARD, label=label, definition=definition, source=F.to_json(source), chunk_id=chunk_id, text=text)


def counter(message: Column, source: Column, language: str = "English", sentences: int = 2, cite: bool = False, strategy: str | None = None) -> Column:
    """Rules and task for a row of card columns; ``source`` is the source's one line."""
    said = "You may name the source." if cite else "Name the source only if needed."
    rules = prompt(COUNTER_RULES, language=F.lit(language), sentences=F.lit(sentences), cite=F.lit(said))
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    task = prompt(COUNTER, message=message, label=F.col("primary_label"), strategy=F.lit(strategy or "not given"), card_id=F.col("card_id"), source=source, chunk=either("chunk", "source_quote"), reasoning=F.col("reasoning"), argument=either("argument", "claim"), alignment=F.col("edos_alignment"), keywords=F.array_join("keywords", ", "))
    return F.concat(rules, F.lit("\n\n"), task)
