"""Text expressions: Column in, Column out, no Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[A-Za-zÀ-ÿ0-9']+"
TERM = r"(?U)\w{2,}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_default(x: Column | str, default: str | Column = "") -> Column:
    """Empty text counts as missing."""
    return F.coalesce(F.nullif(col(x), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def normalize_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), SPACE, " "))


def tokens(x: Column | str) -> Column:
    """Words are found first and lower-cased then, so case never joins or splits them."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(WORD), F.lit(0)), lambda t: F.lower(t))


def terms(x: Column | str) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(TERM), F.lit(0))


def grams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def split_words(x: Column | str) -> Column:
    flat = normalize_space(x)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(x: Column | str) -> Column:
    return F.size(split_words(x)).cast("long")


def keyword_overlap(text: Column | str, phrases: Column | Iterable[str]) -> Column:
    """Share of the phrases' words, counted as often as they occur, that the text holds."""
    joined = F.lit(" ".join(phrases)) if not isinstance(phrases, Column) else F.array_join(phrases, " ")
    return overlap(tokens(joined), tokens(text))


def overlap(wanted: Column, held: Column) -> Column:
    """Share of the wanted words, counted as often as they occur, that are held."""
    hits = F.size(F.filter(wanted, lambda t: F.array_contains(held, t)))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(hits.cast("double") / F.size(wanted))


def quote_in_passage(quote: Column | str, passage: Column | str) -> Column:
    """The quote stands in the passage, up to white space and case; from five words on, up to punctuation too."""
    q, p = F.lower(normalize_space(quote)), F.lower(normalize_space(passage))
    q_words, p_words = tokens(q), tokens(p)
    soft = (F.size(q_words) >= 5) & F.contains(F.array_join(p_words, " "), F.array_join(q_words, " "))
    return (q != "") & (p != "") & (F.contains(p, q) | soft)


def source_id(stem: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(col(stem)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def year_of(stem: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(stem), r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")


def title_of(title: Column | str, stem: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(col(title)), F.lit("")), F.translate(col(stem), "_-", "  "))


def slug(x: Column | str, default: str = "item") -> Column:
    return or_default(F.regexp_replace(F.regexp_replace(col(x), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""), default)


def card_id(model: Column, source: Column, label: Column, chunk_id: Column) -> Column:
    """MODEL_SOURCE_LABELCODE_CHUNKTAIL in upper case."""
    code = F.replace(F.element_at(F.split(label, " "), 1), F.lit("."), F.lit("_"))
    return F.upper(F.concat_ws("_", slug(model), slug(source), code, F.element_at(F.split(chunk_id, "_"), -1)))


def chunk_id(source: Column | str, number: Column | str) -> Column:
    return F.format_string("%s_CHUNK_%04d", col(source), col(number).cast("int"))


def keyword_set(words: Column | str) -> Column:
    """Trimmed, lower-cased, without blanks, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(col(words), F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")))


def generated_keywords(label: Column | str, argument: Column | str, most: int = 10) -> Column:
    """The label, its words of three or more characters and the argument's of five or more, in order of first use."""
    own = F.filter(tokens(label), lambda t: F.length(t) >= 3)
    more = F.filter(tokens(argument), lambda t: F.length(t) >= 5)
    return F.slice(F.array_distinct(F.concat(F.array(col(label)), own, more)), 1, most)


def card_text(argument: Column, reasoning: Column, alignment: Column, chunk: Column, primary: Column, secondary: Column, keywords: Column, section: Column, title: Column) -> Column:
    parts = [argument, reasoning, alignment, chunk, primary, F.array_join(secondary, " "), F.array_join(keywords, " "), section, title]
    return normalize_space(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def source_line(title: Column, publisher: Column, year: Column, page: Column, url: Column, file_name: Column) -> Column:
    """One line; the address, or else the local file."""
    place = F.coalesce(F.nullif(url, F.lit("")), F.nullif(file_name, F.lit("")))
    return F.concat_ws(" | ", F.nullif(title, F.lit("")), F.nullif(publisher, F.lit("")), year.cast("string"), F.concat(F.lit("p. "), page.cast("string")), place)


def source_block(**fields: Column) -> Column:
    """A line for each field that has a value."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.nullif(v.cast("string"), F.lit(""))) for k, v in fields.items()])


def join_list(values: Column | str, separator: str = " | ") -> Column:
    return F.array_join(F.coalesce(col(values), F.array().cast("array<string>")), separator)


def split_list(text: Column | str, separator: str = "|") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), f"\\Q{separator}\\E"), lambda v: F.trim(v)), lambda v: v != "")


def definition_of(alignment: Column | str) -> Column:
    """What follows the definition's mark, or else the whole text."""
    found = F.regexp_extract(col(alignment), r"(?is)EDOS definition:\s*(.+?)\s*$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), col(alignment))


def with_prompt(x: Column | str, prompt: str = "") -> Column:
    """What an embedding model is given: queries take a prompt before the text, documents none."""
    return F.concat(F.lit(prompt), F.coalesce(col(x), F.lit("")))


def strip_control(x: Column | str) -> Column:
    return F.regexp_replace(col(x), CONTROL, "")


def html_escape(x: Column | str) -> Column:
    out = col(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_text(html: Column | str) -> Column:
    """Visible text: scripts, styles, navigation and footers go with what they hold, then all tags."""
    out = F.coalesce(col(html), F.lit(""))
    for name in ("script", "style", "nav", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for safe, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return normalize_space(out)


def safe_column(name: str) -> str:
    for bad in " ./":
        name = name.replace(bad, "_")
    return name.replace("&", "and")


def label_text(x: Column | str) -> Column:
    return F.replace(F.trim(col(x)), F.lit("\n"), F.lit(" "))


def display(x: Column, kind: str) -> Column:
    """A value as one line of text, by its type."""
    if kind.startswith("array"):
        return F.array_join(x.cast("array<string>"), "; ")
    if kind.startswith(("struct", "map")):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))
