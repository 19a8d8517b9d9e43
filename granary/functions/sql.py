"""The text functions under SQL names: plain SQL expressions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

SPACE = r"(?U)[\\s\\x1c-\\x1f]+"
FLAT = f"trim(regexp_replace(coalesce({{x}}, ''), '{SPACE}', ' '))"
TOKENS = "transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-zÀ-ÿ0-9\\']+', 0), t -> lower(t))"


def flat(x: str) -> str:
    return FLAT.format(x=x)


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


FUNCTIONS = {
    "normalize_space(x STRING) RETURNS STRING": flat("x"),
    "word_tokens(x STRING) RETURNS ARRAY<STRING>": tokens("x"),
    "keyword_overlap(x STRING, terms ARRAY<STRING>) RETURNS DOUBLE": f"CASE WHEN size({tokens('array_join(terms, chr(32))')}) = 0 THEN 0D ELSE size(filter({tokens('array_join(terms, chr(32))')}, t -> array_contains({tokens('x')}, t))) / CAST(size({tokens('array_join(terms, chr(32))')}) AS DOUBLE) END",
    "quote_in_passage(q STRING, p STRING) RETURNS BOOLEAN": f"{flat('q')} <> '' AND {flat('p')} <> '' AND (contains(lower({flat('p')}), lower({flat('q')})) OR (size({tokens('q')}) >= 5 AND contains(array_join({tokens('p')}, ' '), array_join({tokens('q')}, ' '))))",
}

TABLE_FUNCTIONS = {
    "chunk_words(x STRING, width INT, overlap INT, least INT) RETURNS TABLE (start INT, chunk STRING)": f"""
      SELECT s.start, array_join(slice(s.words, s.start + 1, s.w), ' ')
      FROM (SELECT split({flat('x')}, ' ') AS words, width AS w, least AS l, explode(sequence(0, size(split({flat('x')}, ' ')) - 1, greatest(1, width - overlap))) AS start WHERE {flat('x')} <> '') s
      WHERE size(slice(s.words, s.start + 1, s.w)) >= s.l""",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, body in {**FUNCTIONS, **TABLE_FUNCTIONS}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in (*FUNCTIONS, *TABLE_FUNCTIONS)]
