"""Queries over texts: words, chunks, quotes, identifiers, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import nested, text
from granary.operators import cards as card_ops
from granary.operators import chunking, profile, quotes
from granary.operators import prompts as prompts_of
from granary.operators.word_index import TrigramIndex
from granary.plans.base import CARDS_SQL, TERMS, TERMS_SQL, cards, flat_sql, label_of, label_sql, query, table, term_sets, words_sql
from granary.sources.paths import new_path


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, length({flat_sql('text')})::BIGINT AS n_chars, md5({flat_sql('text')}) AS flat_md5 FROM documents")
def normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = text.normalize_space("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(flat).cast("long").alias("n_chars"), F.md5(flat).alias("flat_md5"))


@query(f"""
WITH w AS (SELECT doc_id, source, string_split({flat_sql('text')}, ' ') AS words FROM documents),
s AS (SELECT doc_id, source, words, unnest(range(0, len(words), 270)) AS start FROM w WHERE len(words) >= 40),
c AS (SELECT doc_id, source, start, words[start + 1 : start + 350] AS part FROM s)
SELECT doc_id, start::BIGINT AS start, len(part)::BIGINT AS n_words, md5(array_to_string(part, ' ')) AS chunk_md5,
  printf('%s_CHUNK_%04d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id, start)) AS chunk_id
FROM c WHERE len(part) >= 40""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return chunking.number_chunks(chunks, "source", "doc_id").select("doc_id", "start", "n_words", F.md5("chunk").alias("chunk_md5"), "chunk_id")


OVERLAP_SQL = """
WITH {terms}, d AS (SELECT *, {words} AS w FROM documents), t AS (SELECT label, {asked} AS q FROM term_sets),
s AS (SELECT d.doc_id, d.n_chars, t.label, len(list_filter(q, lambda x: list_contains(w, x))) / len(q)::DOUBLE AS score FROM d CROSS JOIN t),
r AS (SELECT *, max(score) OVER (PARTITION BY label) AS top FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r WHERE score > 0 OR top <= 0)
""".format(terms=TERMS_SQL, words=words_sql("text"), asked=words_sql("terms"))


@query(f"WITH {TERMS_SQL} SELECT doc_id, round(len(list_filter({words_sql('terms')}, lambda x: list_contains({words_sql('text')}, x))) / len({words_sql('terms')})::DOUBLE, 6) AS score FROM documents JOIN term_sets ON label = lang")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    phrases = F.create_map(*[x for k, v in TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return docs.filter(F.col("lang").isin(list(TERMS))).select("doc_id", F.round(text.keyword_overlap("text", phrases[F.col("lang")]), 6).alias("score"))


def passages(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("ord"), "text", "n_chars")
    return card_ops.select_passages(docs, term_sets(spark), most)


@query(OVERLAP_SQL + "SELECT label, doc_id AS passage_id, rank, round(score, 6) AS score FROM p WHERE rank <= 10")
def select_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir, 10).select("label", "passage_id", "rank", F.round("score", 6).alias("score"))


@query(OVERLAP_SQL + ", a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank) AS accepted_rank FROM p WHERE rank <= 50 AND n_chars >= 1000) SELECT label, doc_id AS passage_id, rank, accepted_rank FROM a WHERE accepted_rank <= 5")
def first_n_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.first_accepted(passages(spark, sf_dir, 50), F.col("n_chars") >= 1000, 5).select("label", "passage_id", "rank", "accepted_rank")


@query(OVERLAP_SQL + f"""
SELECT 'MOCK_' || p.label || printf('_%03d', rank) AS card_id, md5(array_to_string(string_split({flat_sql('d.text')}, ' ')[1:28], ' ')) AS quote_md5, p.label AS primary_label, '' AS keywords
FROM p JOIN documents d USING (doc_id) WHERE rank <= 5""")
def mock_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = card_ops.mock_cards(passages(spark, sf_dir, 5), F.lit("a definition"))
    return made.select("card_id", F.md5("source_quote").alias("quote_md5"), "primary_label", F.array_join("keywords", " ").alias("keywords"))


@query(f"""
WITH q AS (SELECT item_id, lower({flat_sql('text')}) AS q FROM benchmark), d AS (SELECT doc_id, lower({flat_sql('text')}) AS p FROM documents),
j AS (SELECT item_id, doc_id FROM q JOIN d ON q <> '' AND p <> '' AND (contains(p, q) OR (len({words_sql('q')}) >= 5 AND contains(array_to_string({words_sql('p')}, ' '), array_to_string({words_sql('q')}, ' ')))))
SELECT item_id, doc_id FROM j""")
def quote_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items are the stated query set, held against all documents."""
    return quotes.quote_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"SELECT c.doc_id, upper(regexp_replace(regexp_replace('Model 9b', '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || source_id || '_' || replace(split_part(primary_label, ' ', 1), '.', '_') || '_' || doc_id) AS made_id, regexp_replace(regexp_replace(title, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(regexp_replace(upper(url), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS source_key FROM (WITH {CARDS_SQL} SELECT * FROM cards) c")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.card_id(F.lit("Model 9b"), F.col("source.source_id"), F.col("primary_label"), F.concat(F.lit("chunk_"), F.col("doc_id")))
    return cards(spark, sf_dir).select("doc_id", made.alias("made_id"), text.slug("source.title").alias("slug"), text.source_id("source.url").alias("source_key"))


@query("SELECT page_id, try_cast(nullif(regexp_extract(url, '((?:19|20)\\d{2})', 1), '') AS INTEGER) AS year, replace(replace(url, '_', ' '), '-', ' ') AS title FROM pages")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.year_of("url").alias("year"), text.title_of(F.lit(" "), "url").alias("title"))


@query(f"WITH {CARDS_SQL} SELECT doc_id, concat_ws(' | ', title, year::VARCHAR, url) AS line, 'title: ' || title || chr(10) || 'year: ' || year || chr(10) || 'url: ' || url AS block FROM cards")
def source_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {c: F.col(f"source.{c}") for c in ("title", "publisher", "year", "page", "url", "file_name")}
    return cards(spark, sf_dir).select("doc_id", text.source_line(**s).alias("line"), text.source_block(title=s["title"], publisher=s["publisher"], year=s["year"], page=s["page"], url=s["url"]).alias("block"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.html_escape("text").alias("escaped"))


def _html_sql() -> str:
    x = "coalesce(html, '')"
    for name in ("script", "style", "nav", "footer"):
        x = f"regexp_replace({x}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for safe, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{safe}', '{raw}')"
    return flat_sql(x)


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("text"))


@query(f"""
WITH {CARDS_SQL}, t AS (SELECT doc_id, [primary_label] || list_filter({words_sql('primary_label')}, lambda x: length(x) >= 3) || list_filter({words_sql('source_quote')}, lambda x: length(x) >= 5) AS w FROM cards),
u AS (SELECT doc_id, w, list_distinct(w) AS d FROM t)
SELECT doc_id, array_to_string(list_sort(d, 'ASC')[1:0] || list_transform(list_sort(list_transform(d, lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x)[1:10], '|') AS keywords FROM u""")
def generated_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("doc_id", F.array_join(text.generated_keywords("primary_label", "source_quote"), "|").alias("keywords"))


@query(f"WITH {CARDS_SQL} SELECT doc_id, 'the ' || lang || ' one' AS definition, lower(lang) || ';' || source_id AS pair FROM cards")
def definition_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = text.split_list(F.concat_ws("|", F.concat(F.lit(" "), "lang"), F.lit(" "), "source.source_id"))
    return cards(spark, sf_dir).select("doc_id", text.definition_of("edos_alignment").alias("definition"), text.join_list(listed, ";").alias("pair"))


@query("SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE contains(lower(text), 'worthless') ORDER BY doc_id LIMIT 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents with the query in them."""
    from pyspark.sql import Window

    found = profile.search(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "text", "Worthless", 20, "doc_id")
    return found.select("doc_id", "lang", "source", F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("place"))


@query("SELECT doc_id, q FROM (SELECT doc_id, unnest(['worthless', 'the', 'e w']) AS q, text FROM documents) WHERE contains(lower(text), q) AND doc_id % 4 <> 1")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a string, by a stored index of runs of three characters, from which some documents have gone."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), TrigramIndex(spark, new_path(spark, "trigrams"))
    held.apply("all", docs)
    held.apply("gone", None, docs.filter(F.pmod("doc_id", F.lit(4)) == 1))
    found = [held.holding(docs, q).select("doc_id", F.lit(q.lower()).alias("q")) for q in ("Worthless", "the", "e w")]
    return found[0].unionByName(found[1]).unionByName(found[2])


CARD_RULES = {
    "type": "object",
    "required": ["id", "claim", "label"],
    "additionalProperties": False,
    "properties": {"id": {"type": "string"}, "claim": {"type": "string", "minLength": 10}, "label": {"type": "string", "enum": ["en", "de"]}, "year": {"type": ["integer", "null"]}, "source": {"type": "object", "required": ["source_id"], "properties": {"source_id": {"type": "string"}}}},
}


@query("""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN length(left_text) < 10 THEN '$.claim: minLength' END,
  CASE WHEN lang NOT IN ('en', 'de') THEN '$.label: enum' END,
  CASE WHEN doc_id % 5 = 0 THEN '$.year: type' END,
  CASE WHEN doc_id % 3 = 0 THEN '$.source: source_id is required' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM (SELECT doc_id, lang, lang || source AS left_text FROM documents)""")
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit('{"other": 1}')).otherwise(F.concat(F.lit('{"source_id": "'), "source", F.lit('"}')))
    year = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("2021.5")).otherwise(F.lit("2021.0"))
    made = F.concat(F.lit('{"id": "'), F.col("doc_id"), F.lit('", "claim": "'), "lang", "source", F.lit('", "label": "'), "lang", F.lit('", "year": '), year, F.lit(', "source": '), source, F.lit("}"))
    return docs.select("doc_id", F.array_join(nested.schema_errors(made, CARD_RULES), "; ").alias("errors"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::BIGINT AS n_keys FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects amid other text are found from their first brace to their last."""
    found = F.to_json(nested.json_object(F.concat(F.lit("Here it is: "), "props", F.lit(" done"))))
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("o"), F.json_object_keys(F.col("props")).alias("k"))
    return rows.select("event_id", F.element_at(F.map_values(F.from_json("o", "map<string,string>")), 1).alias("first_value"), F.size("k").cast("long").alias("n_keys"))


@query("SELECT conv_id, 'turn ' || turn AS label, role || ' it''s' AS said, NULL::VARCHAR AS nothing FROM conversations")
def literal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python literals as JSON."""
    literal = F.concat(F.lit("{'label': 'turn "), F.col("turn"), F.lit("', 'said': \""), "role", F.lit(" it's\", 'nothing': None}"))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", nested.literal_json(literal).alias("j"))
    return parsed.select("conv_id", *[F.get_json_object("j", f"$.{c}").alias(c) for c in ("label", "said", "nothing")])


@query(f"SELECT doc_id, 'Label: ' || {label_sql('doc_id')} || chr(10) || 'Source: ' || source || chr(10) || text AS prompt FROM documents")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = card_ops.prompt("Label: {label}\nSource: {source}\n{text}", label=label_of(F.col("doc_id")), source=F.col("source"), text=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("prompt"))


def template_sql(template: str, **fields: str) -> str:
    """The template with SQL expressions for its fields."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += ["'" + before.replace("'", "''") + "'", f"coalesce({fields[name]}, '')"]
    return " || ".join([*parts, "'" + rest.replace("'", "''") + "'"])


_SOURCE_SQL = """'{"source_id":"' || source_id || '"}'"""
_CARD_PROMPTS_SQL = {
    "quote": template_sql(prompts_of.QUOTE_CARD, label="primary_label", definition="'about ' || lang", source=_SOURCE_SQL, text="source_quote", least="'20'", most="'280'"),
    "argument": template_sql(prompts_of.ARGUMENT_CARD, label="primary_label", definition="'about ' || lang", source=_SOURCE_SQL, chunk_id="card_id", text="source_quote"),
    "counter": template_sql(prompts_of.COUNTER_RULES, language="'German'", sentences="'3'", cite="'You may name the source.'") + " || chr(10) || chr(10) || " + template_sql(prompts_of.COUNTER, message="'go away'", label="primary_label", strategy="'not given'", card_id="card_id", source="title", chunk="source_quote", reasoning="''", argument="claim", alignment="edos_alignment", keywords="' ' || upper(lang) || ', ' || source_id || ',  , ' || lang"),
}


@query(f"WITH {CARDS_SQL} SELECT doc_id, {', '.join(f'md5({sql}) AS {name}_md5' for name, sql in _CARD_PROMPTS_SQL.items())} FROM cards")
def card_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What models are asked for a quote, for an argument and for an answer, of every card."""
    null = F.lit(None).cast("string")
    rows = cards(spark, sf_dir).withColumns({"chunk": null, "reasoning": null, "argument": null})
    source, definition = F.struct("source.source_id"), F.concat(F.lit("about "), "lang")
    made = {
        "quote": prompts_of.quote_card(F.col("primary_label"), definition, source, F.col("source_quote")),
        "argument": prompts_of.argument_card(F.col("primary_label"), definition, source, F.col("card_id"), F.col("source_quote")),
        "counter": prompts_of.counter(F.lit("go away"), F.col("source.title"), "German", 3, True),
    }
    return rows.select("doc_id", *[F.md5(c).alias(f"{name}_md5") for name, c in made.items()])
