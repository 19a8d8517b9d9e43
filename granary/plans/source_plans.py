"""Queries over readers and writers: tables written in each format to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import checks, review, splits
from granary.operators.layout import drop_folder
import granary.plans.text_plans  # noqa: F401  its SQL is used here
from granary.plans.base import CARDS_SQL, ORACLE, TAXONOMY, TAXONOMY_SQL, TERMS, TERMS_SQL, cards, label_of, label_sql, query, table, taxonomy
from granary.sources import readers, sinks
from granary.sources.paths import new_path, resolved
from granary.streaming.library import FollowedFiles

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@query("SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read strictly."""
    path = new_path(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "documents"), path)
    return readers.jsonl(spark, path, DOC, strict=True).select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@query("SELECT count(*) AS n, 0::BIGINT AS n_missing, 2::BIGINT AS n_appended FROM documents")
def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing file has no rows; appending adds to what is there."""
    path = new_path(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "documents").select("doc_id"), path)
    sinks.jsonl(spark.createDataFrame([(-1,), (-2,)], "doc_id long"), path, append=True)
    rows, missing = readers.jsonl(spark, path, "doc_id long"), readers.jsonl(spark, path + "-none", "doc_id long")
    counts = rows.agg(F.count_if(F.col("doc_id") >= 0).alias("n"), F.count_if(F.col("doc_id") < 0).alias("n_appended"))
    return counts.crossJoin(missing.agg(F.count(F.lit(1)).alias("n_missing")))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord FROM documents")
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row over all files."""
    path = new_path(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id"), path)
    return readers.in_order(spark.read.schema("doc_id long").json(path)).select("doc_id", "ord")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jsonl_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded lines (here 25), one of them blank."""
    content = "\n\n".join(table(spark, sf_dir, "nation").toJSON().collect())
    return readers.jsonl_from_text(spark, content, "n_nationkey int, n_name string, n_regionkey int")


@query(f"WITH {TERMS_SQL} SELECT label, 'definition of ' || label AS definition, terms FROM term_sets")
def yaml_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label profiles of a configuration file, each of which must have a definition."""
    path = new_path(spark, "profiles")
    sinks.put_text(spark, path, "labels:\n" + "".join(f"  {k}:\n    definition: definition of {k}\n    search_terms: {json.dumps(v)}\n" for k, v in TERMS.items()))
    labels = readers.yaml_config(spark, path)["labels"]
    found = spark.createDataFrame([(k, v["definition"], " ".join(v["search_terms"])) for k, v in labels.items()], "label string, definition string, terms string")
    checks.check_profiles(found, spark.createDataFrame([(k,) for k in TERMS], "label string"))
    return found


@query("SELECT r_regionkey, r_name FROM region")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pretty JSON document and back."""
    path = new_path(spark, "report")
    sinks.json_report(table(spark, sf_dir, "region"), path)
    return readers.json_document(spark, path, "r_regionkey int, r_name string")


def _object(rows: DataFrame, key: str, **fields: str) -> str:
    """The rows of a small fixed table as the text of an object by key, with a value that is no object."""
    found = {str(r[key]): {name: r[c] for name, c in fields.items()} for r in rows.orderBy(key).collect()}
    return json.dumps({"version": 1, **found})


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_nationkey::VARCHAR AS instance_id, n_name AS text FROM nation")
def keyed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of objects (25 here), numbered in file order; blank texts would raise."""
    path = new_path(spark, "corpus")
    sinks.put_text(spark, path, _object(table(spark, sf_dir, "nation"), "n_nationkey", HATE_SPEECH="n_name"))
    return readers.strict_corpus(spark, path)


@query("SELECT n_nationkey::VARCHAR AS instance_id, n_name AS name FROM nation")
def keyed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    sinks.put_text(spark, path, _object(table(spark, sf_dir, "nation"), "n_nationkey", name="n_name"))
    return readers.keyed_json(spark, path, "name string")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE n_nationkey::VARCHAR END AS instance_id, n_name AS name FROM nation")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of objects; every second has an id, the others take their place."""
    path = new_path(spark, "list")
    found = [({"id": f"n{r['n_nationkey']}"} if r["n_nationkey"] % 2 == 0 else {}) | {"name": r["n_name"]} for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    sinks.put_text(spark, path, json.dumps(found))
    return readers.json_list(spark, path, "name string")


@query("SELECT (2 * row_number() OVER (PARTITION BY doc_id // 300 ORDER BY doc_id) - 2)::VARCHAR AS instance_id, doc_id, md5(text) AS text_md5 FROM documents")
def jsonl_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without id, in several files, take the physical line of their file, blank lines counted."""
    path = new_path(spark, "lines")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 300).alias("part"), "doc_id", F.concat(F.to_json(F.struct("doc_id", "text")), F.lit("\n")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return readers.jsonl_by_line(spark, path, "doc_id long, text string").select("instance_id", "doc_id", F.md5("text").alias("text_md5"))


@query("SELECT n_nationkey::VARCHAR AS instance_id, n_name AS text, '' AS target, '' AS version FROM nation")
def csv_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet without ids: the place of the row; absent optional columns are empty."""
    path = new_path(spark, "sheet")
    sinks.csv(table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("text")), path)
    return readers.csv_with_ids(spark, path, optional=("target", "version"))


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, lang FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line ends in a sheet."""
    path = new_path(spark, "sheet")
    sinks.csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return readers.csv(spark, path, "doc_id", "text", keep_empty=True).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("""SELECT 'card_' || doc_id AS card_id, quality::VARCHAR AS quality, CASE WHEN toxic = 1 THEN 'yes' ELSE '' END AS noted, row_number() OVER (ORDER BY 'card_' || doc_id) AS place FROM labels""")
def annotation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet that is written, then merged with rows that have a column more; sorted by id."""
    path, marks = new_path(spark, "sheet"), table(spark, sf_dir, "labels")
    first = marks.select(F.concat(F.lit("card_"), "doc_id").alias("card_id"), F.col("quality").cast("string").alias("quality"))
    sinks.upsert_csv(spark, path, first.withColumn("quality", F.when(F.col("quality") == "0", "old").otherwise(F.col("quality"))), ["card_id"])
    later = marks.filter("quality = 0 OR toxic = 1").select(F.concat(F.lit("card_"), "doc_id").alias("card_id"), F.col("quality").cast("string").alias("quality"), F.when(F.col("toxic") == 1, "yes").otherwise("").alias("noted"))
    sinks.upsert_csv(spark, path, later, ["card_id"])
    sheet = readers.in_order(spark.read.option("header", True).csv(path).na.fill(""))
    return sheet.select("card_id", "quality", "noted", F.col("ord").alias("place"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'two' END AS model, row_number() OVER (ORDER BY doc_id % 2, doc_id) AS card_order, count(*) OVER () AS n_cards FROM documents""")
def card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card files of two models: ids must be there and unique over both, the order runs through both."""
    paths, found = {m: new_path(spark, f"cards-{m}") for m in ("one", "two")}, cards(spark, sf_dir)
    for rest, path in enumerate(paths.values()):
        sinks.jsonl(found.filter(F.pmod("doc_id", F.lit(2)) == rest).orderBy("doc_id").select("card_id", "status", "source", "source_quote"), path)
    rows = readers.cards(spark, paths)
    return rows.select(F.substring("card_id", 6, 20).cast("long").alias("doc_id"), "model", "card_order", "n_cards")


@query(f"WITH {CARDS_SQL}, k AS (SELECT card_id, row_number() OVER (ORDER BY ord DESC) AS n FROM cards) SELECT card_id, CASE WHEN n % 3 > 0 THEN n END AS card_order, row_number() OVER (ORDER BY CASE WHEN n % 3 > 0 THEN n ELSE 1e9 END, card_id) AS place FROM k")
def annotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the order of the card, those without one last by id."""
    from granary.operators.layout import running

    rows = running(cards(spark, sf_dir).select("card_id", (-F.col("ord")).alias("_o"), F.lit(1).alias("_one")), [], ["_o"], "_one")
    n = F.col("before") + 1
    return review.in_card_order(rows.select("card_id", F.when(F.pmod(n, F.lit(3)) > 0, n).cast("long").alias("card_order")))


@query("SELECT 'card_7' AS card_id, 'a claim' AS claim, 2001 AS year")
def single_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of one card in a list."""
    path = new_path(spark, "card")
    sinks.put_text(spark, path, json.dumps([{"card_id": "card_7", "claim": "a claim", "source": {"year": 2001}}]))
    return readers.single_card(spark, path).select("card_id", "claim", "source.year")


@query("SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) AS first_value FROM embeddings")
def embedding_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written and read back at unit length; ids unique, one dimension, the same ids as the chunks."""
    path, rows = new_path(spark, "vectors"), table(spark, sf_dir, "embeddings")
    sinks.embedding_index(rows.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit("m").alias("model_name")), path)
    index = readers.embedding_index(spark, path)
    checks.check_index(rows.select(F.col("vec_id").cast("string").alias("chunk_id")), index)
    return index.select("chunk_id", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[0], 6).alias("first_value"))


@query("SELECT upper(r_name) AS stem_upper, upper(replace(r_name, ' ', '_')) AS source_id, sha256(r_name || ' text') AS sha256 FROM region")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder by name, with their fingerprints."""
    folder = new_path(spark, "files")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        sinks.put_text(spark, resolved(f"{r['r_name']}.TXT", folder), f"{r['r_name']} text")
    found = readers.files(spark, folder, "*.[tT][xX][tT]")
    first = found.head()
    if readers.fingerprint(spark, first["path"]) != first["sha256"]:
        raise ValueError("fingerprints differ")
    return found.select(F.upper("stem").alias("stem_upper"), "source_id", "sha256")


@query("SELECT 'there' AS what, true AS found, (SELECT count(*) FROM region) AS n_rows, 'r_other' AS missing UNION ALL SELECT 'none', false, NULL, 'a,b'")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ready")
    sinks.csv(table(spark, sf_dir, "region"), path)
    rows = readers.readiness(spark, {path: ("r_name", "r_other"), path + "-none": ("a", "b")})
    return rows.select(F.when(F.col("path") == path, "there").otherwise("none").alias("what"), "found", "n_rows", "missing")


@query(f"WITH {TAXONOMY_SQL} SELECT label, label_id::BIGINT AS label_id FROM taxonomy")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label2id and id2label, which must undo each other."""
    path = new_path(spark, "maps")
    sinks.label_maps(taxonomy(spark), path)
    maps = json.loads(readers.document(spark, path))
    if {v: int(k) for k, v in maps["id2label"].items()} != maps["label2id"]:
        raise ValueError("the maps differ")
    return spark.createDataFrame(list(maps["label2id"].items()), "label string, label_id long")


@query("SELECT doc_id, 'a' || lang AS note, (SELECT count(*) FROM documents) AS total FROM documents")
def annotation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables replaced at once, without control characters; what stood there before goes."""
    path, docs = new_path(spark, "tables"), table(spark, sf_dir, "documents")
    for mark in ("\x00old", "a\x07"):
        sinks.annotation_tables(docs.select("doc_id", F.concat(F.lit(mark), "lang").alias("note")), docs.agg(F.count(F.lit(1)).alias("total")), path)
    return spark.read.parquet(f"{path}/annotations").crossJoin(spark.read.parquet(f"{path}/summary"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 10 = 0")
def test_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows of the positive class, whose number is checked."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", "text", F.when(F.pmod("doc_id", F.lit(10)) == 0, "test").otherwise("train").alias("split"), F.when(F.col("quality") == 1, "sexist").otherwise("no").alias("label_sexist"))
    expected = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id", "left_semi").filter("quality = 1 AND doc_id % 10 = 0").count()
    return splits.test_slice(rows, expected).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {TAXONOMY_SQL} SELECT md5(text) AS text_md5, parent AS label, row_number() OVER (ORDER BY item_id) AS ord FROM benchmark JOIN taxonomy ON label = {label_sql('item_id')}")
def augmentation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up rows of a sheet in file order with the parents of their labels."""
    path = new_path(spark, "augmentation")
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.col("text").alias("generated_text"), F.concat(F.lit(" "), label_of(F.col("item_id"))).alias("label_vector"))
    sinks.csv(rows, path)
    return readers.augmentation(spark, path, taxonomy(spark), "b").select(F.md5("text").alias("text_md5"), "label", "ord")


@query("SELECT n_name AS path, n_nationkey / 100.0 AS accuracy, n_regionkey / 10.0 AS macro_f1 FROM nation")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all runs whose file is there (25 here)."""
    folder = new_path(spark, "metrics")
    for r in table(spark, sf_dir, "nation").collect():
        sinks.put_text(spark, f"{folder}/run{r['n_nationkey']}/metrics.json", json.dumps({"accuracy": r["n_nationkey"] / 100, "macro_f1": r["n_regionkey"] / 10}))
    found = checks.metric_files(spark, f"{folder}/*/metrics.json").withColumn("n_nationkey", F.regexp_extract("path", r"run(\d+)/", 1).cast("int"))
    return found.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select(F.col("n_name").alias("path"), "accuracy", "macro_f1")


@query("""
SELECT doc_id, CASE WHEN part = 1 THEN 'new ' || lang ELSE lang END AS note FROM (SELECT doc_id, lang, doc_id % 4 AS part FROM documents) WHERE part <> 2
UNION ALL SELECT -doc_id - 1, 'added' FROM documents""")
def followed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of four files of which one is replaced, one goes and one comes; the others are not read again."""
    folder, docs = new_path(spark, "followed"), table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("note"))
    part = lambda k: docs.filter(F.pmod("doc_id", F.lit(4)) == k)
    for k in range(4):
        part(k).coalesce(1).write.json(f"{folder}/in/{k}")
    held = FollowedFiles(spark, f"{folder}/in", f"{folder}/store", lambda paths: spark.read.schema("doc_id long, note string").json(paths))
    first = held.sync()
    part(1).withColumn("note", F.concat(F.lit("new "), "note")).coalesce(1).write.mode("overwrite").json(f"{folder}/in/1")
    docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("added").alias("note")).coalesce(1).write.json(f"{folder}/in/4")
    drop_folder(spark, f"{folder}/in/2")
    second, third = held.sync(), held.sync()
    if (first["read"], second["read"], second["left"], third["read"]) != (4, 2, 2, 0):
        raise ValueError(f"files were read again: {first}, {second}, {third}")
    return held.rows()


@query(ORACLE["html_text"])
def tolerant_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages by a parser: on markup that is in order the same as by regular expressions, unfinished references included."""
    return table(spark, sf_dir, "pages").select("page_id", readers.parsed_html_closed("html").alias("text"))


LABEL_NAMES = {i: t[1] for i, t in enumerate(TAXONOMY)}


@query(f"WITH {TAXONOMY_SQL} SELECT label_id, label, 'own ' || label_id AS own FROM taxonomy")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place-holders of a model's configuration give way to the taxonomy; names of its own stay."""
    plain = checks.label_names({i: f"LABEL_{i}" for i in LABEL_NAMES}, list(LABEL_NAMES.values()))
    own = checks.label_names({i: f"own {i}" for i in LABEL_NAMES}, list(LABEL_NAMES.values()))
    return spark.createDataFrame([(i, plain[i], own[i]) for i in LABEL_NAMES], "label_id int, label string, own string")
