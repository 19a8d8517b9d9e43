"""Queries that profile a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import profile
from granary.plans.base import flat_sql, query, table


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "documents"), "source")


@query("SELECT lang AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM documents GROUP BY lang")
def distribution_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(table(spark, sf_dir, "documents"), "lang")


SIZES_SQL = f"SELECT lang, CASE WHEN {flat_sql('text')} = '' THEN 0 ELSE len(string_split({flat_sql('text')}, ' ')) END AS words, length(text) AS chars FROM documents"


@query(f"SELECT lang, count(*) AS n, round(avg(words), 1) AS words_mean, median(words)::DOUBLE AS words_median, min(words)::BIGINT AS words_min, max(words)::BIGINT AS words_max, round(avg(chars), 1) AS chars_mean, median(chars)::DOUBLE AS chars_median, min(chars)::BIGINT AS chars_min, max(chars)::BIGINT AS chars_max FROM ({SIZES_SQL}) GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_stats(table(spark, sf_dir, "documents"), "text", "lang")


@query("SELECT count(DISTINCT text) AS n_distinct, count(*) AS n, round(count(DISTINCT text) / count(*)::DOUBLE, 6) AS ratio FROM documents")
def distinct_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_ratio(table(spark, sf_dir, "documents"), "text").withColumn("ratio", F.round("ratio", 6))


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS a, CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS b, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT l_returnflag || '' AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def crosstab_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = profile.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return cells.filter("a <> 'All' AND b <> 'All'")


def _profile_sql(table_name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM {table_name}" for c, t in columns.items())


@query(_profile_sql("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}))
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.schema_profile(table(spark, sf_dir, "orders"))


@query("SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS duplicate_rows, (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicate_keys")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicates(table(spark, sf_dir, "documents").select("lang", "source", "text"), "text")


def _describe_sql(table_name: str, *columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS p50, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS p75, max({c})::DOUBLE AS max FROM {table_name}"
        for c in columns
    )


@query(_describe_sql("lineitem", "l_quantity", "l_extendedprice", "l_discount"))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.describe(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")
    return out.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations nested as lists of turns, then one row per turn again."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.col("role").alias("speaker"), "text").alias("t"))
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("data"))
    return profile.turns(nested, "conv_id", "data")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn_number, role AS speaker, length(coalesce(text, ''))::BIGINT AS text_length FROM conversations")
def turn_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn_number", "speaker", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("text_length"))


@query("SELECT role AS speaker, count(text) AS count, round(avg(length(text)), 1) AS mean, round(median(length(text)), 1)::DOUBLE AS median, max(length(text))::BIGINT AS max FROM conversations GROUP BY role")
def turn_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("text_length", F.char_length("text").cast("long"))
    return profile.group_stats(turns, ["speaker"], "text_length")


@query("SELECT (SELECT count(*) FROM documents) AS n_a, (SELECT count(*) FROM pages) AS n_b, round((SELECT count(*) FROM documents) / (SELECT count(*) FROM pages)::DOUBLE, 6) AS ratio")
def size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.size_ratio(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")).withColumn("ratio", F.round("ratio", 6))


@query("SELECT count(*) AS n_rows, 5::BIGINT AS n_columns FROM documents")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape(table(spark, sf_dir, "documents"))
