"""Which passages hold a quote, for all quotes and passages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import normalize_space, quote_in_passage, tokens
from granary.operators.layout import dealt, stored

ANCHOR = 3


def shingles(words: Column, n: int) -> Column:
    """Hashes of every n neighbours; ``words`` is a column or bound, for it stands in a lambda."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.transform(F.filter(starts, lambda i: i <= F.size(words) - n + 1), lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k - 1) for k in range(n)]))


def characters(text: Column) -> Column:
    return F.split(text, "(?s)(?!^)(?=.)")


def anchored(asked: DataFrame, held: DataFrame) -> DataFrame:
    """item_id, doc_id of all pairs in which the document holds the item's rarest run of neighbours.

    asked: item_id, seq, n (length of the runs, ``ANCHOR`` at most); held:
    doc_id, seq.  Every run of an item is looked for, so how many documents
    hold it is known, and only the rarest leads to pairs.
    """
    out = None
    for n in sorted(r["n"] for r in asked.select("n").distinct().collect()):  # ANCHOR rows at most
        wanted = stored(asked.filter(F.col("n") == n).select("item_id", F.explode(F.array_distinct(shingles(F.col("seq"), n))).alias("anchor")), "quote-anchors")
        bound = F.transform(F.array("seq"), lambda s: shingles(s, n))[0]
        runs = held.select("doc_id", F.explode(F.array_distinct(bound)).alias("anchor"))
        hits = stored(runs.join(wanted.select("anchor").distinct(), "anchor", "left_semi"), "quote-hits")
        df = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("df"))
        rarest = wanted.join(df, "anchor", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("best")).select("item_id", F.col("best.anchor").alias("anchor"))
        part = hits.join(rarest, "anchor").select("item_id", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


def quote_matches(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, doc_id of all pairs for which ``quote_in_passage`` holds.

    quotes: item_id, text; passages: doc_id, text.  The inner words of a quote
    stand in every passage that holds it, side by side, and so do the
    characters of a quote of fewer than three words; the rarest run of up to
    ``ANCHOR`` of them is joined with the passages' runs, and what meets is
    checked in full.
    """
    flat = F.lower(normalize_space("text"))
    asked = quotes.select("item_id", F.col("text").alias("quote"), flat.alias("_q"), tokens(flat).alias("_w")).filter("_q <> ''")
    texts = dealt(passages.select("doc_id", "text"))
    inner = asked.filter(F.size("_w") > 2).select("item_id", F.expr("slice(_w, 2, size(_w) - 2)").alias("seq")).withColumn("n", F.least(F.size("seq"), F.lit(ANCHOR)))
    short = asked.filter(F.size("_w") <= 2).select("item_id", characters(F.col("_q")).alias("seq")).withColumn("n", F.least(F.size("seq"), F.lit(ANCHOR)))
    found = [anchored(inner, texts.select("doc_id", tokens(flat).alias("seq"))), anchored(short, texts.select("doc_id", characters(flat).alias("seq")))]
    found = [f for f in found if f is not None]
    if not found:
        return asked.join(passages.select("doc_id"), F.lit(False)).select("item_id", "doc_id")
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    pairs = pairs.join(asked.select("item_id", "quote"), "item_id").join(passages.select("doc_id", "text"), "doc_id")
    return pairs.filter(quote_in_passage("quote", "text")).select("item_id", "doc_id")
