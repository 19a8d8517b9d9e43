"""Hard negatives per anchor and positive, by a full sort of integer scores.

Anchors and rows are dealt into blocks by hash; every pair of an anchor block
and a row block is one group, so no task holds more than one block of each and
what a group makes does not grow with the table.  Inside a group all scores of
an anchor are computed and lexsorted by (score descending, id).  The first pass
keeps each anchor's best rows of its label (the positives); the second finds
each positive's upper limit in the sorted scores of the other labels by binary
search and reads at most k rows from there down to its lower limit.  The parts
that the blocks give are merged per anchor, and per anchor and positive: a
block's first k hold whatever of it is among the first k of all.

Scores are exact: components are integers, scores are computed as doubles where
all sums stay below 2^53 and as Python integers where they may not.  Components
beyond 64 bits count as the nearest 64-bit integer; scores are ordered by 38
digits and told as the nearest 64-bit integer.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part; wholly repeated rows count once; rows of one
id with other labels or vectors are rows of their own, told apart by ``row``
(a hash of label and vector) and sorted by it where score and id tie; vectors of
another dimension than the anchor's are no candidates for it; empty vectors
score zero; extra columns are ignored; an empty table, an anchor without
positives, and a positive without negatives give no rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, written

ANCHORS, ROWS = 1024, 16384
CHUNK = 1 << 20  # scores at once
LONG = (1 << 63) - 1
DIGITS = 10**38 - 1
EXACT = "decimal(38,0)"


def integer_rows(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """The rows that take part, once each: vec_id long, label long, vec array<long> (floor of ``scale`` times each component), dim, row."""
    label = F.col("label") if label is None else label
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    read = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    read = read.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite)
    whole = read.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("vec"))
    return whole.withColumn("dim", F.size("vec")).withColumn("row", F.xxhash64("label", "vec")).dropDuplicates(["vec_id", "label", "vec"])


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: int64, or Python integers where int64 could overflow."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (anchors, rows)]
    if most[0] * most[1] * max(1, anchors.shape[1]) < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    out = np.zeros((len(anchors), len(rows)), object)
    for a, b in zip(anchors.T.astype(object), rows.T.astype(object), strict=True):
        out += np.outer(a, b)
    return out


def ordered(values: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Places by (value descending, id, tie)."""
    if values.dtype == object:
        return np.array(sorted(range(len(values)), key=lambda i: (-values[i], ids[i], ties[i])), np.int64)
    return np.lexsort((ties, ids, -values))


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), dim)


def exact(score) -> Decimal:
    return Decimal(min(max(int(score), -DIGITS), DIGITS))


def told(score: str) -> Column:
    return F.least(F.lit(LONG), F.greatest(F.lit(-LONG - 1), F.col(score))).cast("long").alias(score)


def by_anchor(anchors: pd.DataFrame, rows: pd.DataFrame):
    """Each anchor of a group with its scores against all rows of the group."""
    dim = int(anchors["dim"].iloc[0])
    a, b = matrix(anchors["vec"], dim), matrix(rows["vec"], dim)
    step = max(1, CHUNK // max(1, len(b)))
    for start in range(0, len(a), step):
        yield from zip(anchors.iloc[start : start + step].itertuples(index=False), scores(a[start : start + step], b), strict=True)


def dealt(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Both sides copied to the groups they belong to: every anchor block meets every row block of its dimension."""
    own = F.xxhash64("vec_id", "row")
    a, b = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    left = anchors.withColumn("a", F.pmod(own, F.lit(a))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)).cast("array<long>")))
    right = rows.withColumn("b", F.pmod(own, F.lit(b))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1)).cast("array<long>")))
    return left.groupBy("dim", "a", "b"), right.groupBy("dim", "a", "b")


def mine(rows: DataFrame, is_anchor: Column, k: int = 5, n_positives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """``rows``: from ``integer_rows``.  A negative fits if lower * positive_score <= 100 * negative_score <= upper * positive_score.

    Returns anchor_id, positive_id, rank int, negative_id, positive_score,
    negative_score, and anchor_row, positive_row, negative_row.
    """
    rows = written(rows, "negatives-rows")
    anchors = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()

    def best_of_label(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            ids, ties, labels = (right[c].to_numpy() for c in ("vec_id", "row", "label"))
            for anchor, value in by_anchor(left, right):
                at = np.flatnonzero((labels == anchor.label) & ~((ids == anchor.vec_id) & (ties == anchor.row)))
                for i in at[ordered(value[at], ids[at], ties[at])[:n_positives]]:
                    out.append((anchor.vec_id, anchor.row, ids[i], ties[i], exact(value[i])))
        return pd.DataFrame(out, columns=["vec_id", "row", "positive_id", "positive_row", "positive_score"])

    left, right = dealt(rows, anchors, n_rows, n_anchors)
    found = left.cogroup(right).applyInPandas(best_of_label, f"vec_id long, row long, positive_id long, positive_row long, positive_score {EXACT}")
    order = Window.partitionBy("vec_id", "row").orderBy(F.col("positive_score").desc(), "positive_id", "positive_row")
    chosen = written(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_positives), "negatives-positives")
    positives = chosen.groupBy("vec_id", "row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_row", "positive_score"))).alias("positives"))  # at most n_positives
    asking = written(anchors.join(positives, ["vec_id", "row"]), "negatives-anchors")

    def near_below(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            ids, ties, labels = (right[c].to_numpy() for c in ("vec_id", "row", "label"))
            for anchor, value in by_anchor(left, right):
                at = np.flatnonzero(labels != anchor.label)
                at = at[ordered(value[at], ids[at], ties[at])]
                falling = -value[at]
                for p in anchor.positives:
                    score = int(p["positive_score"])
                    top, least = upper * score // 100, -(-lower * score // 100)  # the whole numbers that fit
                    first, stop = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -least, "right")
                    for i in at[first : max(first, min(stop, first + k))]:
                        out.append((anchor.vec_id, anchor.row, p["place"], p["positive_id"], p["positive_row"], p["positive_score"], ids[i], ties[i], exact(value[i])))
        return pd.DataFrame(out, columns=["anchor_id", "anchor_row", "place", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"])

    left, right = dealt(rows, asking, n_rows, n_anchors)
    found = left.cogroup(right).applyInPandas(near_below, f"anchor_id long, anchor_row long, place int, positive_id long, positive_row long, positive_score {EXACT}, negative_id long, negative_row long, negative_score {EXACT}")
    order = Window.partitionBy("anchor_id", "anchor_row", "place").orderBy(F.col("negative_score").desc(), "negative_id", "negative_row")
    kept = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    result = written(kept.select("anchor_id", "positive_id", "rank", "negative_id", told("positive_score"), told("negative_score"), "anchor_row", "positive_row", "negative_row"), "negatives")
    for old in (chosen, asking, rows):
        discard(old)
    return result


#: The query in SQL, over the wanted columns.
NEGATIVES_SQL = """
WITH parts AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] * b.vec[i])) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
