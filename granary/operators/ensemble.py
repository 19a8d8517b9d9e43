"""Votes of several classifiers, their alignment, and annotation of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.vectors import argmax


def refuse(bad: DataFrame, message: str) -> None:
    """Raise if there is any such row."""
    if found := bad.limit(3).collect():
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def aligned(frames: dict[str, DataFrame], key: str, same: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """One row per key with a struct per frame; optionally every frame must have the keys, once, and agree on ``same``."""
    packed = [f.select(F.col(key), F.struct(*[c for c in f.columns if c != key]).alias(name)) for name, f in frames.items()]
    if check:
        every = reduce(lambda a, b: a.unionByName(b), [f.select(F.lit(n).alias("frame"), key) for n, f in frames.items()])
        counts = every.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("frame").alias("frames"))
        refuse(counts.filter((F.col("rows") != len(frames)) | (F.col("frames") != len(frames))), f"frames are not aligned on {key}")
    out = reduce(lambda a, b: a.join(b, key), packed)
    if check and same:
        first = next(iter(frames))
        differs = reduce(lambda a, b: a | b, [~F.col(f"{first}.{c}").eqNullSafe(F.col(f"{n}.{c}")) for n in frames for c in same])
        refuse(out.filter(differs).select(key), f"frames differ in {same}")
    return out


def vote(rows: DataFrame, voters: list[str], fallback: str) -> DataFrame:
    """Votes of the base models; a single leader wins, a tie goes to the fallback model.

    Every frame is a struct of pred_id and probs.  Adds pred_id, used_fallback,
    top_vote_count, confidence (mean base probability of the winner, or the
    fallback's probability of its own label), confidence_kind and vote_counts (a
    JSON object by label).
    """
    preds = F.array(*[F.col(f"{v}.pred_id") for v in voters])
    tally = F.array_sort(F.transform(F.array_distinct(F.col("_votes")), lambda p: F.struct((-F.size(F.filter(F.col("_votes"), lambda q: q == p))).alias("n"), p.alias("label"))))
    out = rows.withColumn("_votes", preds).withColumn("_tally", tally)
    top = F.col("_tally")[0]
    leaders = F.size(F.filter("_tally", lambda t: t["n"] == F.col("_tally")[0]["n"]))
    out = out.withColumn("used_fallback", leaders > 1).withColumn("top_vote_count", (-top["n"]).cast("long"))
    out = out.withColumn("pred_id", F.when(F.col("used_fallback"), F.col(f"{fallback}.pred_id")).otherwise(top["label"]))
    mean = sum((F.col(f"{v}.probs")[F.col("pred_id")] for v in voters[1:]), F.col(f"{voters[0]}.probs")[F.col("pred_id")]) / len(voters)
    confidence = F.when(F.col("used_fallback"), F.col(f"{fallback}.probs")[F.col("pred_id")]).otherwise(mean)
    kind = F.when(F.col("used_fallback"), "fallback_probability").otherwise("mean_base_probability")
    counts = F.array_sort(F.transform("_tally", lambda t: F.struct(t["label"].alias("label"), (-t["n"]).alias("n"))))
    return out.withColumn("confidence", confidence).withColumn("confidence_kind", kind).withColumn("vote_counts", F.to_json(F.map_from_entries(counts))).drop("_votes", "_tally")


def vote_generic(rows: DataFrame, voters: list[str], fallback: str) -> DataFrame:
    """Like ``vote`` for frames of label and confidence: the confidence is the largest of all base models."""
    labels = F.array(*[F.col(f"{v}.label") for v in voters])
    counts = F.transform(labels, lambda p: F.size(F.filter(labels, lambda q: q == p)))
    best = F.array_max(counts)
    leaders = F.array_distinct(F.filter(labels, lambda p: F.size(F.filter(labels, lambda q: q == p)) == best))
    tied = F.size(leaders) != 1
    confidence = F.array_max(F.array(*[F.col(f"{v}.confidence") for v in voters]))
    return rows.withColumns(
        {
            "used_fallback": tied,
            "label_pred": F.when(tied, F.col(f"{fallback}.label")).otherwise(leaders[0]),
            "confidence": F.when(tied, F.col(f"{fallback}.confidence")).otherwise(confidence),
            "fallback_pred": F.col(f"{fallback}.label"),
            "base_votes": F.to_json(labels),
        }
    )


def fallback_rate(voted: DataFrame) -> DataFrame:
    return voted.agg(F.count_if("used_fallback").alias("fallback_used_count"), F.avg(F.col("used_fallback").cast("double")).alias("fallback_used_rate"))


def prediction_frame(probs: DataFrame, labels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """row_id, instance_id, text and probs with the first most likely label, its probability (as confidence and softmax_max_value); wide probability columns on request."""
    out = probs.withColumn("pred_id", argmax("probs")).withColumn("confidence", F.array_max("probs")).withColumn("softmax_max_value", F.col("confidence"))
    out = out.join(F.broadcast(labels.select(F.col("label_id").alias("pred_id"), F.col("label").alias("label_pred"))), "pred_id")  # one row per label
    if names:
        out = out.select("*", *[F.col("probs")[i].alias(n) for i, n in enumerate(names)])
    return out


def annotate(corpus: DataFrame, predictions: DataFrame, task: str, key: str = "instance_id") -> DataFrame:
    """The corpus with a struct of the last prediction of each id; ids without one keep null."""
    by = Window.partitionBy(key).orderBy(F.col("ord").desc())
    last = predictions.withColumn("_n", F.row_number().over(by)).filter("_n = 1").select(key, F.struct("label_pred", "confidence", "used_fallback").alias(task))
    return corpus.join(last, key, "left")


def flat(annotated: DataFrame, *tasks: str) -> DataFrame:
    """The structs of ``annotate`` as columns task_field, for flat files."""
    fields = ("label_pred", "confidence", "used_fallback")
    return annotated.select(*[c for c in annotated.columns if c not in tasks], *[F.col(f"{t}.{f}").alias(f"{t}_{f}") for t in tasks for f in fields])


def exact_cover(corpus: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Inner join; the ids of both sides must be the same."""
    a, b = corpus.select(key).distinct().withColumn("_a", F.lit(1)), predictions.select(key).distinct().withColumn("_b", F.lit(1))
    refuse(a.join(b, key, "full").filter("_a IS NULL OR _b IS NULL").select(key), "ids do not cover each other")
    return corpus.join(predictions, key)


def cover_gaps(corpus: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    a, b = corpus.select(key).distinct().withColumn("_a", F.lit(1)), predictions.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "corpus").otherwise("predictions")
    return a.join(b, key, "full").filter("_a IS NULL OR _b IS NULL").select(key, side.alias("side"))


def best_epoch(metrics: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Per run the epoch of the greatest score, the first of equal ones."""
    best = F.struct(F.col(score), -F.col("epoch"))
    return metrics.groupBy("run").agg(F.max_by("epoch", best).alias("epoch"), F.max(score).alias(score))
