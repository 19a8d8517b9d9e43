"""A class-weighted multinomial logistic classifier, trained by a distributed loop.

Texts become unit vectors of hashed words once, in a stored table.  Each epoch sends
the model (classes times ``features`` numbers, whatever the corpus) to the
tasks; every task gives the sums of its gradient, and the sums over tasks come
back, as many numbers as the model has.  Held-out rows are judged in the same
pass, so every epoch has its loss and macro-F1, and the model of the best one is
kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.operators.arrays import flat, list_sizes, lists, slices, starts
from granary.operators.layout import dealt, discard, stored

SLICE = 1 << 18


def hashed_words(rows: DataFrame, features: int, *keep: str) -> DataFrame:
    """``keep`` and w (array of places): the hashed words of ``text``."""
    words = F.transform(tokens("text"), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))
    return dealt(rows).select(*keep, words.alias("w"))


def vectorised(rows: DataFrame, features: int, *keep: str) -> DataFrame:
    """``keep``, at (array of places) and x (array of values): unit vectors of the hashed words of ``text``."""
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c in keep), "at array<int>", "x array<double>"])
    names = [c for c in rows.columns if c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, list_sizes("w"), SLICE):
            at, x, owner = unit_vectors(batch)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists(bounds, at), lists(bounds, x)], [*names, "at", "x"])

    return hashed_words(rows, features, *names).mapInArrow(run, schema)


def unit_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and owners of the unit vectors of the words of a batch."""
    places, owner = flat(batch.column("w"))
    order = np.lexsort((places, owner))
    places, owner = places[order].astype(np.int32), owner[order]
    heads = starts(owner, places)
    n = np.diff(np.append(heads, len(places))).astype(float)
    owner = owner[heads]
    return places[heads], n / np.sqrt(np.bincount(owner, n * n, batch.num_rows))[owner], owner


def probabilities(model: np.ndarray, places: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Class probabilities of n rows, whose values are (owner, place, value).  The last column of the model is the bias."""
    scores = np.stack([np.bincount(owner, row[places] * values, n) for row in model], axis=1) + model[:, -1]
    scores -= scores.max(axis=1, keepdims=True)
    e = np.exp(scores)
    return e / e.sum(axis=1, keepdims=True)


def gradient(model: np.ndarray, labels: np.ndarray, weights: np.ndarray, at: list[np.ndarray], x: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Sums over the rows: of the gradient of the weighted log loss, and of the loss."""
    places, values = np.concatenate([*at, np.zeros(0, np.int32)]).astype(np.int64), np.concatenate([*x, np.zeros(0)])
    return flat_gradient(model, labels, weights, places, values, np.repeat(np.arange(len(at)), [len(a) for a in at]))


def flat_gradient(model: np.ndarray, labels: np.ndarray, weights: np.ndarray, places: np.ndarray, values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, float]:
    p = probabilities(model, places, values, owner, len(labels))
    loss = -float((weights * np.log(np.maximum(p[np.arange(len(p)), labels], 1e-300))).sum())
    p[np.arange(len(p)), labels] -= 1.0
    p *= weights[:, None]
    out = np.stack([np.bincount(places, p[owner, c] * values, model.shape[1]) for c in range(len(model))])
    out[:, -1] += p.sum(axis=0)
    return out, loss


@dataclass
class Trained:
    classes: list[str]
    model: np.ndarray
    epochs: list[dict]
    best: int


def epoch(vectors: DataFrame, model: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient and loss over the training rows, and the confusion counts [gold, predicted] of the held-out rows."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # classes times features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, seen = np.zeros(sent.value.shape), 0.0, np.zeros((len(sent.value), len(sent.value)), np.int64)
        for batch in slices(batches, list_sizes("at"), SLICE):
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for judged in (False, True):
                part = batch.filter(pa.array(held == judged))
                if not part.num_rows:
                    continue
                (places, owner), (values, _), y = flat(part.column("at")), flat(part.column("x")), part.column("y").to_numpy()
                if judged:
                    np.add.at(seen, (y, probabilities(sent.value, places, values, owner, len(y)).argmax(axis=1)), 1)
                else:
                    g, more = flat_gradient(sent.value, y, part.column("weight").to_numpy(), places, values, owner)
                    total += g
                    loss += more
        for kind, sums in (("g", total.reshape(-1)), ("seen", seen.reshape(-1).astype(float)), ("loss", np.array([loss]))):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(sums[at])], ["kind", "place", "value"])

    sums = vectors.select("y", "weight", "held", "at", "x").mapInArrow(run, "kind string, place long, value double").groupBy("kind", "place").agg(F.sum("value").alias("value")).toPandas()
    sent.destroy()
    out = {}
    for kind, size in (("g", model.size), ("seen", len(model) ** 2), ("loss", 1)):
        part = sums[sums["kind"] == kind]
        out[kind] = np.bincount(part["place"].to_numpy(np.int64), part["value"].to_numpy(float), size)
    return out["g"].reshape(model.shape), float(out["loss"][0]), out["seen"].reshape(len(model), len(model))


def macro_f1(seen: np.ndarray) -> float:
    """Over the classes that occur in gold or predictions."""
    hit, gold, told = np.diag(seen), seen.sum(axis=1), seen.sum(axis=0)
    used = gold + told > 0
    return float((2 * hit[used] / (gold + told)[used]).mean()) if used.any() else 0.0


def train(rows: DataFrame, held: Column, features: int = 1 << 13, epochs: int = 8, rate: float = 4.0, momentum: float = 0.9, label: str = "label") -> Trained:
    """rows: text and ``label``; ``held``: the rows that only judge.  Classes weigh alike, however many rows they have."""
    marked = rows.select("text", F.col(label).alias("label"), F.coalesce(held, F.lit(False)).alias("held")).filter("label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in marked.filter("NOT held").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    classes = sorted(counts)
    if not classes:
        raise ValueError("no rows to train on")
    known = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)])
    weights = F.element_at(F.array(*[F.lit(sum(counts.values()) / (len(classes) * counts[c])) for c in classes]), F.col("y") + 1)
    coded = marked.withColumn("y", known[F.col("label")]).filter("y IS NOT NULL").withColumn("weight", weights)
    vectors = stored(vectorised(coded, features, "y", "weight", "held"), "trainer-vectors")
    n = max(1, sum(counts.values()))
    model, speed, told, models = np.zeros((len(classes), features + 1)), 0.0, [], []
    for number in range(1, epochs + 1):
        g, loss, _ = epoch(vectors, model)
        speed = momentum * speed - rate * g / n
        model = model + speed
        _, _, seen = epoch(vectors.filter("held"), model)
        told.append({"epoch": number, "loss": loss / n, "macro_f1": macro_f1(seen), "accuracy": float(np.trace(seen) / max(1, seen.sum()))})
        models.append(model)
    discard(vectors)
    best = max(range(epochs), key=lambda i: (told[i]["macro_f1"], -i))
    return Trained(classes, models[best], told, best + 1)


def predict(trained: Trained, rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, label_pred and confidence of every row of ``rows`` (text and more)."""
    sent = rows.sparkSession.sparkContext.broadcast(trained.model)
    classes = trained.classes
    names = [c for c in rows.columns if c in keep]
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c in keep), "label_pred string", "confidence double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, list_sizes("w"), SLICE):
            p = probabilities(sent.value, *unit_vectors(batch), batch.num_rows)
            told = [pa.array([classes[i] for i in p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *told], [*names, "label_pred", "confidence"])

    return hashed_words(rows, trained.model.shape[1] - 1, *names).mapInArrow(run, schema)
