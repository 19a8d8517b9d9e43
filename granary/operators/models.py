"""Where external models plug in: embedding, classification, generation.

A model is built once per worker from a factory and then called with batches.
The stand-ins are deterministic and make no claim to quality.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nested import json_object_or

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]
CALLS = 64


def parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``most`` rows at a time, so that a worker holds the objects of a few rows however long a batch is."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def embed(rows: DataFrame, factory: Callable[[], Embed], text: str = "text", prompt: str = "", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding``; queries take a prompt before the text, documents none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in parts(batches, batch):
            vectors = model([prompt + (t or "") for t in part.column(text).to_pylist()])
            yield with_columns(part, embedding=pa.array(vectors, pa.list_(pa.float64())))

    return rows.mapInArrow(run, f"{schema}, embedding array<double>")


def classify(rows: DataFrame, factory: Callable[[], Embed], text: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with ``probs``, the softmax of the model's scores."""
    from granary.functions.vectors import softmax

    scored = embed(rows, factory, text, batch=batch)
    return scored.withColumn("probs", softmax("embedding")).drop("embedding")


def generate(rows: DataFrame, factory: Callable[[], Generate], prompt: str = "prompt", retries: int = 2, back_off: float = 1.0) -> DataFrame:
    """``rows`` with ``output`` and ``error``; a failing call is tried again after a growing pause, then noted."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in parts(batches, CALLS):
            outputs, errors = [], []
            for p in part.column(prompt).to_pylist():
                for attempt in range(retries + 1):
                    try:
                        outputs.append(model([p])[0])
                        errors.append(None)
                        break
                    except Exception as error:  # noqa: BLE001  whatever the model raises goes to the attempt log
                        if attempt == retries:
                            outputs.append(None)
                            errors.append(f"{type(error).__name__}: {error}")
                        else:
                            time.sleep(back_off * (attempt + 1))
            yield with_columns(part, output=pa.array(outputs, pa.string()), error=pa.array(errors, pa.string()))

    return rows.mapInArrow(run, f"{schema}, output string, error string")


def route(attempts: DataFrame, rejected: Column) -> DataFrame:
    """``status`` of each attempt: error, rejected or accepted."""
    return attempts.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.coalesce(rejected, F.lit(False)), "rejected").otherwise("accepted"))


def select_models(specs: list[dict], wanted: list[str] | None = None) -> list[dict]:
    """The enabled models, or those asked for; an unknown alias is an error."""
    by_alias = {s["alias"]: s for s in specs}
    if wanted:
        if unknown := [w for w in wanted if w not in by_alias]:
            raise ValueError(f"unknown models {unknown}")
        return [by_alias[w] for w in wanted]
    return [s for s in specs if s.get("enabled", True)]


# Fields of an answer, and the note beside one that is no JSON object.
ANSWER = ("counter_narrative", "used_claim", "grounding_note")
NO_JSON = "Model did not return valid JSON; raw text was stored."


def answer(output: Column) -> Column:
    """The trimmed texts of ``ANSWER``: of the JSON object that the output is or holds, else the output itself and a note."""
    raw = F.coalesce(output, F.lit(""))
    fallback = F.struct(F.trim(raw).alias(ANSWER[0]), F.lit("").alias(ANSWER[1]), F.lit(NO_JSON).alias(ANSWER[2]))
    found = F.array(json_object_or(raw, fallback, repair=False))  # the array binds the object, so it is parsed once
    strip = lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"^\s+|\s+$", "")
    return F.transform(found, lambda o: F.struct(*[strip(F.try_variant_get(o, f"$.{c}", "string")).alias(c) for c in ANSWER]))[0]


def generation_record(rows: DataFrame) -> DataFrame:
    """Nested record of input, card, generation, model and raw_model_output.

    rows: hate_speech, strategy, language, max_sentences, card_id,
    primary_label, reasoning, argument, claim, chunk, source_quote, source, model (a struct), output.
    """
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    card = F.struct("card_id", F.col("primary_label").alias("primary_edos_label"), "reasoning", either("argument", "claim").alias("argument"), either("chunk", "source_quote").alias("chunk"), "source")
    return rows.select(F.struct("hate_speech", "strategy", "language", "max_sentences").alias("input"), card.alias("card"), answer(F.col("output")).alias("generation"), "model", F.col("output").alias("raw_model_output"))


def hash_embedder(dim: int = 64) -> Callable[[], Embed]:
    """Stand-in: hashed bags of words."""

    def factory() -> Embed:
        def model(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * dim
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if h & 0x10000 else -1.0
                out.append(v)
            return out

        return model

    return factory


def echo_generator(fields: tuple[str, ...] = ("reasoning", "argument")) -> Callable[[], Generate]:
    """Stand-in: the prompt's last line in every field."""

    def factory() -> Generate:
        return lambda prompts: [json.dumps({f: p.strip().splitlines()[-1] if p.strip() else "" for f in fields}, ensure_ascii=False) for p in prompts]

    return factory


def http_generator(url: str, model: str, temperature: float = 0.0, timeout: float = 120.0, schema: dict | None = None, **options) -> Callable[[], Generate]:
    """A chat service over HTTP that answers in JSON, or by a JSON schema; ``generate`` tries again where a call fails."""

    def factory() -> Generate:
        import urllib.request

        def ask(prompt: str) -> str:
            body = {"model": model, "stream": False, "format": schema or "json", "messages": [{"role": "user", "content": prompt}], "options": {"temperature": temperature, **options}}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())["message"]["content"]

        return lambda prompts: [ask(p) for p in prompts]

    return factory


def generator(spec: dict) -> Callable[[], Generate]:
    """The model of a specification: an HTTP service where it names a url, else the stand-in."""
    if spec.get("url"):
        return http_generator(spec["url"], spec.get("model_id", spec["alias"]), spec.get("temperature", 0.0), spec.get("timeout", 120.0), spec.get("schema"))
    return echo_generator(tuple(spec.get("fields", ("reasoning", "argument"))))


def linear_classifier(train: DataFrame, text: str = "text", label: str = "label_id", weight: str | None = None, features: int = 1 << 14):
    """A weighted logistic regression over hashed words, the built-in stand-in for a trained classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer

    steps = [Tokenizer(inputCol=text, outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="features")]
    extra = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[*steps, LogisticRegression(labelCol=label, featuresCol="features", maxIter=20, **extra)]).fit(train)
