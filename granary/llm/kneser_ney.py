"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Counts come from all trusted texts, per language: partial counts in each task,
then sums by (language, gram), a column for the model of each fold.  Lower orders count distinct left neighbours,
discounts D1, D2, D3+ come from counts of counts, and every order is joined to
its context totals and to the next lower order, all as joins sharded by gram.

Scoring takes the model in shards of at most ``shard_entries`` entries: whole
models (a fold's of a language) while they fit, else ranges of the byte before the predicted one
(grams, their suffixes and their contexts fall into one shard).  A document
passes only the shards of its model, its partial sums are added up, and no
text is shuffled.  Shards are sent one after another: a pass writes its sums, then its
shard is taken from the driver and the executors, so neither holds more than one.

Documents are dealt into folds by a hash of their text.  A document is scored by
the model of the other folds' trusted texts, and the models of all folds are made
together, so trusted documents did not help to train what scores them, and
other documents are scored just like them.  A document is rejected if the
distance of its log perplexity per byte from its language's median exceeds the
``quantile`` of that distance over the trusted documents, both in units of a
spread that falls with the length, as one over its root.

Defined cases: null text is empty; empty texts, and texts of a language without
trusted text in other folds, are kept without a threshold; null language is a language of its
own; repeated rows are scored alike; without trusted rows all is kept; very long
texts are counted and scored in runs; extra columns are not read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import LONG, discard, new_path, release, sliced, texts_of, written

ORDER = 5
NO_LANG = ""
BINS = 1000  # a quantile is exact to 1 / BINS of a nat, or of a unit of distance
FOLDS = 4


def grams_of(text: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The packed n-gram that ends at each byte from start to stop; a text begins after line ends."""
    stop = len(text) if stop is None else stop
    before = (b"\n" * (ORDER - 1) + text[max(0, start - ORDER + 1) : start])[1 - ORDER :]
    data = np.frombuffer(before + text[start:stop], np.uint8)
    out = np.zeros(stop - start, np.int64)
    for k in range(ORDER):
        out = (out << 8) | data[k : k + len(out)]
    return out


def gram_runs(texts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of texts in runs of bounded size: all grams, where each text's part begins, and the texts' numbers."""
    parts: list[np.ndarray] = []
    numbers: list[int] = []
    held = 0
    for number, text in texts:
        for start in range(0, len(text), LONG):
            part = grams_of(text, start, min(len(text), start + LONG))
            parts.append(part)
            numbers.append(number)
            held += len(part)
            if held >= LONG:
                yield np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])]), np.array(numbers)
                parts, numbers, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])]), np.array(numbers)


def others(folds: int) -> list[str]:
    """The columns of a fold's model: counts of the texts of all other folds."""
    return [f"c{f}" for f in range(folds)]


def counted(trusted: DataFrame, folds: int) -> DataFrame:
    """lang, g and, for the model of each fold, the gram's count in the trusted texts of the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max_bytes=4 << 20):
            groups = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            texts = texts_of(batch)
            for lang, fold in sorted(set(groups)):
                for grams, _, _ in gram_runs([(0, t.encode()) for t, x in zip(texts, groups, strict=True) if x == (lang, fold)]):
                    g, c = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array([fold] * len(g), pa.int32()), pa.array(g, pa.int64()), pa.array(c, pa.int64())], ["lang", "fold", "g", "c"])

    found = trusted.select("lang", "text", "fold").mapInArrow(count, "lang string, fold int, g long, c long")
    return found.groupBy("lang", "g").agg(*[F.sum(F.when(F.col("fold") != f, F.col("c")).otherwise(0)).alias(c) for f, c in enumerate(others(folds))])


def mask(k: int) -> int:
    return (1 << 8 * k) - 1


def discounts(level: DataFrame, counts: list[str]) -> DataFrame:
    """lang and, for each column of counts, an array of D1, D2 and D3; one row per language."""
    n = [F.count_if(F.col(c) == i).cast("double").alias(f"{c}n{i}") for c in counts for i in (1, 2, 3, 4)]

    def discount(c: str, i: int) -> Column:
        y = F.col(f"{c}n1") / F.greatest(F.lit(1.0), F.col(f"{c}n1") + 2 * F.col(f"{c}n2"))
        this, above = F.col(f"{c}n{i}"), F.col(f"{c}n{i + 1}")
        d = F.when(this > 0, i - (i + 1) * y * above / F.greatest(this, F.lit(1.0))).otherwise(F.lit(0.5 * i))
        return F.least(F.lit(float(i)), F.greatest(F.lit(0.1), d))

    return level.groupBy("lang").agg(*n).select("lang", *(F.array(*(discount(c, i) for i in (1, 2, 3))).alias(f"d{c}") for c in counts))


def fit(counts: DataFrame, folds: int) -> DataFrame:
    """The models of all folds in one table: lang, before, kind, g and a logarithm per fold, null where its model has none.

    ``kind`` k: p of a seen gram of k bytes; -k: the back-off weight of a context, under the order it serves.
    All folds share every join and shuffle, so jobs and plans do not grow with them.
    """
    spark, path = counts.sparkSession, new_path(counts.sparkSession, "kn-model")
    columns, values = others(folds), [f"v{f}" for f in range(folds)]
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy("lang", F.col("g").bitwiseAND(mask(k)).alias("g"))
        levels[k] = written(shorter.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]), "kn-level")
    schema = "lang string, before long, kind byte, g long, " + ", ".join(f"{v} float" for v in values)

    def add(table: DataFrame, k: int, kind: int, last: Column) -> None:
        before = F.lit(-1).cast("long") if k == 1 else last.bitwiseAND(255)  # the lowest order serves all
        logs = [F.log(v).cast("float").alias(v) for v in values]
        table.select("lang", before.alias("before"), F.lit(kind).cast("byte").alias("kind"), "g", *logs).write.mode("append").option("compression", "zstd").parquet(path)

    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        rates = written(discounts(levels[k], columns), "kn-rates")
        less = {c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(f"d{c}")[F.least(F.col(c), F.lit(3)).cast("int") - 1]) for c in columns}
        level = levels[k].withColumn("ctx", F.shiftright("g", 8))
        sums = [x for c, v in zip(columns, values, strict=True) for x in (F.sum(c).alias(f"t{c}"), F.when(F.sum(c) > 0, F.sum(less[c]) / F.sum(c)).alias(v))]
        context = written(level.join(F.broadcast(rates), "lang").groupBy("lang", "ctx").agg(*sums), "kn-contexts")
        seen = level.join(context.withColumnsRenamed({v: f"w{v}" for v in values}), ["lang", "ctx"])
        if lower is not None:
            below = lower.select("lang", F.col("g").alias("suffix"), *(F.col(v).alias(f"p{v}") for v in values))
            seen = seen.withColumn("suffix", F.col("g").bitwiseAND(mask(k - 1))).join(below, ["lang", "suffix"])
        part = [F.when(F.col(c) > 0, (F.col(c) - less[c]) / F.col(f"t{c}") + F.col(f"w{v}") * (F.lit(1 / 256) if lower is None else F.col(f"p{v}"))).alias(v) for c, v in zip(columns, values, strict=True)]
        probs = written(seen.join(F.broadcast(rates), "lang").select("lang", "g", *part), "kn-probs")
        add(probs, k, k, F.shiftright("g", 8))  # the byte before the predicted one is the last but one of a gram
        add(context.withColumnRenamed("ctx", "g"), k, -k, F.col("g"))  # and the last of a context
        for table in [rates, context, levels[k], *([lower] if lower is not None else [])]:
            discard(table)
        lower = probs
    discard(lower)
    model = spark.read.schema(schema).parquet(path)
    model._granary_path = path
    return model


class Shard:
    """Sorted arrays of one language for some values of the byte before."""

    def __init__(self, rows: pa.Table, before: set[int] | None):
        self.before = None if before is None else np.array(sorted(before), np.int64)
        self.probs, self.weights = {}, {}
        kind, g, value = (rows.column(c).to_numpy() for c in ("kind", "g", "value"))
        for k in range(1, ORDER + 1):
            for table, code in ((self.probs, k), (self.weights, -k)):
                at = np.flatnonzero(kind == code)
                at = at[np.argsort(g[at])]
                table[k] = (g[at], value[at])

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithms for distinct grams: of the longest seen gram, with the weights of longer contexts."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        for k in range(ORDER, 0, -1):
            at = np.flatnonzero(open_)
            g = grams[at] & mask(k)
            hit, value = look_up(self.probs[k], g)
            out[at[hit]] += value[hit]
            open_[at[hit]] = False
            at, g = at[~hit], g[~hit]
            hit, value = look_up(self.weights[k], g >> 8)
            out[at] += np.where(hit, value, 0.0)
        out[open_] += np.log(1 / 256)
        return out


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, values = table
    if not len(held):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return held[at] == keys, values[at]


Key = tuple[int, str]  # a fold and a language: one model


def passes(model: DataFrame, folds: int, shard_entries: int) -> list[dict[Key, set[int] | None]]:
    """What each scoring pass holds: models, whole (None) or for some values of the byte before."""
    sizes: dict[Key, dict[int, int]] = {}
    for r in model.groupBy("lang", "before").agg(*[F.count(f"v{f}").alias(f"n{f}") for f in range(folds)]).collect():  # at most 257 rows per language
        for f in range(folds):
            if r[f"n{f}"]:
                sizes.setdefault((f, r["lang"]), {})[r["before"]] = r[f"n{f}"]
    plan: list[dict[Key, set[int] | None]] = []
    free = 0
    for key in sorted(sizes):
        total = sum(sizes[key].values())
        if total <= shard_entries:
            if total > free or not plan:
                plan.append({})
                free = shard_entries
            plan[-1][key] = None
            free -= total
            continue
        base, room = sizes[key].get(-1, 0), 0
        for byte in range(256):  # every byte has a shard, for grams that were never seen
            n = sizes[key].get(byte, 0)
            if n > room or byte == 0:
                plan.append({key: set()})
                room = shard_entries - base
            plan[-1][key].add(byte)
            room -= n
        free = 0
    return plan


def of_models(held: dict[Key, set[int] | None]) -> Column:
    """Whether a document's model is among ``held``."""
    rule = F.lit(False)
    for fold in sorted({f for f, _ in held}):
        rule = rule | (F.col("fold") == fold) & F.col("lang").isin([lang for f, lang in held if f == fold])
    return rule


def shards_of(model: DataFrame, held: dict[Key, set[int] | None]) -> dict[Key, Shard]:
    """The shards of one pass: at most shard_entries and one range in all, 14 bytes each."""
    shards = {}
    for fold in sorted({f for f, _ in held}):
        langs = [lang for f, lang in held if f == fold]
        rule = F.col("lang").isin(langs) & F.col(f"v{fold}").isNotNull()
        if (before := held[fold, langs[0]]) is not None:  # then it is the only model of the pass
            rule = rule & ((F.col("before") == -1) | F.col("before").isin(sorted(before)))
        place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
        rows = model.filter(rule).select(place.alias("place"), "kind", "g", F.col(f"v{fold}").alias("value")).toArrow()
        for i, lang in enumerate(langs, 1):
            shards[fold, lang] = Shard(rows if len(langs) == 1 else rows.filter(pc.equal(rows.column("place"), i)), before)
        del rows
    return shards


def score(docs: DataFrame, model: DataFrame, folds: int, shard_entries: int = 4_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """id, lang, digest, n_bytes, log_prob per row of ``docs`` (id, lang, text, fold), and the tables it reads; log_prob is null where the language has no model."""
    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, lang string, digest long, n_bytes long, log_prob double"
    plan = passes(model, folds, shard_entries)
    whole, split = [], []
    for held in plan:
        sent = spark.sparkContext.broadcast(shards_of(model, held))
        release()

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, max_bytes=2 << 20):
                texts = [t.encode() for t in texts_of(batch)]
                keys = list(zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True))
                total = np.zeros(len(texts))
                for key in set(keys):
                    mine = [i for i, x in enumerate(keys) if x == key and texts[i]]
                    if not mine:
                        continue
                    shard = sent.value[key]
                    for grams, starts, rows in gram_runs([(i, texts[i]) for i in mine]):
                        codes, distinct = pd.factorize(grams)
                        values = shard.log_probs(distinct)
                        if shard.before is not None:
                            values[~np.isin((distinct >> 8) & 255, shard.before)] = 0.0
                        np.add.at(total, rows, np.add.reduceat(values[codes], starts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([len(t) for t in texts], pa.int64()), pa.array(total)], ["id", "lang", "digest", "n_bytes", "log_prob"])

        part = docs.filter(of_models(held)).select("id", "lang", "text", F.xxhash64("text").alias("digest"), "fold").mapInArrow(run, schema)
        part = written(part, "kn-part")
        sent.destroy()  # nothing reads it again: the pass is written
        (whole if all(b is None for b in held.values()) else split).append(part)
    without = docs.filter(~of_models({key: None for held in plan for key in held}))
    found = without.select("id", "lang", F.xxhash64("text").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("log_prob"))
    for part in whole:
        found = found.unionByName(part)
    if split:
        parts = split[0]
        for p in split[1:]:
            parts = parts.unionByName(p)
        # the shards of a document add up; repeated rows come back as one row each
        summed = parts.groupBy("id", "lang", "digest", "n_bytes").agg(F.sum("log_prob").alias("log_prob"), F.count(F.lit(1)).alias("n"))
        n_shards = Counter(key for held in plan for key in held)
        times = F.create_map(*[F.lit(x) for (fold, lang), n in n_shards.items() for x in (f"{fold} {lang}", n)])
        copies = (F.col("n") / times[F.concat(fold_of(F.col("digest"), folds).cast("string"), F.lit(" "), "lang")]).cast("long")
        summed = summed.withColumn("copies", copies).withColumn("log_prob", F.col("log_prob") / F.col("copies")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        found = found.unionByName(summed.select("id", "lang", "digest", "n_bytes", "log_prob"))
    return found, [*whole, *split]


def fold_of(digest: Column, folds: int) -> Column:
    return F.pmod(digest, F.lit(folds)).cast("int")


def quantiles(values: DataFrame, share: float, name: str) -> DataFrame:
    """``values``: lang, x.  lang and ``name``: of n values in order the one at ceil((n + 1) * share), or the last, from counts by bin."""
    bins = values.groupBy("lang", F.floor(F.col("x") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    bins = bins.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    place = F.least(F.col("all"), F.ceil((F.col("all") + 1) * share))
    return bins.groupBy("lang").agg(((F.min(F.when(F.col("below") >= place, F.col("bin"))) + 1) / BINS).alias(name))


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """lang, median, distance: the bound of n bytes is median + distance / sqrt(n); one row per language."""
    trusted = scored.filter("trusted AND n_bytes > 0 AND log_ppl IS NOT NULL")
    middle = quantiles(trusted.select("lang", F.col("log_ppl").alias("x")), 0.5, "median")
    units = trusted.join(F.broadcast(middle), "lang").select("lang", ((F.col("log_ppl") - F.col("median")) * F.sqrt("n_bytes")).alias("x"))
    return middle.join(quantiles(units, quantile, "distance"), "lang")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.985, folds: int = FOLDS, shard_entries: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, lang, digest, n_bytes, log_ppl, threshold, trusted, kept.

    ``trusted_ids``: one column of ids whose texts train the models and set the thresholds.
    """
    ids = trusted_ids.toDF("id").filter("id IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fold", fold_of(F.xxhash64("text"), folds))
    # a shuffle join at every size: labels grow with the corpus
    counts = written(counted(rows.join(ids.hint("merge"), "id", "left_semi"), folds), "kn-counts")
    model = fit(counts, folds)  # takes the counts away
    found, parts = score(rows, model, folds, shard_entries)
    discard(model)
    scored = found.withColumn("log_ppl", -F.col("log_prob") / F.greatest(F.lit(1), F.col("n_bytes")))
    judged = written(scored.join(ids.withColumn("trusted", F.lit(True)), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))), "kn-scores")
    for table in parts:
        discard(table)
    told = judged.join(F.broadcast(thresholds(judged, quantile)), "lang", "left")
    bound = F.when(F.col("n_bytes") > 0, F.col("median") + F.col("distance") / F.sqrt("n_bytes"))
    told = told.withColumn("threshold", bound).drop("median", "distance")
    return told.withColumn("kept", ~F.coalesce(F.col("log_ppl") > F.col("threshold"), F.lit(False)))
