"""Language identification as inference of a multilingual mixture.

Likelihoods of letter n-grams (lengths 1 to 3, inside words with a boundary
mark, hashed to ``BUCKETS``) are learnt per language from all labelled training
texts with add-``SMOOTHING`` counts.  A document's grams are explained as a mixture of
languages; expectation-maximisation estimates the proportions.  The language set starts
with all languages and loses its smallest member while that raises the
penalised log-likelihood (half the logarithm of the gram count per language).
The prediction is the language of the largest proportion, its score that
proportion.

The learnt table has BUCKETS entries of four bytes per language (a quarter of a
MB); at most ``most_languages`` are allowed, 128 MB, so it may be sent to every
task.  The driver fetches its counts for a few languages at a time.

Defined cases: null text or text without a letter is ``und`` with score 0;
rows without a language do not train; ties go to the first language in
alphabetical order; an empty training table predicts ``und``; repeated rows are
predicted alike; very long texts are counted in pieces; extra columns are not
read, and kept ones must not be named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LONG, cut_at_spaces, discard, sliced, written

BUCKETS = 1 << 16
SMOOTHING = 0.5
UNKNOWN = "und"


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram that holds a letter, and where the grams of each text begin and end."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t.lower()) + 1 for t in texts])
    values, inverse = np.unique(codes, return_inverse=True)
    alpha = np.array([chr(v).isalpha() for v in values.tolist()], bool)[inverse]
    codes = np.where(alpha, codes, np.uint64(1))
    text = np.repeat(np.arange(len(texts)), sizes)
    n = len(codes)
    found, owner = [], []
    for size in (1, 2, 3):
        hashed = np.zeros(n - size + 1, np.uint64)
        letters = np.zeros(n - size + 1, np.int8)
        for k in range(size):
            hashed = hashed * np.uint64(0x100000001B3) + codes[k : n - size + 1 + k]
            letters += alpha[k : n - size + 1 + k]
        hashed = (hashed + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
        # a gram holds a letter, and a mark only at its ends
        inside = alpha[1 : n - 1] if size == 3 else np.ones(len(hashed), bool)
        at = np.flatnonzero((letters > 0) & inside)
        at = at[at < len(text)]
        found.append(hashed[at].astype(np.int64))
        owner.append(text[at])
    buckets, owner = np.concatenate(found), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return buckets[by], np.searchsorted(owner[by], np.arange(len(texts) + 1))


def learn(training: DataFrame, most_languages: int = 512) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and the log-likelihood of each bucket in each (BUCKETS x languages)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches, max_bytes=2 << 20):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [p for t, x in zip(texts, langs, strict=True) if x == lang for p in cut_at_spaces(t)]
                for k in range(0, len(own), 256):
                    totals[lang] = totals.get(lang, 0) + np.bincount(letter_grams(own[k : k + 256])[0], minlength=BUCKETS)
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["lang", "bucket", "n"])

    counted = training.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(count, "lang string, bucket int, n long")
    totals = written(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    langs = sorted(r["lang"] for r in totals.select("lang").distinct().limit(most_languages + 1).collect())
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    for k in range(0, len(langs), 16):
        own = langs[k : k + 16]
        rows = totals.filter(F.col("lang").isin(own)).toArrow()  # at most 16 times BUCKETS rows
        place = pc.index_in(rows.column("lang"), value_set=pa.array(own, pa.string())).to_numpy()
        counts = np.full((BUCKETS, len(own)), SMOOTHING)
        np.add.at(counts, (rows.column("bucket").to_numpy(), place), rows.column("n").to_numpy())
        table[:, k : k + 16] = np.log(counts / counts.sum(axis=0))
    discard(totals)
    return langs, table


def proportions(counts: np.ndarray, logs: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation, and the log-likelihood."""
    top = logs.max(axis=1)
    like = np.exp(logs - top[:, None])
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        mixed = like @ share
        share = share * ((counts / mixed) @ like) / counts.sum()
    return share, float(counts @ (np.log(like @ share) + top))


def bucket_counts(text: str) -> np.ndarray:
    """Counts of all buckets of one very long text."""
    return sum(np.bincount(letter_grams([p])[0], minlength=BUCKETS) for p in cut_at_spaces(text))


def infer(distinct: np.ndarray, counts: np.ndarray, table: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Proportions of all languages, zero outside the chosen set, from the distinct buckets and their counts."""
    counts = counts.astype(np.float64)
    logs = table[distinct].astype(np.float64)
    kept = np.arange(table.shape[1])
    share, value = proportions(counts, logs, rounds)
    penalty = 0.5 * np.log(counts.sum())
    while len(kept) > 1:
        rest = np.delete(np.arange(len(kept)), share.argmin())
        less, lower = proportions(counts, logs[:, kept[rest]], rounds) if len(rest) > 1 else (np.ones(1), float(counts @ logs[:, kept[rest[0]]]))
        if lower + penalty < value:
            break
        kept, share, value = kept[rest], less, lower
    out = np.zeros(table.shape[1])
    out[kept] = share
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns ``keep``, lang_pred, score, and mixture: map of language to proportion."""
    langs, table = model
    if clash := {id_col, *keep} & {"lang_pred", "score", "mixture"}:
        raise ValueError(f"the result has columns of its own named {sorted(clash)}")
    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = [f.name for f in rows.schema.fields[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max_bytes=2 << 20):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            long = len(texts) == 1 and len(texts[0]) > 2 * LONG
            buckets, edges = letter_grams([""] if long else texts)
            pred, score, mix = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if long:
                    every = bucket_counts(texts[0])
                    found, counts = np.flatnonzero(every), every[every > 0]
                else:
                    found, counts = np.unique(buckets[a:b], return_counts=True)
                if not len(found) or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    mix.append([])
                    continue
                share = infer(found, counts, sent.value)
                best = int(share.argmax())
                pred.append(langs[best])
                score.append(min(1.0, float(share[best])))
                mix.append([(langs[i], float(share[i])) for i in np.flatnonzero(share).tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "mixture"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, mixture map<string,double>")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
