"""Registered queries against libraries and brute force on whole small tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from granary.llm import byte_bpe, chat_windows, language_mix, registry, token_rollups
from granary.llm.common import new_path, read_table
from tests.llm.test_duplicates import brute_vectors, union

DATA = "/root/testdata/sf0.001"


def test_byte_bpe_query(spark):
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for r in read_table(spark, DATA, "documents").collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.op2_byte_bpe(spark, DATA).collect()} == want


def test_token_files_query(spark):
    library, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, {}
    for r in sorted(read_table(spark, DATA, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.op4_token_files(spark, DATA).collect()} == want


def test_vectors_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((150, 64)), 4, axis=0) + 0.12 * rng.standard_normal((600, 64))
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = brute_vectors(x.astype(np.float32).astype(np.float64), 0.95)
    roots, degree = union(600, list(zip(*np.nonzero(near)))), near.sum(axis=1) - 1
    got = {r["vec_id"]: r for r in registry.op6_itq_dedup(spark, str(tmp_path)).collect()}
    told = np.array([got[i]["n_links"] for i in range(600)])
    assert degree.sum() > 1000 and (told <= degree).all() and told.sum() >= 0.9 * degree.sum()
    assert np.mean([got[i]["component_id"] == roots[i] for i in range(600)]) > 0.95
    plain = read_table(spark, DATA, "embeddings").collect()
    v = np.array([r["embedding"] for r in plain], np.float64)
    links = dict(zip([r["vec_id"] for r in plain], (brute_vectors(v, 0.95).sum(axis=1) - 1).tolist()))
    assert {r["vec_id"]: r["n_links"] for r in registry.op6_itq_dedup(spark, DATA).collect()} == links


def plain_buckets(text):
    s, found, mask = f" {text.lower()} ", Counter(), (1 << 64) - 1
    for size in (1, 2, 3):
        for i in range(len(s) - size + 1):
            part = s[i : i + size]
            if not any(c.isalpha() for c in part) or size == 3 and not part[1].isalpha():
                continue
            h = 0
            for c in part:
                h = (h * 0x100000001B3 + (ord(c) if c.isalpha() else 1)) & mask
            found[((h + size) * 0x9E3779B97F4A7C15 & mask) >> 48] += 1
    return found


def plain_mixture(found, logs, langs):
    """Expectation-maximisation over all languages; the smallest goes while that raises the penalised likelihood."""
    total = sum(found.values())

    def fit(kept):
        share = {x: 1 / len(kept) for x in kept}
        like = {b: {x: math.exp(logs[x].get(b, logs[x][None])) for x in kept} for b in found}
        for _ in range(12):
            new = dict.fromkeys(kept, 0.0)
            for b, n in found.items():
                mixed = sum(share[x] * like[b][x] for x in kept)
                for x in kept:
                    new[x] += n * share[x] * like[b][x] / mixed
            share = {x: v / total for x, v in new.items()}
        return share, sum(n * math.log(sum(share[x] * like[b][x] for x in kept)) for b, n in found.items())

    kept = list(langs)
    share, value = fit(kept)
    while len(kept) > 1:
        rest = [x for x in kept if x != min(kept, key=lambda y: share[y])]
        less, lower = fit(rest)
        if lower + 0.5 * math.log(total) < value:
            break
        kept, share, value = rest, less, lower
    return share


def test_language_against_plain_mixtures(spark):
    """The whole query on the smallest table, every text by plain loops."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in read_table(spark, DATA, "documents").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = {}
    for i, text, lang in docs:
        if lang is not None and text is not None and not held(i):
            counts.setdefault(lang, Counter()).update(plain_buckets(text))
    logs = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.5 * language_mix.BUCKETS
        logs[lang] = {b: math.log((n + 0.5) / total) for b, n in own.items()} | {None: math.log(0.5 / total)}
    got = {r["doc_id"]: r for r in registry.op3_language(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs[:60]:
        share = plain_mixture(plain_buckets(text or ""), logs, sorted(logs)) if plain_buckets(text or "") else {"und": 0.0}
        best = max(sorted(share), key=lambda x: share[x])
        assert got[i]["held_out"] == held(i) and got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(share[best], abs=1e-3), i


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")


def test_rollups_are_compacted(spark):
    rollup = token_rollups.Rollup(spark, new_path(spark, "test-rollup"))
    first, second = changes(spark, [("insert", "s", "en", "v1", 10, None)]), changes(spark, [("insert", "s", "en", "v1", 5, None), ("delete", "s", "en", "v1", None, 10)])
    rollup.apply("1", first)
    rollup.compact()
    assert rollup.committed() == ["1"] and not rollup.apply("1", first)
    assert rollup.apply("2", second)
    for _ in range(2):
        assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(1, 5)]
        rollup.compact()
    assert rollup.committed() == ["1", "2"] and not rollup.apply("2", second)


@pytest.mark.parametrize("op", ["upsert", None])
def test_unknown_operations_are_refused(spark, op):
    rollup = token_rollups.Rollup(spark, new_path(spark, "test-rollup"))
    with pytest.raises(Exception, match="unknown operation"):
        rollup.apply("1", changes(spark, [(op, "s", "en", "v1", 1, None)]))
    assert rollup.committed() == [] and rollup.totals().count() == 0


def test_counts_of_long_texts_and_clashing_columns(spark):
    path, text = P.path("byte_bpe_50k.tiktoken"), "lorem ipsum " * 200_000
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").selectExpr("*", "1 AS _text2", "2 AS n")
    got = {r["doc_id"]: r["n_tokens"] for r in token_rollups.with_counts(docs, path, P.PATTERN).collect()}
    assert got == {1: len(byte_bpe.load_encoding(path, P.PATTERN).encode_ordinary(text)), 2: 0}
    for clash in ("n", "doc_id"):
        with pytest.raises(ValueError):
            token_rollups.with_counts(docs, path, P.PATTERN, clash)
    with pytest.raises(ValueError):
        byte_bpe.decode(docs.withColumnRenamed("n", "decoded"), path, keep=("decoded",))
    with pytest.raises(ValueError):
        language_mix.predict(docs.withColumnRenamed("n", "score"), (["en"], np.zeros((language_mix.BUCKETS, 1), np.float32)), keep=("score",))


def test_windows_of_long_conversations_and_texts(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 5)) for i in range(3000)] + [(2, 0, "system", "s"), (2, 1, "user", "long " * 300_000), (2, 2, "assistant", "short")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_windows.digests(chat_windows.format_windows(turns)).collect()}
    for conv in (1, 2):
        own = [(r, t) for c, _, r, t in rows if c == conv]
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_chars"] == sum(len(t) for r, t in own if r == "assistant")
