"""Huffman token files: code, blocks, files."""

import zlib
from itertools import count

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import token_files as T
from granary.llm.common import new_path

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = T.WordEncoder(PATH, most=50)
ODD = st.lists(st.sampled_from([*"abSsTt.,!?' \n\t\r09éÉßΣσςİı́̈\x1c\x85\xa0日|#$<>", "<|endoftext|>", "<|ENDofTEXT|>", "<|startoftext|>"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD, min_size=1, max_size=5))
def test_words_equal_the_library(texts):
    ids, edges = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_are_one_id():
    ids, _ = ENCODER.encode(pa.array(["hello <|endoftext|> world", None, "x<|startoftext|>Y"], pa.string()))
    assert ids.tolist()[:3] == [3306, 49407, 1002] and 49406 in ids.tolist()


@settings(max_examples=100, deadline=None)
@given(counts=st.lists(st.integers(1, 10**6), min_size=2, max_size=60), bits=st.integers(6, 16))
def test_code_lengths(counts, bits):
    lengths = T.code_lengths(np.array(counts), bits)
    assert lengths.max() <= bits and sum(2.0 ** -int(x) for x in lengths) == 1.0
    heap, cost = sorted(counts), 0  # without a limit the total is Huffman's
    while len(heap) > 1:
        a, b = heap.pop(0), heap.pop(0)
        cost += a + b
        heap = sorted([*heap, a + b])
    total = int((np.array(counts) * lengths).sum())
    assert total >= cost and (bits < 16 or total == cost or max(lengths) == 16)


def test_limit_is_checked():
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(5), 2)


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(0, 900), spread=st.floats(1.05, 3))
def test_block_round_trip(seed, n, spread):
    ids = np.minimum(np.random.default_rng(seed).zipf(spread, n), 299).astype(np.uint16)
    counts = np.bincount(ids, minlength=300)
    bits = np.zeros(300, np.uint8)
    seen = np.flatnonzero(counts)
    bits[seen] = T.code_lengths(counts[seen], 12)
    payload, checkpoints = T.encode_block(ids, T.canonical_codes(bits), bits)
    table = T.decode_table(bits)
    assert T.decode_block(payload, checkpoints, n, table).tolist() == ids.tolist()
    assert len(payload) == (int(bits[ids].sum()) + 7) // 8
    for k in range(len(checkpoints) // 8):  # every checkpoint is a place to start
        part = T.decode_block(payload, checkpoints[8 * k :], min(T.CHECKPOINT, n - k * T.CHECKPOINT), table)
        assert part.tolist() == ids[k * T.CHECKPOINT : (k + 1) * T.CHECKPOINT].tolist()


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_files(spark, block):
    rows = [(5, "The cat, the Cat."), (1, None), (None, "no id"), (3, ""), (2, "word " * 300), (3, "again"), (7, "émile Σας")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", pytest.importorskip("pyspark.sql.functions").lit(9))
    path = new_path(spark, "test-files")
    T.write_token_files(docs, path, PATH, 49408, 2, block_ids=block)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in T.read_token_files(spark, path).collect()))
    want, start = [], count()
    at = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        next(start)
    assert got == want


def test_no_documents(spark):
    path = new_path(spark, "test-files")
    T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 49408, 2)
    assert T.read_token_files(spark, path).count() == 0
