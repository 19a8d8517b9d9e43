"""Byte-level BPE against the tokenizer library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(alphabet=st.sampled_from(list("ab  \n\t'stre19é日!.́")), max_size=120)


def chunked(text, size, overlap):
    n = max(1, -(-(len(text) - overlap) // size))
    out = []
    for k in range(n):
        part = text[k * size : (k + 1) * size + overlap]
        chain = byte_bpe.boundaries(part, P.PATTERN)
        out.append((part, [b for b in chain if b < overlap], [b for b in chain if b >= size]))
    return out


@settings(max_examples=400, deadline=None)
@given(text=TEXTS, size=st.integers(5, 30), overlap=st.integers(4, 12))
def test_stitched_pieces_are_whole_pre_tokens(text, size, overlap):
    pieces = byte_bpe.stitch(chunked(text, size, overlap), size, P.PATTERN)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in byte_bpe.encode_piece(p, PATH, P.PATTERN)] == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("gap", ["\n\n", "\n\n\n", "  ", " \t ", "\r\n\r\n", "\x1c\n", "12", "'s"])
@pytest.mark.parametrize("shift", range(-6, 7))
def test_gaps_at_a_cut_of_default_size(gap, shift):
    for place in (16384, 16896):
        text = ("lorem ipsum " * 1500)[: place + shift] + gap + "Next paragraph " * 100
        pieces = byte_bpe.stitch(chunked(text, 16384, 512), 16384, P.PATTERN)
        assert len(pieces) == 2 and [i for p in pieces for i in byte_bpe.encode_piece(p, PATH, P.PATTERN)] == LIBRARY.encode_ordinary(text)


def test_random_texts_with_blank_lines():
    pick = random.Random(7)
    for _ in range(2000):
        text = "".join(pick.choices(["ab", "c", " ", "  ", "\n", "\n\n", "\t", "1", "22", ".", "'s", "é"], k=pick.randint(1, 60)))
        size, overlap = pick.randint(6, 25), pick.randint(4, 12)
        pieces = byte_bpe.stitch(chunked(text, size, overlap), size, P.PATTERN)
        assert [i for p in pieces for i in byte_bpe.encode_piece(p, PATH, P.PATTERN)] == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(min_size=1, max_size=30))
def test_own_merges_equal_the_library(text):
    own = byte_bpe.regex.findall(P.PATTERN, text)
    assert [i for m in own for i in byte_bpe.merge_piece(m.encode(), RANKS)] == LIBRARY.encode_ordinary(text)


def test_tables(spark):
    random.seed(5)
    long = " ".join("".join(random.choices("abcdeé", k=random.randint(1, 9))) for _ in range(3000))
    run = "x" * 3000 + " " * 2500 + "end"
    rows = [(1, None, 0), (2, "", 0), (3, "The cat's hat\n\n sat", 0), (4, long, 1), (4, long, 1), (5, run, 2), (None, long[::-1], 3), (6, "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # a column named as one of the results
    got = byte_bpe.encode(docs, PATH, P.PATTERN, chunk_chars=1000, overlap_chars=50)
    told = byte_bpe.decode(got, PATH, keep=("n_tokens",)).collect()
    ids = {(r["doc_id"], r["n_tokens"], hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in got.collect()}
    want = set()
    for doc, text, _ in rows:
        tokens = LIBRARY.encode_ordinary(text or "")
        want.add((doc, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest()))
    assert ids == want and got.count() == len(rows)
    assert sorted(bytes(r["decoded"]) for r in told) == sorted((t or "").encode() for _, t, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH).count() == 0


@pytest.mark.parametrize("text", ["", " ", "'", "a" * 50000])
def test_single_texts(text):
    assert byte_bpe.encode_piece(text, PATH, P.PATTERN) == LIBRARY.encode_ordinary(text)
