"""Very long texts give what one piece would give."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from granary.llm import common, decontaminate, kneser_ney, language_mix, simhash, token_files


@pytest.fixture(scope="module")
def text():
    rng = random.Random(3)
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(4000)) + "\n" + "x" * 300


def test_cuts(text):
    for t in (text, text.encode(), "", "nospaceatall" * 50):
        parts = list(common.cut_at_spaces(t, 100))
        assert t[:0].join(parts) == t
        assert all(len(p) < 500 for p in parts[:-1])


def test_pieces_change_nothing(text, monkeypatch):
    whole = simhash.fingerprint(text), decontaminate.normalise(text), np.sort(kneser_ney.grams_of(text.encode()))
    cut = common.cut_at_spaces
    for module in (simhash, decontaminate, language_mix):
        monkeypatch.setattr(module, "cut_at_spaces", lambda t: cut(t, 97))
    monkeypatch.setattr(kneser_ney, "LONG", 89)
    assert simhash.fingerprint(text) == whole[0] and decontaminate.normalise(text) == whole[1]
    runs = list(kneser_ney.gram_runs([(0, text.encode()), (1, b""), (2, b"ab")]))
    assert np.array_equal(np.sort(np.concatenate([g for g, _, n in runs])), np.sort(np.concatenate([whole[2], kneser_ney.grams_of(b"ab")])))
    assert sum(len(g) for g, _, _ in runs) == len(text.encode()) + 2
    assert np.array_equal(language_mix.bucket_counts(text), np.bincount(language_mix.letter_grams([text])[0], minlength=language_mix.BUCKETS))


def test_tokens_of_a_long_text(text, monkeypatch):
    monkeypatch.setattr(token_files, "LONG", 100)
    cut = common.cut_at_spaces
    monkeypatch.setattr(token_files, "cut_at_spaces", lambda t: cut(t, 700))
    path = P.path("word_bpe_49k.json")
    ids, edges = token_files.WordEncoder(path).encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids and edges.tolist() == [0, len(ids)]
