"""BPE encoding by an index from each pair to all its positions in a partition, and decoding.

The distinct pre-tokens of a slice of a partition lie one after another in one
array of symbols.  An index maps the rank of each pair to all positions where
the pair stands; ranks are taken in ascending order, each is applied to all its
positions from left to right, and what a merge newly puts side by side is
added to the lists of the ranks concerned.  A list may name positions that an
earlier merge has used up; they are seen from their symbols and passed over.
This equals merging word by word, as long as a merge never makes a pair of a
lower rank; tables for which that does not hold are refused.

Words are told apart by ASCII white space, which pre-tokens never cross; each
distinct word is normalised and cut into pre-tokens once and remembered up to a
bound.  Strings of added tokens are cut out first, as they stand.

Defined cases: null text is the empty text (no ids; decodes to the empty
text); repeated rows give one row each; very long texts are taken whole, a very
long word is one run of symbols; extra input columns are ignored unless kept by
name, and a kept column named like a result is refused; an empty table gives no
rows.  Ids without a token are left out in decoding.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import sliced
from granary.llm.token_files import WordEncoder

GONE, EDGE = -2, -1
SYMBOLS, WORDS = 4 << 20, 1 << 16


class Merges:
    """A BPE model's table: ids of single bytes inside and at the end of a word, and what each pair becomes."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or not model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-pair models with an end-of-word suffix are supported")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # how byte-level vocabularies write bytes
        others = [b for b in range(256) if b not in printable]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int32)
        self.bytes = {c: b for b, c in chars.items()}
        self.pairs: list[tuple[int, int, int]] = []
        self.ranks: dict[int, int] = {}
        made: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            if new in made or a not in made and a not in self.inner and a not in self.last or b not in made and b not in self.inner and b not in self.last:
                raise ValueError(f"merge {rank} makes a token twice, or before its parts")
            made[new] = rank
            self.pairs.append((a, b, new))
            self.ranks[a * self.size + b] = rank
        keys = np.array(list(self.ranks), np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array(list(self.ranks.values()), np.int32)[order]

    def initial(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """The index of all neighbouring pairs: rank to ascending positions."""
        codes = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
        codes[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        slots = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[slots] == codes).astype(np.int32) if len(self.keys) else np.zeros(0, np.int32)
        ranks = self.key_ranks[slots[at]] if len(at) else np.zeros(0, np.int32)
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        return dict(zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True)) if len(at) else {}

    def apply(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of all words; ``symbols`` begins and ends with EDGE and has one between words, and so has the result."""
        index, size, ranks = self.initial(symbols), self.size, self.ranks
        sym, after, before = array("i", symbols.tobytes()), array("i", range(1, len(symbols) + 1)), array("i", range(-1, len(symbols) - 1))
        added: dict[int, array] = {}
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            first, second, new = self.pairs[rank]
            found, more = index.pop(rank, None), added.pop(rank, None)
            for part in (found,) if more is None else (np.unique(np.concatenate([*([found] if found is not None else []), np.frombuffer(more, np.int32)])),):
                for i in part.tolist():
                    j = after[i]
                    if sym[i] != first or sym[j] != second:
                        continue
                    sym[i], sym[j] = new, GONE
                    after[i] = k = after[j]
                    before[k] = i
                    h = before[i]
                    for place, code in ((h, sym[h] * size + new), (i, new * size + sym[k])):
                        got = ranks.get(code)
                        if got is not None:
                            if got in added:
                                added[got].append(place)
                            else:
                                added[got] = array("i", (place,))
                                if got not in index:
                                    heapq.heappush(active, got)
        out = np.frombuffer(sym, np.int32)
        return out[out != GONE]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (of at least one byte)."""
        out: list[list[int]] = []
        start = 0
        while start < len(words):
            stop, held = start, 0
            while stop < len(words) and (stop == start or held + len(words[stop]) < SYMBOLS):
                held += len(words[stop]) + 1
                stop += 1
            part = words[start:stop]
            raw = np.frombuffer(b"\0" + b"\0".join(part) + b"\0", np.uint8)
            symbols = self.inner[raw]
            edges = np.cumsum([0, *(len(w) + 1 for w in part)])
            symbols[edges[1:] - 1] = self.last[raw[edges[1:] - 1]]
            symbols[edges] = EDGE
            ids = self.apply(symbols)
            at = np.flatnonzero(ids == EDGE).tolist()
            flat = ids.tolist()
            out += [flat[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]
            start = stop
        return out


class PairIndexEncoder(WordEncoder):
    """Ids of texts; normalising and pre-tokenising are the tokenizer's, merging is ``Merges``'."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__(path, most)
        with open(path, encoding="utf-8") as spec:
            self.merges = Merges(json.load(spec)["model"])
        self.added_ids = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added_ids, key=len, reverse=True))) + ")") if self.added_ids else None

    def pieces(self, word: str) -> list[bytes]:
        """The pre-tokens of a word as raw bytes."""
        if word.isascii() and word.isalpha() and word.islower():
            return [word.encode()]
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [bytes(map(self.merges.bytes.__getitem__, piece)) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, words: list[str]) -> None:
        for start in range(0, len(words), WORDS):
            part = words[start : start + WORDS]
            cut = [self.pieces(w) for w in part]
            distinct = list({p for pieces in cut for p in pieces})
            ids = dict(zip(distinct, self.merges.encode(distinct), strict=True))
            for word, pieces in zip(part, cut, strict=True):
                self.store(word, ids[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids[p]])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self.specials is None or not pc.any(own := pc.match_substring_regex(texts, self.specials.pattern)).as_py():
            return self._by_words(texts)
        parts, owner = [], []  # texts with added tokens' strings are cut there
        for i, (text, cut) in enumerate(zip(texts.to_pylist(), own.to_pylist(), strict=True)):
            for part in self.specials.split(text) if cut else [text]:
                parts.append(part)
                owner.append(i)
        found, edges = self._by_words(pa.array(["" if p in self.added_ids else p for p in parts], pa.string()))
        ids = [np.array([self.added_ids[p]], np.uint32) if p in self.added_ids else found[a:b] for p, a, b in zip(parts, edges.tolist(), edges[1:].tolist(), strict=False)]
        sizes = np.bincount(owner, [len(x) for x in ids], len(texts)).astype(np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PairIndexEncoder(path)


@lru_cache(maxsize=2)
def tokens(path: str) -> pa.Array:
    """The token of each id, null where there is none."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.decoder is not None:
        raise ValueError("only tokenizers without a decoder are supported")
    by_id = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` long, ``ids`` binary (unsigned 32-bit little-endian)."""
    if id_col in ("n_tokens", "ids"):
        raise ValueError("the result has columns of its own named n_tokens and ids")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, edges = encoder(path).encode(batch.column(1))
            raw, cuts = ids.astype("<u4").tobytes(), (4 * edges).tolist()
            packed = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges), pa.int64()), pa.array(packed, pa.binary())], [id_col, "n_tokens", "ids"])

    return rows.mapInArrow(merge, f"`{id_col}` {id_type}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``decoded`` string: the tokens with a space between them, special ones too."""
    if "decoded" in (id_col, *keep):
        raise ValueError("the result has a column of its own named decoded")
    rows = encoded.select(id_col, *keep, F.coalesce(F.col(ids_col), F.lit(b"")).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens(path)
        for batch in sliced(batches, max_bytes=4 << 20):
            packed = batch.column(batch.num_columns - 1).to_pylist()
            ids = np.frombuffer(b"".join(packed), "<u4")
            edges = np.cumsum([0, *(len(p) // 4 for p in packed)])
            known = ids < len(table)
            named = table.take(pa.array(np.where(known, ids, 0), pa.int64()))
            use = known & named.is_valid().to_numpy(zero_copy_only=False)
            if not use.all():
                named, edges = named.filter(pa.array(use)), np.concatenate([[0], np.cumsum(use)])[edges]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), named), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "decoded"])

    return rows.mapInArrow(look_up, f"{schema}, decoded string")
