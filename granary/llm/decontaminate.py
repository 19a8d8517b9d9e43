"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised to lower-case runs of word characters joined by
single spaces.  An item of m characters has an error budget of ``rate`` * m
edits and is split into budget + 1 pieces; a text within the budget holds
at least one piece unchanged.  All pieces are found in one pass (Aho-Corasick),
and each place is verified with Myers' bit-parallel edit distance.

Items are taken in blocks of about ``block_items``, so no step holds an
unbounded benchmark; every block sees every document.  A block is sent once to each
executor, and a worker builds its automaton once.

Defined cases: null text is empty; items without word characters match
nothing; short items have budget 0 and must occur as whole words; repeated
items and repeated documents give a row each; very long texts are normalised in
pieces; extra columns are not read or, by ``clean``, passed on as they are; empty tables
give no rows, and an empty benchmark removes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import cut_at_spaces, sliced, texts_of

WORD = re.compile(r"\w+")


def normalise(text: str) -> str:
    """Lower-case word runs, each followed by a space, after a leading space."""
    return " " + "".join("".join(w + " " for w in WORD.findall(piece.lower())) for piece in cut_at_spaces(text))


def peq(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to a substring of the text, and that substring's first end."""
    every, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = every, 0, m
    best, at = limit + 1, -1
    for j, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up <<= 1
        plus = ((down << 1) | ~(xv | up)) & every
        minus = up & xv & every
        if score < best:
            best, at = score, j
    return (best, at) if at >= 0 else None


class Matcher:
    """The pieces of a block of items."""

    def __init__(self, items: tuple[str, ...], rate: float):
        self.items, self.budget = items, [int(rate * len(x)) for x in items]
        self.forward, self.backward = [peq(x) for x in items], [peq(x[::-1]) for x in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            k = self.budget[n]
            for j in range(k + 1):
                a, b = j * len(item) // (k + 1), (j + 1) * len(item) // (k + 1)
                pieces.setdefault(item[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """item, distance, start, end of the best match of each item within its budget."""
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                begins.setdefault(n, set()).add(end + 1 - size - offset)
        out = []
        for n, places in begins.items():
            m, k, best = len(self.items[n]), self.budget[n], None
            low = high = None
            for b in [*sorted(places), None]:
                if low is not None and (b is None or b - high > m):
                    a = max(0, low - k)
                    found = best_match(self.forward[n], m, text[a : high + m + k], k)
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], a + found[1])
                    low = None
                if b is not None:
                    low, high = b if low is None else low, b
            if best:
                distance, end = best
                back = best_match(self.backward[n], m, text[max(0, end - m - k) : end][::-1], k)
                out.append((n, distance, end - back[1], end))
        return out


@lru_cache(maxsize=2)
def matcher(items: tuple[str, ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def sent_block(docs: DataFrame, texts: tuple[str, ...], ids: list[list]):
    """A block as a broadcast: about block_items items."""
    return docs.sparkSession.sparkContext.broadcast((texts, ids))


def blocks(items: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[tuple[tuple[str, ...], list[list]]]:
    """Normalised texts and their ids, block by block."""
    rows = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = -(-rows.count() // block_items)
    for k in range(n):
        own: dict[str, list] = {}
        for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect():  # about block_items rows
            if (text := normalise(r["text"])) != " ":
                own.setdefault(text, []).append(r["item"])
        if own:
            yield tuple(own), list(own.values())


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item found in it: id_col, item_col, distance, start, end (of the normalised text)."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, item {item_type}, distance int, start long, end long"
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for texts, ids in blocks(items, item_col, item_text_col, block_items):

        def search(batches: Iterator[pa.RecordBatch], sent=sent_block(docs, texts, ids)) -> Iterator[pa.RecordBatch]:
            texts, ids = sent.value
            found = matcher(texts, rate)
            for batch in sliced(batches):
                hits = [(doc, item, *m[1:]) for doc, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True) for m in found.matches(normalise(t)) for item in ids[m[0]]]
                kinds = (batch.schema.field(0).type, item_arrow, pa.int32(), pa.int64(), pa.int64())
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), kinds, strict=True)], ["id", "item", "distance", "start", "end"])

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_items: int = 20_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    place, schema = docs.columns.index(text_col), docs.schema
    for texts, _ in blocks(items, item_col, item_text_col, block_items):

        def sift(batches: Iterator[pa.RecordBatch], sent=sent_block(docs, texts, [])) -> Iterator[pa.RecordBatch]:
            found = matcher(sent.value[0], rate)
            for batch in sliced(batches):
                yield batch.filter(pa.array([not found.matches(normalise(t or "")) for t in batch.column(place).to_pylist()]))

        docs = docs.mapInArrow(sift, schema)
    return docs
