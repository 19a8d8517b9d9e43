"""SimHash near-duplicates: bit-sliced comparison inside exact-piece buckets.

Fingerprint: ASCII-lower-cased words (runs other than ASCII white space), their
shingles with repeats, XXH64 (seed 42) of each; a bit is 1 if set in over half
of the hashes.  Fewer words than a shingle: the whole sequence; none: zero.

Fingerprints within ``radius`` bits agree in at least ``pieces - radius`` of
``pieces`` equal pieces, so distinct fingerprints are bucketed by every choice of that
many pieces.  Inside a bucket the bits are stored as vertical planes; a
fingerprint is held against all rows at once with carry-save counters, and a
bucket is abandoned as soon as every row is over the radius.  Equal fingerprints are
one row from the start, and oversized buckets are dealt into pairs of tiles.

Defined cases: null text is the empty text (fingerprint zero, linked like any
other); repeated rows share their fingerprint and component; a null id never
becomes a component id unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.buckets import by_group, paired_groups, spanning_links
from granary.llm.common import cut_at_spaces, sliced, texts_of, written
from granary.llm.graph import smallest_members

BITS = 64


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    tokens: list[bytes] = []
    for piece in cut_at_spaces(text.encode("utf-8", "surrogatepass").lower()):
        tokens = tokens[-(words - 1) :] + piece.split() if n else tokens + piece.split()  # shingles run on over a cut
        if len(tokens) < words:
            continue
        joined = b" ".join(tokens)
        stops = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(tokens) - words + 1].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops[words - 1 :].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return digest(b" ".join(tokens), seed) if tokens else 0
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


class Planes:
    """Fingerprints as vertical bit planes."""

    def __init__(self, fps: np.ndarray, radius: int):
        n = len(fps)
        bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        varied = np.flatnonzero((bits != bits[0]).any(axis=0)).tolist()  # the others never differ
        self.rows = bits[:, varied].tolist()
        self.planes = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in varied]
        self.all, self.radius = (1 << n) - 1, radius

    def near(self, i: int) -> int:
        """Mask of the rows within the radius of row i (itself included)."""
        every = self.all
        counters = [0] * (self.radius + 1).bit_length()
        over = 0
        limit = self.radius + 1
        for bit, plane in zip(self.rows[i], self.planes, strict=True):
            carry = plane ^ every if bit else plane
            for k, held in enumerate(counters):
                counters[k], carry = held ^ carry, held & carry
            over |= carry
            reached = every
            for k, held in enumerate(counters):
                reached &= held if limit >> k & 1 else ~held
            over |= reached
            if over == every:
                return 0
        return every & ~over


def links(fps: DataFrame, radius: int = 2, pieces: int = 4, tile: int = 8192) -> DataFrame:
    """``fps``: distinct long ``fp``.  Links a, b that connect all that is connected within the radius."""
    width = BITS // pieces
    keys = []
    for k, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum(((1 << width) - 1) << width * c for c in chosen)
        keys.append(F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.table", "k.key", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, 4):
            low, high = group.column(2)[0].as_py(), group.column(3)[0].as_py()
            fp = group.column(5).to_numpy()
            planes = Planes(fp.view(np.uint64), radius)
            if low == high:
                tiles = [planes.all]
            else:
                own = group.column(4).to_numpy() == low
                first = int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")
                tiles = [first, planes.all & ~first]
            found = spanning_links(len(fp), planes.near, tiles)
            if found:
                pairs = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], ["a", "b"])

    grouped = paired_groups(rows, ["table", "key"], "fp", tile).select("table", "key", "t_low", "t_high", "t_own", "fp")
    return grouped.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``id_col``, ``fp``, ``component``: the smallest id reachable over links, its own included."""
    marked = written(fingerprints(docs, id_col, text_col, words), "simhash-fps")
    nodes = written(marked.groupBy(F.col("fp").alias("node")).agg(F.min(id_col).alias("first")), "simhash-nodes")
    found = smallest_members(nodes, links(nodes.select(F.col("node").alias("fp")), radius), "simhash")
    return marked.join(found.withColumnRenamed("node", "fp"), "fp").select(id_col, "fp", "component")
