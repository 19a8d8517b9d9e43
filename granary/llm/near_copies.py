"""Near copies by the Jaccard similarity of their word shingles: MinHash bands, exact verification.

A text is the set of its shingles (``words`` ASCII-lower-cased words, XXH64 each;
fewer words are one shingle, none are the empty set).  Texts of one set are one
node.  ``BANDS`` bands of ``ROWS`` minima propose what to compare: two sets at
similarity 0.8 share no band in 3 of 100,000 cases.  Groups found otherwise (``proposed``,
the SimHash components of the pipeline) are one more band.  Inside a bucket similarity is exact,
from the whole sets.  Buckets of the same members are compared once.

A bucket is searched breadth first for what is not reached yet, so one of much alike
texts costs little more than a pass.  Larger buckets are dealt into tiles; every
pair of tiles is a group.

Defined cases: null text is the empty text; texts without a word are copies of
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.buckets import by_group
from granary.llm.common import cut_at_spaces, sliced, texts_of, written
from granary.llm.graph import smallest_members

BANDS, ROWS = 20, 4
MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
RUN = 1 << 14


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    digest, found = xxhash.xxh64_intdigest, []
    tokens: list[bytes] = []
    for piece in cut_at_spaces(text.encode("utf-8", "surrogatepass").lower()):
        tokens = tokens[-(words - 1) :] + piece.split() if found else tokens + piece.split()  # shingles run on over a cut
        if len(tokens) < words:
            continue
        joined = b" ".join(tokens)
        stops = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(tokens) - words + 1].tolist()
        found.append(np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops[words - 1 :].tolist(), strict=True)], np.uint64)))
    if not found:
        return np.array([digest(b" ".join(tokens), 42)] if tokens else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def node_of(own: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).view(np.int64))


def bands(own: np.ndarray) -> list[int]:
    least = np.full(len(MULTIPLIERS), ~np.uint64(0))
    for start in range(0, len(own), RUN):
        np.minimum(least, (own[start : start + RUN, None] * MULTIPLIERS).min(axis=0), out=least)
    return [int(x) for x in np.array([xxhash.xxh3_64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)]


def tree(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets at the similarity or above."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [codes[b - n : b] for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
    marked = np.zeros(int(codes.max()) + 1, bool)
    left, out = np.arange(len(sets)), []
    flat, starts = codes, ends - sizes
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            keep = np.arange(1, len(left))
        else:
            i = queue.pop()
            marked[own[i]] = True
            common = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[own[i]] = False
            hit = common >= similarity * (sizes[i] + sizes[left] - common) - 1e-9
            if not hit.any():
                continue
            out += [(i, int(j)) for j in left[hit]]
            queue += left[hit].tolist()
            keep = np.flatnonzero(~hit)
        left = left[keep]
        if len(left):
            flat = np.concatenate([own[j] for j in left.tolist()])
            starts = np.cumsum(sizes[left]) - sizes[left]
    return out


def dealt_buckets(nodes: DataFrame, tile: int, tile_shingles: int) -> DataFrame:
    """``nodes``: node, size, bands.  band, key, low, high, node: rows that agree but for the node are a group to compare."""
    placed = nodes.filter("size > 0").select("node", "size", F.posexplode("bands").alias("band", "key"))
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("least")]
    buckets = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *members).filter("n > 1")
    buckets = buckets.groupBy("n", "x", "y", "least").agg(F.min(F.struct("band", "key")).alias("of"), F.min("total").alias("total"))
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("total") / tile_shingles)).alias("tiles")
    rows = placed.select("band", "key", "node").join(buckets.select("of.band", "of.key", tiles), ["band", "key"])
    mine = F.pmod(F.xxhash64("node"), F.col("tiles"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: (o != mine) | (F.col("tiles") == 1))
    pairs = F.transform(others, lambda o: F.struct(F.least(mine, o).alias("low"), F.greatest(mine, o).alias("high")))
    return rows.select("band", "key", "node", F.explode(pairs).alias("p")).select("band", "key", "p.low", "p.high", "node")


def links(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``sets``: node, own.  Links a, b that connect what is similar within the groups of ``dealt``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, 4):
            if group.num_rows > 1:
                node = group.column("node").to_numpy()
                found = tree([np.frombuffer(s, np.uint64) for s in group.column("own").to_pylist()], similarity)
                if found:
                    at = np.array(found)
                    yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["a", "b"])

    key = ["band", "key", "low", "high"]
    full = dealt.join(sets, "node").select(*key, "node", "own")
    return full.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = 1024, tile_shingles: int = 1 << 20, proposed: DataFrame | None = None) -> DataFrame:
    """``proposed`` (digest, component): texts of one component are compared too.  ``id_col``, ``digest`` (XXH64 of the text), ``component``, ``first_digest``: the smallest id reachable over near copies, and of its texts the smallest digest."""
    kind = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max_bytes=2 << 20):
            sets = [shingles(t, words) for t in texts_of(batch)]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "digest", "size", "node", "bands"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max_bytes=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in texts_of(batch)], pa.binary())], ["node", "own"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    marked = written(rows.mapInArrow(mark, f"id {kind}, digest long, size long, node long, bands array<long>"), "copies-bands")
    nodes = written(marked.groupBy("node").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "digest"))).alias("first"), F.min("digest").alias("digest"), F.min("size").alias("size"), F.min("bands").alias("bands")), "copies-nodes")
    if proposed is not None:
        nodes = written(nodes.join(proposed.select("digest", "component"), "digest").withColumn("bands", F.concat("bands", F.array("component"))), "copies-proposed")
    dealt = written(dealt_buckets(nodes, tile, tile_shingles), "copies-dealt")
    # only the sets that meet another are made again, so the others are never stored
    met = dealt.select("node").distinct().join(nodes.select("node", "digest"), "node")
    texts = rows.select("digest", "text").join(met, "digest").dropDuplicates(["digest"])
    sets = written(texts.select("node", "text").mapInArrow(again, "node long, own binary"), "copies-sets")
    found = smallest_members(nodes.select("node", "first"), links(dealt, sets, similarity), "copies")
    return marked.select("id", "digest", "node").join(found, "node").select(F.col("id").alias(id_col), "digest", F.col("component.id").alias("component"), F.col("component.digest").alias("first_digest"))
