"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking.

A sample of at most ``SAMPLE`` vectors (smallest hashes of their ids) trains
``rotations`` rotations of the centred principal components, each turned until its
sign bits lie close to the data (ITQ).  Every vector gets a code per
rotation; each code is cut into substrings of ``b`` bits, and every substring is a
table.  With n distinct vectors b is log2(n), and there are at least as many tables as
let a pair at the threshold meet with probability ``recall`` if bits flip
independently at the rate angle / pi.  Centring makes bits flip more often where
vectors share a direction, so pairs are made at the threshold from the sample
(moved at random, and towards other vectors): radius and tables grow until
``recall`` of both kinds meet.  Where ``MOST`` tables do not suffice, one table without
a key holds every pair against every other, in tiles.

Vectors that meet in a bucket are first compared by the whole code of that
rotation; only those with a neighbour within the radius (``RADIUS`` bits at least) are joined to
their vectors, and pairs are judged by their cosine in double precision.  A pair is
counted in the first table where it meets.  Equal vectors are one vector with a
multiplicity.  Buckets are dealt into tiles, so no group is unbounded; links
are not listed, a bucket gives sums per vector and a spanning forest.

Each dimension is a group of its own, with its own rotations and tables; vectors
of different dimensions never link.

Defined cases: vectors that are null or zero or hold null or non-finite
components link with nothing; so do rows without id.  Ids name vectors: rows of
equal id and vector are copies, rows of one id with other vectors are vectors of
that id.  Extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.buckets import by_group, paired_groups, spanning_links
from granary.llm.common import discard, written
from granary.llm.graph import smallest_members

SAMPLE = 20_000
RADIUS = 18
MOST = 96
PAIRS = 2000
BLOCK = 256


def train(vectors: np.ndarray, bits: int, rotations: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean, and for each rotation the projection whose signs are the bits."""
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    top = axes[:, ::-1][:, :bits]
    low = centred @ top
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        out.append(top @ turn)
    return mean, out


def plan(n: int, bits: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """Bits of a substring, tables, rotations."""
    b = max(1, min(bits, max(8, math.ceil(math.log2(max(2, n))))))
    meet = (1 - math.acos(threshold) / math.pi) ** b
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    each = bits // b
    return b, tables, -(-tables // each)


def pairs_at(x: np.ndarray, threshold: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of the sample with others at the threshold: moved in any direction, and towards other vectors."""
    rng = np.random.default_rng(seed)
    own = x[rng.permutation(len(x))[:PAIRS]]
    out = []
    for side in (rng.standard_normal(own.shape), x[rng.integers(0, len(x), len(own))] - own):
        side = side - (side * own).sum(axis=1, keepdims=True) * own
        size = np.linalg.norm(side, axis=1)
        good = size > 1e-6
        if good.any():
            out.append((own[good], threshold * own[good] + math.sqrt(max(0.0, 1 - threshold**2)) * side[good] / size[good, None]))
    return out


def fitted(x: np.ndarray, n: int, bits: int, threshold: float, recall: float) -> tuple[int, int, int, np.ndarray, list[np.ndarray]]:
    """Bits of a substring, tables, radius, mean and projections by which made pairs meet at the recall; no bits: all against all."""
    b, tables, rotations = plan(n, bits, threshold, recall)
    each, pairs = bits // b, pairs_at(x, threshold)
    mean, turns = train(x, bits, rotations)
    flips: list[list[np.ndarray]] = [[] for _ in pairs]

    def measure(new: list[np.ndarray]) -> None:
        for (one, other), held in zip(pairs, flips, strict=True):
            held += [((one - mean) @ turn >= 0) != ((other - mean) @ turn >= 0) for turn in new]

    measure(turns)
    far = [int(np.quantile(np.stack(held).sum(axis=2), 0.999)) for held in flips]
    radius = min(bits, max([RADIUS, *far]))

    def enough(tables: int) -> bool:
        for held in flips:
            met = np.zeros(len(held[0]), bool)
            for t in range(tables):
                flip, start = held[t // each], b * (t % each)
                met |= ~flip[:, start : start + b].any(axis=1) & (flip.sum(axis=1) <= radius)
            if met.mean() < recall:
                return False
        return True

    while not enough(tables):
        if tables >= max(MOST, each):
            return 0, 1, bits, mean, turns[:1]
        tables = min(-(-tables * 5 // 4), max(MOST, each))
        more = -(-tables // each) - len(turns)
        if more > 0:
            new = train(x, bits, more, seed=7 + len(turns))[1]
            measure(new)
            turns += new
    return b, tables, radius, mean, turns[: -(-tables // each)]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = 2048) -> DataFrame:
    """id_col, n_links, component, kept: one row per input row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("dim", F.when(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)), F.size("vec")))
    base = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.reverse("vec")))
    told = None
    for size in sorted(r["dim"] for r in base.filter("dim IS NOT NULL").select("dim").distinct().collect()):  # the few dimensions that occur
        part = linked(base.filter(F.col("dim") == size), size, threshold, recall, tile)
        told = part if told is None else told.unionByName(part)
    alone = F.when(F.col("id").isNotNull(), F.col("id"))
    if told is None:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), alone.alias("component"), F.col("id").isNotNull().alias("kept"))
    out = base.select("id", "h1", "h2", "dim").join(told, ["h1", "h2", "dim"], "left")
    component = F.coalesce("component", alone)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def linked(base: DataFrame, dim: int, threshold: float, recall: float, tile: int) -> DataFrame:
    """h1, h2, dim, n_links, component of the distinct vectors of one dimension."""
    nodes = written(base.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "itq-nodes")

    sample = nodes.select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").toArrow()
    x = matrix(sample.column(0).combine_chunks(), dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits = min(64, dim)
    b, n_tables, radius, mean, turns = fitted(x, nodes.count(), bits, threshold, recall)
    n_rotations, each = len(turns), bits // b if b else 1
    if not b:
        tile *= 4
    sent = base.sparkSession.sparkContext.broadcast((mean, np.concatenate(turns, axis=1)))

    def keys_of(codes: np.ndarray) -> np.ndarray:
        """n x tables: the substring of each table."""
        return np.stack([(codes[:, t // each] >> np.uint64(b * (t % each))) & np.uint64((1 << b) - 1) for t in range(n_tables)], axis=1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turns = sent.value
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), dim)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                signs = ((v - mean) @ turns >= 0).reshape(len(v), n_rotations, bits)
                codes = (signs * weights).sum(axis=2, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes.view(np.int64)), pa.list_(pa.int64()))], ["node", "codes"])

    coded = written(nodes.select("node", "vec").mapInArrow(encode, "node long, codes array<long>"), "itq-codes")
    places = [F.struct(F.lit(t).alias("table"), F.shiftrightunsigned(F.col("codes")[t // each], b * (t % each)).bitwiseAND((1 << b) - 1).alias("key"), F.col("codes")[t // each].alias("code")) for t in range(n_tables)]
    placed = coded.select("node", F.explode(F.array(*places)).alias("p")).select("p.table", "p.key", "node", "p.code")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, 4):
            code = group.column(6).to_numpy().view(np.uint64)
            near = np.zeros(len(code), bool)
            for start in range(0, len(code), BLOCK):
                close = popcount(code[start : start + BLOCK, None] ^ code) <= radius
                near[start : start + BLOCK] = close.sum(axis=1) > 1
            at = pa.array(np.flatnonzero(near))
            if len(at):
                yield group.select(["table", "key", "node"]).take(at).combine_chunks().to_batches()[0]

    sifted = paired_groups(placed, ["table", "key"], "node", tile).select("table", "key", "t_low", "t_high", "t_own", "node", "code").mapInArrow(sift, "table int, key long, node long")
    alive = written(sifted.distinct(), "itq-alive")
    full = alive.join(coded, "node").join(nodes.select("node", "copies", "vec"), "node").select("table", "key", "node", "codes", "copies", "vec")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, 4):
            table, low, high = (group.column(c)[0].as_py() for c in ("table", "t_low", "t_high"))
            node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            codes = group.column("codes").combine_chunks().flatten().to_numpy().reshape(len(node), -1).view(np.uint64)
            v = matrix(group.column("vec").combine_chunks(), dim)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            keys = keys_of(codes)
            own = group.column("t_own").to_numpy() == low
            links, masks = np.zeros(len(node), np.int64), []
            for start in range(0, len(node), BLOCK):
                rows = slice(start, min(start + BLOCK, len(node)))
                hit = v[rows] @ v.T >= threshold
                hit &= popcount(codes[rows, None, table // each] ^ codes[:, table // each]) <= radius
                masks += [int.from_bytes(m.tobytes(), "little") for m in np.packbits(hit, axis=1, bitorder="little")]
                i, j = np.nonzero(hit)
                i += start
                fresh = (i != j) & ((low == high) | (own[i] != own[j]))
                i, j = i[fresh], j[fresh]
                for t in range(table):  # met before: it has been counted there
                    r = t // each
                    new = (keys[i, t] != keys[j, t]) | (popcount(codes[i, r] ^ codes[j, r]) > radius)
                    i, j = i[new], j[new]
                np.add.at(links, i, copies[j])
            every = (1 << len(node)) - 1
            first = int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")
            tree = spanning_links(len(node), masks.__getitem__, [every] if low == high else [first, every & ~first])
            at = np.flatnonzero(links)
            a = np.concatenate([node[at], node[[x for x, _ in tree]]]) if tree else node[at]
            if len(a):
                other = [None] * len(at) + node[[y for _, y in tree]].tolist() if tree else [None] * len(at)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64()), pa.array(np.concatenate([links[at], np.zeros(len(tree), np.int64)]), pa.int64())], ["a", "b", "n"])

    groups = paired_groups(full, ["table", "key"], "node", tile).select("table", "key", "t_low", "t_high", "t_own", "node", "codes", "copies", "vec")
    judged = written(groups.mapInArrow(judge, "a long, b long, n long"), "itq-links")
    counts = judged.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = smallest_members(nodes.select("node", F.col("node").alias("first")), judged.filter("b IS NOT NULL").select("a", "b"), "itq")
    told = nodes.select("h1", "h2", "node", "copies").join(counts, "node", "left").join(found, "node").select("h1", "h2", F.lit(dim).alias("dim"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    told = written(told, "itq-told")
    for old in (judged, alive, coded, nodes):
        discard(old)
    return told


#: The query in SQL: all pairs, and components by the smallest id reachable.
LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
good AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM v
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON node = v.vec_id
"""
