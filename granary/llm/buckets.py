"""Work over the rows of equal bucket keys, in bounded groups.

A bucket of more than ``tile`` rows is dealt into tiles by a hash; each pair of
tiles becomes a group of its own, so no group holds more than two tiles and
every pair of rows of a bucket still meets.  Buckets of one row are dropped
before anything is replicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import release


def paired_groups(rows: DataFrame, key: list[str], by: str, tile: int) -> DataFrame:
    """``rows`` with the columns t_low, t_high, t_own: rows of equal key, t_low and t_high are a group."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("t_n")).filter("t_n > 1")
    placed = rows.join(sizes, key).withColumn("t_count", F.ceil(F.col("t_n") / tile)).withColumn("t_own", F.pmod(F.xxhash64(by), F.col("t_count")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("t_count") - 1), lambda o: F.struct(F.least("t_own", o).alias("low"), F.greatest("t_own", o).alias("high")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    placed = placed.withColumn("t_pair", F.explode(F.when(F.col("t_count") == 1, whole).otherwise(pairs)))
    placed = placed.withColumn("t_low", F.col("t_pair.low")).withColumn("t_high", F.col("t_pair.high")).drop("t_pair", "t_n", "t_count")
    group = [*key, "t_low", "t_high"]
    return placed.repartition(*group).sortWithinPartitions(*group, by)


def by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns, whole, in order."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            now = tuple(k[start] for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)
    release()


class Forest:
    """Union-find; ``join`` says whether two items were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


Near = Callable[[int], int]


def spanning_links(n: int, near: Near, tiles: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is connected, few of them.

    ``near(i)``: bit mask of the rows linked to row i.  ``tiles``: masks of one
    tile, or of the two tiles of a pair; links inside a tile of a pair are left
    to the group of that tile alone.
    """
    links: list[tuple[int, int]] = []
    reach: list[int] = [0] * n
    part: list[int] = [0] * n  # mask of the row's component inside its tile
    for tile in tiles:
        left = tile
        while left:
            first = (left & -left).bit_length() - 1
            left &= left - 1
            queue, members = [first], 1 << first
            while queue:
                i = queue.pop()
                reach[i] = near(i)
                new = reach[i] & left
                left &= ~new
                members |= new
                while new:
                    j = (new & -new).bit_length() - 1
                    new &= new - 1
                    queue.append(j)
                    if len(tiles) == 1:
                        links.append((i, j))
            rest = members if len(tiles) == 2 else 0
            while rest:
                j = (rest & -rest).bit_length() - 1
                rest &= rest - 1
                part[j] = members
    if len(tiles) == 2:
        forest = Forest(n)
        for i in range(n):
            if not tiles[0] >> i & 1:
                continue
            own = (part[i] & -part[i]).bit_length() - 1
            hits = reach[i] & tiles[1]
            while hits:
                j = (hits & -hits).bit_length() - 1
                other = (part[j] & -part[j]).bit_length() - 1
                if forest.join(own, other):
                    links.append((i, j))
                hits &= ~part[j]
    return links
