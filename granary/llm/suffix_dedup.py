"""Repeated-passage removal with longest-previous-factor arrays.

A symbol is repeated if some string of ``length`` symbols that covers it starts
anywhere else.  Symbols are bytes or, with ``unit="word"``, words: runs of other than
ASCII white space, where a character from U+3000 on is a word of its own; a word
stands as four bytes of its hash, so white space between words does not count.
Such strings are found without sorting the whole corpus:

1. Equal texts are one text with a copy count.
2. Minimisers (smallest rolling hash of ``gram_size`` symbols over every
   string of ``length``) put an anchor into every string, at the same place in
   every occurrence.  Only anchors whose gram occurs elsewhere go on; an anchor
   whose whole surroundings occur elsewhere is settled at once.
3. The other surroundings meet by gram.  Their repeated strings are put in
   suffix order, the previous and next smaller text position of each are found
   in that order, and the longer of the two common prefixes is its longest
   previous factor (cut at ``length``).  Starts whose factor reaches ``length``
   are repeated.
4. A gram with more than ``group`` different surroundings is not gathered.  Its
   strings are dealt into ranges of starts; a range whose union occurs
   elsewhere is settled, one whose common core is unique is dropped, and only
   what is left counts single strings by their digest.  Nothing is capped.

``keep_first`` removes a string only where an earlier one exists (texts in
order of their smallest id, then bytes), so the first copy stays; otherwise all
copies go.  Overlapping strings and those within one text count.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes;
repeated rows are copies of each other; a null id sorts first; very long texts are
hashed in segments that overlap by what a string needs; extra columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.buckets import by_group
from granary.llm.common import bucketed, discard, sliced, written

LEAST = {"byte": 100, "word": 16}
SYMBOL = {"byte": np.dtype("<u1"), "word": np.dtype("<u4")}
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE, WIDER = 0xE3, 0xF0  # first bytes from which on a character is a word, and has four bytes
LONG_WORD = 256
MULTIPLIER = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20
NULL_FIRST = -(1 << 63)


def gram_size(length: int) -> int:
    """Symbols of an anchor's gram: 150 of 400."""
    return 3 * length // 8


def word_marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends."""
    data = np.frombuffer(text, np.uint8)
    held = ~SPACES[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    wide = np.flatnonzero(data >= WIDE)
    begins[wide] = True
    after = wide + 3 + (data[wide] >= WIDER)
    after = after[after < len(data)]
    begins[after[held[after]]] = True
    ends = held.copy()
    ends[:-1] &= ~held[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_symbols(text: bytes) -> np.ndarray:
    """A 32-bit hash of each word."""
    starts, stops = word_marks(text)
    out = np.zeros(len(starts), np.uint32)
    data = np.frombuffer(text, np.uint8)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(starts, starts[low] + SEGMENT))
        begin, a = starts[low], starts[low:high] - starts[low]
        b = np.minimum(stops[low:high] - begin, a + LONG_WORD)
        base, inverse = powers(SEGMENT + LONG_WORD + 1)
        part = data[begin : begin + b[-1]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * base[: len(part)], dtype=np.uint64)])
        out[low:high] = mixed((sums[b] - sums[a]) * inverse[a]) >> np.uint64(32)
        low = high
    for i in np.flatnonzero(stops - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh32_intdigest(text[starts[i] : stops[i]])
    return out


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ hashes >> np.uint64(32)


@lru_cache(maxsize=1)
def power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(size, MULTIPLIER, np.uint64), np.full(size, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the rolling hash's base and of its inverse modulo 2**64."""
    return power_table(1 << max(21, (n - 1).bit_length()))


def sliding(values: np.ndarray, width: int, accumulate) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, values[-1], values.dtype)]).reshape(-1, width)
    forward = accumulate(padded, axis=1).reshape(-1)[:n]
    backward = accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    join = np.minimum if accumulate == np.minimum.accumulate else np.maximum
    return join(backward[: n - width + 1], forward[width - 1 :])


def anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and their gram hashes; at least one in every ``length`` symbols, chosen by those alone."""
    gram = gram_size(length)
    width = length - gram + 1
    base, inverse = powers(SEGMENT + 4 * length + 8)
    at, grams = [], []
    for start in range(0, len(data), SEGMENT):
        low, high = max(0, start - 2 * length), min(len(data), start + SEGMENT + 2 * length)
        part = data[low:high].astype(np.uint64) + np.uint64(1)
        if len(part) < length:
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * base[: len(part)], dtype=np.uint64)])
        rolled = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        least = sliding(rolled, width, np.minimum.accumulate)
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum.accumulate) == rolled)
        chosen = chosen[(chosen + low >= start) & (chosen + low < start + SEGMENT)]
        at.append(chosen + low)
        grams.append(rolled[chosen])
    return (np.concatenate(at), np.concatenate(grams)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def surroundings(n: int, at: int, length: int) -> tuple[int, int]:
    """The symbols of all strings that contain the gram at ``at``."""
    return max(0, at - (length - gram_size(length))), min(n, at + length)


def common_prefixes(a: np.ndarray, b: np.ndarray, sums: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
    """How many symbols from a and from b on agree, at most ``length``: by bisection over rolling hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = (sums[a + mid] - sums[a]) * inverse[a] == (sums[b + mid] - sums[b]) * inverse[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def prefix_to_smaller(positions: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """For each entry its common prefix with the nearest entry before it at a smaller position, 0 without one.

    ``prefixes[i]``: common prefix of entry i and the one before it.  Every entry
    points to an earlier one and knows the least prefix on the way; as long as
    the position there is larger it takes over that one's pointer, so ways
    double in length.
    """
    at, least = np.arange(len(positions)) - 1, prefixes.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_ := open_[positions[at[open_]] > positions[open_]]):
        on = at[open_]
        least[open_], at[open_] = np.minimum(least[open_], least[on]), at[on]
        open_ = open_[at[open_] >= 0]
    return np.where(at >= 0, least, 0)


def longest_factors(positions: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """The longest previous factor of each entry of a suffix order: the longer of its common prefixes with the previous and the next smaller position."""
    following = np.concatenate([[0], prefixes[:0:-1]])
    return np.maximum(prefix_to_smaller(positions, prefixes), prefix_to_smaller(positions[::-1], following)[::-1])


def repeated_starts(parts: list[bytes], begins: np.ndarray, length: int, both: bool, symbol: np.dtype = SYMBOL["byte"]) -> list[np.ndarray]:
    """For each part: the starts in it whose string occurs at another text position (an earlier one unless ``both``).

    ``begins[i]``: the text position of part i in a numbering of all texts.

    Rolling hashes drop the starts whose string is unique here.  The others are
    put in suffix order, cut at ``length`` symbols; suffixes equal up to there
    stand in the order of their text positions, so all but the first of them
    have a previous smaller position beside them, at a common prefix of
    ``length``.  ``longest_factors`` tells those of the first ones; the
    mirrored positions give the longest next factors.
    """
    wide = symbol.itemsize
    sizes = np.array([len(p) // wide for p in parts])
    joined = b"".join(parts)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - length + 1
    ids = np.repeat(np.arange(len(parts)), counts)
    within = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[ids] + within
    data = np.frombuffer(joined, symbol).astype(np.uint64) + np.uint64(1)
    base, inverse = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * base[: len(data)], dtype=np.uint64)])
    key = (sums[starts + length] - sums[starts]) * inverse[starts]
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    alive = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(alive):
        return [np.zeros(0, np.int64)] * len(parts)
    opens = np.concatenate([[True], key[alive][1:] != key[alive][:-1]])
    names = np.cumsum(opens) - 1
    at, heads = (wide * starts[alive]).tolist(), (wide * starts[alive[opens]]).tolist()
    span = wide * length
    if not all(joined[s : s + span] == joined[(h := heads[n]) : h + span] for s, n in zip(at, names.tolist(), strict=True)):  # two strings of one hash
        strings: dict[bytes, int] = {}
        names = np.array([strings.setdefault(joined[s : s + span], len(strings)) for s in at], np.int64)
        heads = [at[i] for i in np.unique(names, return_index=True)[1].tolist()]
    rank = np.empty(len(heads), np.int64)
    by_string = sorted(range(len(heads)), key=lambda n: joined[heads[n] : heads[n] + span])
    rank[by_string] = np.arange(len(heads))
    texts = begins[ids[alive]] + within[alive]
    order = np.lexsort((texts, rank[names]))
    names, texts, alive = names[order], texts[order], alive[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    last = np.concatenate([first[1:], [len(names)]]) - 1
    run = np.repeat(np.arange(len(first)), last - first + 1)
    ordered = np.array(heads, np.int64)[by_string] // wide
    prefixes = np.concatenate([[0], common_prefixes(ordered[:-1], ordered[1:], sums, inverse, length)])

    def factors(ends: np.ndarray, side: int) -> np.ndarray:
        """Of every entry, with the positions times ``side``; ``ends``: the entry of each run that has none before it there."""
        of_ends = longest_factors(side * texts[ends], prefixes)
        return np.where(side * texts > side * texts[ends][run], length, of_ends[run])

    hit = factors(first, 1) >= length
    if both:
        hit |= factors(last, -1) >= length
    found = np.sort(alive[hit])
    cut = np.searchsorted(ids[found], np.arange(len(parts) + 1))
    return [within[found[cut[i] : cut[i + 1]]] for i in range(len(parts))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans covered by the strings at sorted starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    first, last = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def digest(*parts: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(parts))


def binary_rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def rows_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


SPAN_SCHEMA = "text_key binary, a int, b int"


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


class Repeats:
    """Finds repeated spans of ``length`` bytes or words; ``texts`` and ``members`` are its results.

    ``texts``: text_key, n_bytes, n_symbols (null for words of a text that neither
    repeats nor loses anything), n_copies, spans array<struct<a,b>> of bytes to
    remove, kept binary: one row per distinct text (of its first copy).
    ``members``: id, text_key, first: one row per input row.
    """

    def __init__(self, docs: DataFrame, length: int = 400, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", group: int = 512, whole_chars: bool = False, unit: str = "byte"):
        if length < LEAST[unit]:
            raise ValueError(f"length must be at least {LEAST[unit]}")
        self.length, self.keep_first, self.group, self.whole_chars, self.unit = length, keep_first, group, whole_chars, unit
        self.made: list[DataFrame] = []
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", text_key(F.col("text")))
        self.members = rows.select("id", "text_key")
        once = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.coalesce("id", F.lit(NULL_FIRST))).alias("first"), F.first("text").cast("binary").alias("text"))
        self.unique = bucketed(once, "text_key", "suffix-texts")
        self.spans = written(self._spans(), "suffix-spans")
        while self.made:
            discard(self.made.pop())
        self.texts = self._cleaned(self.spans)

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        """A written table that goes once the spans are known."""
        self.made.append(written(df, f"suffix-{label}"))
        return self.made[-1]

    def _symbols(self):
        """A function from a text to the bytes of its symbols."""
        return (lambda text: word_symbols(text).astype("<u4").tobytes()) if self.unit == "word" else (lambda text: text)

    def _spans(self) -> DataFrame:
        length, left, symbol, symbols = self.length, self.length - gram_size(self.length), SYMBOL[self.unit], self._symbols()
        wide = symbol.itemsize
        long = self.unique.filter(F.octet_length("text") >= (length if wide == 1 else 2 * length - 1))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, max_bytes=4 << 20):
                out: list[tuple] = []
                for key, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = symbols(text)
                    data = np.frombuffer(raw, symbol)
                    at, gram = anchors_of(data, length)
                    seen: dict[int, list[int]] = {}
                    spans = []
                    for p, g in zip(at.tolist(), gram.view(np.int64).tolist(), strict=True):
                        a, b = surroundings(len(data), p, length)
                        context = xxhash.xxh3_64_intdigest(raw[wide * a : wide * b], p - a) - (1 << 63)
                        if context in seen:  # a run of short period has very many anchors, but few surroundings
                            seen[context][2] += 1
                            spans.append((a, b))
                        else:
                            seen[context] = [p, g, 1]
                    out += [(key, first, p, g, context, n, None) for context, (p, g, n) in seen.items()]
                    out += [(key, first, a, None, None, 0, b) for a, b in merged(spans)]
                if out:
                    yield rows_of(out, {"text_key": pa.binary(), "first": pa.int64(), "at": pa.int32(), "gram": pa.int64(), "context": pa.int64(), "n": pa.int32(), "b": pa.int32()})

        found = self._kept(long.select("text_key", "first", "text").mapInArrow(find, "text_key binary, first long, at int, gram long, context long, n int, b int"), "anchors")
        within = found.filter("gram IS NULL").select("text_key", F.col("at").alias("a"), "b")
        anchors = found.filter("gram IS NOT NULL").drop("b")
        kinds = self._kept(anchors.groupBy("gram", "context").agg(F.sum("n").alias("n")), "kinds")
        # written first, so that a join with a gram of very many surroundings can be split
        grams = self._kept(kinds.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("m")).filter("all > 1").drop("all"), "grams")
        kinds = self._kept(kinds.join(grams, "gram"), "shared")
        met = self._kept(anchors.drop("n").join(kinds, ["gram", "context"]), "met")

        order = self.order()
        firsts = self._kept(met.groupBy("gram", "context").agg(F.min(order).alias("one"), F.first("n").alias("n"), F.first("m").alias("m")), "firsts")
        settled = met.filter("n > 1")
        if self.keep_first:
            settled = settled.join(firsts.filter("n > 1").select("gram", "context", "one"), ["gram", "context"]).filter(order != F.col("one"))
        whole = settled.select("text_key", F.greatest(F.lit(0), F.col("at") - left).alias("a"), (F.col("at") + length).alias("b"))

        wanted = firsts.filter("m > 1").select("gram", "m", "one.text_key", "one.at")
        spans = [within, whole, self._by_order(wanted.filter(F.col("m") <= self.group))]
        hot = wanted.filter(F.col("m") > self.group)
        if not hot.isEmpty():
            spans += self._by_ranges(hot)
        out = spans[0]
        for s in spans[1:]:
            out = out.unionByName(s)
        return out

    def order(self) -> Column:
        """What comes first where copies are compared; any fixed order does if all copies go."""
        return F.struct("first", "text_key", "at") if self.keep_first else F.struct("text_key", "at")

    def _asked(self, wanted: DataFrame, *more: str) -> DataFrame:
        """Texts with the anchors asked for in them."""
        asked = wanted.groupBy("text_key").agg(F.collect_list(F.struct("at", *more)).alias("asked"))
        return self.unique.select("text_key", "first", "text").join(asked, "text_key")

    def _by_order(self, wanted: DataFrame) -> DataFrame:
        length, both, symbol, symbols = self.length, not self.keep_first, SYMBOL[self.unit], self._symbols()
        wide = symbol.itemsize

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, max_bytes=2 << 20):
                for key, first, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = symbols(text)
                    spans = [surroundings(len(raw) // wide, x["at"], length) for x in asked]
                    yield binary_rows({"gram": ([x["gram"] for x in asked], pa.int64()), "first": ([first] * len(asked), pa.int64()), "text_key": ([key] * len(asked), pa.binary()), "a": ([a for a, _ in spans], pa.int32()), "part": ([raw[wide * a : wide * b] for a, b in spans], pa.binary())})

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            texts = sorted({(first, key) for _, first, key, _, _ in rows})
            number = {t: i for i, t in enumerate(texts)}
            begins = np.array([(number[first, key] << 32) + a for _, first, key, a, _ in rows], np.int64)
            found = repeated_starts([r[4] for r in rows], begins, length, both, symbol)
            out = [(key, a + x, a + y) for (_, _, key, a, _), starts in zip(rows, found, strict=True) for x, y in runs(starts, length)]
            return binary_rows({"text_key": ([x[0] for x in out], pa.binary()), "a": ([x[1] for x in out], pa.int32()), "b": ([x[2] for x in out], pa.int32())})

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0
            for group in by_group(batches, 1):  # several groups share one suffix order; a match between groups is a match
                rows = list(zip(*(c.to_pylist() for c in group.columns), strict=True))
                held += rows
                size += sum(len(r[4]) for r in rows)
                if size >= 1 << 18:
                    yield solve(held)
                    held, size = [], 0
            if held:
                yield solve(held)

        rows = self._asked(wanted, "gram").mapInArrow(gather, "gram long, first long, text_key binary, a int, part binary")
        return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, SPAN_SCHEMA)

    def _by_ranges(self, wanted: DataFrame) -> list[DataFrame]:
        """Grams with very many different surroundings."""
        length, left, symbols, wide = self.length, self.length - gram_size(self.length), self._symbols(), SYMBOL[self.unit].itemsize
        step = length // 8
        n_ranges = -(-(left + 1) // step)

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, max_bytes=2 << 20):
                for key, first, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out, raw = [], symbols(text)
                    for at in (x["at"] for x in asked):
                        for k in range(n_ranges):  # strings that start between at - high and at - low
                            low, high = max(k * step, at + length - len(raw) // wide), min((k + 1) * step - 1, left, at)
                            if low <= high:
                                tag = k.to_bytes(4, "little")
                                core = raw[wide * max(0, at - k * step) : wide * (at - (k + 1) * step + 1 + length)]
                                out.append((at, k, low, high, digest(tag, core), digest(tag, (low).to_bytes(4, "little"), (high).to_bytes(4, "little"), raw[wide * (at - high) : wide * (at - low + length)])))
                    yield binary_rows({"first": ([first] * len(out), pa.int64()), "text_key": ([key] * len(out), pa.binary()), **{c: ([x[i] for x in out], t) for i, (c, t) in enumerate((("at", pa.int32()), ("k", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("core", pa.binary()), ("union", pa.binary())))}})

        dealt = self._kept(self._asked(wanted).mapInArrow(ranges, "first long, text_key binary, at int, k int, low int, high int, core binary, union binary"), "ranges")
        order = self.order()
        unions = self._kept(dealt.groupBy("union").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("earliest")).filter("n > 1"), "unions")
        cores = self._kept(dealt.groupBy("core").agg(F.count(F.lit(1)).alias("n_core")).filter("n_core > 1"), "cores")
        told = dealt.join(unions, "union", "left")
        done = F.col("n").isNotNull() & (order != F.col("earliest")) if self.keep_first else F.col("n").isNotNull()
        settled = told.filter(done).select("text_key", (F.col("at") - F.col("high")).alias("a"), (F.col("at") - F.col("low") + length).alias("b"))
        witness = F.col("n").isNull() | (order == F.col("earliest"))  # of equal ranges the earliest still meets the others' strings
        open_ = self._kept(told.filter(witness).join(cores, "core", "left_semi").select("text_key", "at", "low", "high"), "open")

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, max_bytes=2 << 20):
                for key, first, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = symbols(text)
                    starts = sorted({x["at"] - d for x in asked for d in range(x["low"], x["high"] + 1)})
                    yield binary_rows({"first": ([first] * len(starts), pa.int64()), "text_key": ([key] * len(starts), pa.binary()), "at": (starts, pa.int32()), "string": ([xxhash.xxh3_128_digest(raw[wide * s : wide * (s + length)]) for s in starts], pa.binary())})

        single = self._kept(self._asked(open_, "low", "high").mapInArrow(strings, "first long, text_key binary, at int, string binary"), "strings")
        repeated = self._kept(single.groupBy("string").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("earliest")).filter("n > 1"), "repeated")
        hits = single.join(repeated, "string")
        if self.keep_first:
            hits = hits.filter(order != F.col("earliest"))
        return [settled, hits.select("text_key", F.col("at").alias("a"), (F.col("at") + length).alias("b"))]

    def _cleaned(self, spans: DataFrame) -> DataFrame:
        length, all_copies, whole_chars, by_words = self.length, not self.keep_first, self.whole_chars, self.unit == "word"
        found = spans.groupBy("text_key").agg(F.collect_set(F.struct("a", "b")).alias("found"))
        rows = self.unique.join(found, "text_key", "left").select("text_key", "n_copies", "text", "found")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, max_bytes=4 << 20):
                removed, kept, sizes, counts = [], [], [], []
                for _, copies, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    whole = all_copies and copies > 1
                    starts, stops = word_marks(text) if by_words and (own or copies > 1) else (None, None)
                    n = len(text) if starts is None else len(starts)
                    gone = [(0, n)] if whole and n >= length else merged([(x["a"], min(x["b"], n)) for x in own or ()])
                    if starts is not None:
                        gone = [(int(starts[a]), int(stops[b - 1])) for a, b in gone]
                    if whole_chars:
                        gone = [g for g in (inner(text, a, b) for a, b in gone) if g[0] < g[1]]
                    edges = [0, *(x for g in gone for x in g), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"a": a, "b": b} for a, b in gone])
                    sizes.append(len(text))
                    counts.append(n if starts is not None or not by_words else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), batch.column(1), pa.array(removed, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.binary())], ["text_key", "n_bytes", "n_symbols", "n_copies", "spans", "kept"])

        return rows.mapInArrow(cut, "text_key binary, n_bytes long, n_symbols long, n_copies long, spans array<struct<a:int,b:int>>, kept binary")

    def firsts(self) -> DataFrame:
        return self.unique.select("text_key", "first")

    def close(self) -> None:
        """Delete what ``texts`` and ``firsts`` read, once their rows are used."""
        discard(self.spans)
        discard(self.unique)


def inner(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The whole UTF-8 characters inside a span."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
