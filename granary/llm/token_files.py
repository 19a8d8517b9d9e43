"""Token-id files: canonical length-limited Huffman blocks.

Documents are ordered by id, tokenised, and their ids packed into blocks of
whole documents.  Global id counts (at most one row per vocabulary entry) give
a canonical code of at most ``max_bits`` bits by the package-merge method.
Each block is coded on its own with the bit offset of every ``CHECKPOINT``-th
id, so a reader starts at any checkpoint; decoding looks ``max_bits`` bits up
in one table and runs over all checkpoints of a block side by side.

Layout under a path: ``codebook`` (id, bits) and ``blocks`` (part, block,
start, doc_ids, n_tokens, checkpoints, payload), both Parquet, so any Hadoop
store can hold them.  Blocks in the order (part, block) hold the documents in
ascending id order (null ids first, equal ids by text).

Defined cases: null text is the empty text and yields the end id alone;
repeated rows are written once each; an empty table gives empty files.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import LONG, SPACE_CHAR, cut_at_spaces, discard, sliced, written

CHECKPOINT = 64


class WordEncoder:
    """Ids of texts by a lower-casing BPE tokenizer whose pre-tokens never cross white space.

    Each distinct word of a batch is encoded once and remembered up to a bound.
    A word of lower-case letters alone is one pre-token and goes straight to
    the BPE model; any other word goes through the whole tokenizer.  A text
    that holds an added token's string, in whatever case, is left to the
    tokenizer as it stands.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if any(SPACE_CHAR.search(t) for t in added):
            raise ValueError("added tokens with white space are not supported")
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.sizes = array("I"), array("i"), array("i")

    def learn(self, words: list[str]) -> None:
        plain, chars, rest = self.model.tokenize, self.byte_chars, []
        slots, flat, starts, sizes = self.slots, self.ids, self.starts, self.sizes
        for w in words:
            if not w.isalpha():
                rest.append(w)
                continue
            if w.isascii() and w.islower():
                found = plain(w)
            elif w.lower() == w and unicodedata.is_normalized("NFC", w):
                found = plain("".join(map(chars.__getitem__, w.encode())))
            else:
                rest.append(w)
                continue
            slots[w] = len(starts)
            starts.append(len(flat))
            sizes.append(len(found))
            flat.extend([t.id for t in found])
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.store(w, e.ids)

    def store(self, word: str, ids: list[int]) -> None:
        self.slots[word] = len(self.starts)
        self.starts.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where those of each text begin and end."""
        if len(texts) == 1 and texts.nbytes > 8 * LONG:  # one very long text, in pieces
            ids = np.concatenate([self._encode(pa.array([p], pa.string()))[0] for p in cut_at_spaces(texts[0].as_py() or "")])
            return ids, np.array([0, len(ids)])
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self.added is not None and pc.any(own := pc.match_substring_regex(texts, self.added)).as_py():
            found, edges = self._by_words(pc.if_else(own, "", texts))
            parts = np.split(found, edges[1:-1])
            for i in np.flatnonzero(own.to_numpy(zero_copy_only=False)).tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return self._by_words(texts)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > self.most:
            self.forget()
        # lowering first merges words, but a combining mark may compose with the small letter alone
        low = pc.if_else(pc.match_substring_regex(texts, r"[\x{0300}-\x{036f}]"), texts, pc.ascii_lower(texts))
        # a letter and a stop after it are pre-tokens of their own, so a space between them changes nothing
        spaced = pc.replace_substring_regex(pc.replace_substring_regex(low, r"([a-z])([.,!]+)", r"\1 \2"), r"[\t\n\r]", " ")
        words = pc.split_pattern(spaced, " ")
        each = pc.list_flatten(words).dictionary_encode()
        distinct = each.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.slots])
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int32, len(distinct))[each.indices.to_numpy()]
        lengths, begins = np.frombuffer(self.sizes, np.int32)[slots], np.frombuffer(self.starts, np.int32)[slots]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        place = np.repeat(begins - ends[:-1], lengths)
        place += np.arange(ends[-1])
        ids = np.frombuffer(self.ids or array("I", [0]), np.uint32)[place]
        return ids, ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        chosen = leaf[:take]
        lengths[: chosen.sum()] += 1
        take = 2 * int((~chosen).sum())
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in the order (length, id); ``bits`` is 0 where an id never occurs."""
    codes = np.zeros(len(bits), np.uint32)
    code, last = 0, 0
    for i in sorted(np.flatnonzero(bits).tolist(), key=lambda i: (bits[i], i)):
        code <<= int(bits[i]) - last
        codes[i], last = code, int(bits[i])
        code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of one block.

    Codes are shorter than a 64-bit word, so each falls into one word or two:
    the parts that begin in a word are joined by one segmented OR, and at most
    one code runs over into the next word.
    """
    if not len(ids):
        return b"", b""
    length = bits[ids].astype(np.int64)
    ends = np.cumsum(length)
    offset = ends - length
    word, room = offset >> 6, 64 - (offset & 63)
    code = codes[ids].astype(np.uint64)
    over = length - room
    split = over > 0
    main = np.where(split, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(main, first)
    at = np.flatnonzero(split)
    out[word[at] + 1] |= code[at] << (64 - over[at]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], offset[::CHECKPOINT].astype("<u8").tobytes()


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window of the longest length: the id that it begins with, and its length."""
    codes, top = canonical_codes(bits), int(bits.max(initial=1))
    ids, lengths = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    for i in np.flatnonzero(bits).tolist():
        free = top - int(bits[i])
        first = int(codes[i]) << free
        ids[first : first + (1 << free)] = i
        lengths[first : first + (1 << free)] = bits[i]
    return ids, lengths, top


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a block; every checkpoint is one lane."""
    ids, lengths, top = table
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits from each byte on
    last = len(words) - 1
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    for k in range(CHECKPOINT if n else 0):
        shift = (32 - top - (at & 7)).astype(np.uint32)
        window = (words[np.minimum(at >> 3, last)] >> shift) & np.uint32((1 << top) - 1)
        out[k] = ids[window]
        at += lengths[window]
    return out.T.reshape(-1)[:n]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, vocab_size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16, max_bits: int = 16) -> None:
    """Write ``codebook`` and ``blocks`` under ``path``."""
    spark = docs.sparkSession
    kind = np.dtype("<u2" if vocab_size <= 1 << 16 else "<u4")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        names = ["part", "block", "offset", "doc_ids", "n_tokens", "ids"]
        doc_ids, sizes, parts, held, offset, block = [], [], [], 0, 0, 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([offset], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())], names)

        end = np.array([end_id], kind).tobytes()
        for batch in sliced(batches, max_bytes=6 << 20):
            ids, edges = encoder.encode(batch.column(1))
            ids, edges = ids.astype(kind), edges.tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), edges, edges[1:], strict=False):
                doc_ids.append(doc)
                sizes.append(b - a + 1)
                parts += (ids[a:b].tobytes(), end)
                held += b - a + 1
                if held >= block_ids:
                    yield close()
                    doc_ids, sizes, parts, offset, held, block = [], [], [], offset + held, 0, block + 1
        if doc_ids:
            yield close()

    raw = written(ordered.mapInArrow(tokenise, "part int, block int, offset long, doc_ids array<long>, n_tokens array<long>, ids binary"), "token-blocks", compression="snappy")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=vocab_size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most vocab_size rows
    bits = np.zeros(vocab_size, np.uint8)
    if counted:
        seen = np.array([r["id"] for r in counted])
        by_id = np.argsort(seen)
        bits[seen[by_id]] = code_lengths(np.array([r["n"] for r in counted])[by_id], max_bits)
    sizes = dict(raw.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n")).collect())  # one row per partition
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    codes = canonical_codes(bits)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                part, ids = row.column(0)[0].as_py(), np.frombuffer(row.column(5)[0].as_py(), kind)
                payload, checkpoints = encode_block(ids, codes, bits)
                yield pa.RecordBatch.from_arrays([*row.columns[:2], pa.array([starts[part] + row.column(2)[0].as_py()], pa.int64()), *row.columns[3:5], pa.array([checkpoints], pa.binary()), pa.array([payload], pa.binary())], ["part", "block", "start", "doc_ids", "n_tokens", "checkpoints", "payload"])

    raw.mapInArrow(compress, "part int, block int, start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, payload binary").write.option("compression", "snappy").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    discard(raw)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids binary (unsigned 32-bit little-endian)."""
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    bits = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        bits[r["id"]] = r["bits"]
    packed = bits.tobytes()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(np.frombuffer(packed, np.uint8))
        for batch in batches:
            for start, doc_ids, sizes, checkpoints, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum(sizes)
                ids = decode_block(payload, checkpoints, int(ends[-1]), table).astype("<u4").tobytes()
                texts = [ids[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema("part int, block int, start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, payload binary").parquet(f"{path}/blocks")
    return blocks.select("start", "doc_ids", "n_tokens", "checkpoints", "payload").mapInArrow(expand, "doc_id long, start long, n_tokens long, ids binary")
