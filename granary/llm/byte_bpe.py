"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel,
each from its own first character.  Because the pre-token pattern looks only
forward, two chains of pre-tokens agree from the first boundary they share;
neighbouring chunks are stitched at that boundary, and the pieces between
stitches are encoded.  A text of at most one chunk is its own single piece.
A cut stands only behind a character that is no white space: what the pattern
finds there does not depend on what follows, so a piece is pre-tokenised alone
as inside the whole text (a run of white space before the cut would not be).
Decoding concatenates the raw bytes of the ids.

Defined cases: null text is the empty text (no ids); rows repeated with equal
id and text give one output row each; extra input columns are ignored, whatever
their names, and ``decode`` refuses to keep a column named like its result; a
text without a place to cut is followed whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import sliced, texts_of

#: A decision of the pattern at a position reads at most this many characters past the pre-token's end.
LOOKAHEAD = 3


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("granary", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def load_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly join the adjacent pair of lowest rank, leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def encode_piece(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text that begins and ends at pre-token boundaries."""
    try:
        return load_encoding(path, pattern).encode_ordinary(text)
    except BaseException as error:
        if type(error).__name__ != "PanicException":  # the regex engine's stack is too small for some very long runs; the class has no public name
            raise
        ranks = load_ranks(path)
        return [i for m in regex.finditer(pattern, text) for i in merge_piece(m.group().encode(), ranks)]


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens, and the end, as a chain from the first character."""
    return [m.start() for m in regex.finditer(pattern, text)] + [len(text)]


#: White space to Python alone, and not to every engine that runs the pattern.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def cut_among(text: str, shared: list[int]) -> int | None:
    """A shared boundary where the piece before pre-tokenises alone as in the whole text; before a plain space or line end if there is one."""
    safe = [p for p in shared if p and not text[p - 1].isspace() and text[p] not in SEPARATORS]
    return next((p for p in safe if text[p] in " \n"), safe[0] if safe else None)


def stitch(chunks: list[tuple[str, list[int], list[int]]], size: int, pattern: str) -> list[str]:
    """Pieces between resynchronised boundaries.

    ``chunks``: for each chunk its text (with overlap), the boundaries in its
    first overlap and those from ``size`` on, both counted from its own start.
    """
    pieces, text, begin = [], chunks[0][0], 0
    tail = chunks[0][2]
    base = 0  # where ``text`` begins in the document
    for k in range(1, len(chunks)):
        own, head, own_tail = chunks[k]
        start = k * size
        limit = base + len(text) - LOOKAHEAD
        shared = sorted({base + b for b in tail} & {start + b for b in head})
        cut = cut_among(text, [p - base for p in shared if p <= limit])
        if cut is not None:
            pieces.append(text[begin:cut])
            text, base, begin, tail = own, start, cut + base - start, own_tail
        else:  # no such place in the overlap: follow the true chain across both chunks
            text = text[begin:] + own[base + len(text) - start :]
            base, begin = base + begin, 0
            tail = [b for b in boundaries(text, pattern) if base + b >= start + size]
    pieces.append(text[begin:])
    return pieces


def pack(ids: list[int]) -> bytes:
    return pa.array(ids, pa.uint32()).buffers()[1].to_pybytes()[: 4 * len(ids)] if ids else b""


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16384, overlap_chars: int = 512) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` long, ``ids`` binary (unsigned 32-bit little-endian)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out_schema = f"doc_id {id_type}, n_tokens long, ids binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = [encode_piece(t, ranks_path, pattern) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    short = rows.filter(F.char_length("text") <= chunk_chars).mapInArrow(whole, out_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "chunk", "n_chunks", "part"]
        for batch in sliced(batches):
            for doc, text, digest in zip(batch.column(0), texts_of(batch), batch.column(2), strict=True):
                n = max(1, -(-(len(text) - overlap_chars) // chunk_chars))
                parts = [text[k * chunk_chars : (k + 1) * chunk_chars + overlap_chars] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, batch.schema.field(0).type), pa.array([digest.as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), pa.array(parts, pa.string())], names)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            chains = [boundaries(t, pattern) for t in texts_of(batch, "part")]
            heads = pa.array([[b for b in c if b < overlap_chars] for c in chains], pa.list_(pa.int32()))
            tails = pa.array([[b for b in c if b >= chunk_chars] for c in chains], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, heads, tails], [*batch.schema.names, "head", "tail"])

    def join_chunks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        copies = int((group["chunk"] == 0).sum())
        group = group.drop_duplicates("chunk")
        pieces = stitch([(t, list(h), list(b)) for t, h, b in zip(group["part"], group["head"], group["tail"], strict=True)], chunk_chars, pattern)
        ids = [i for p in pieces for i in encode_piece(p, ranks_path, pattern)]
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * copies, "n_tokens": [len(ids)] * copies, "ids": [pack(ids)] * copies})

    chunk_schema = f"doc_id {id_type}, digest long, chunk long, n_chunks long, part string"
    long = (
        rows.filter(F.char_length("text") > chunk_chars)
        .withColumn("digest", F.xxhash64("text"))
        .mapInArrow(cut, chunk_schema)
        .repartition(F.col("doc_id"), F.col("digest"), F.col("chunk"))
        .mapInArrow(pretokenise, f"{chunk_schema}, head array<int>, tail array<int>")
        .groupBy("doc_id", "digest")
        .applyInPandas(join_chunks, out_schema)
    )
    return short.unionByName(long).withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``decoded`` binary: the raw bytes of the ids, concatenated."""
    if "decoded" in (id_col, *keep):
        raise ValueError("the result has a column of its own named decoded")
    rows = encoded.select(id_col, *keep, F.col(ids_col).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = load_bytes(ranks_path)
        for batch in sliced(batches):
            raw = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    return rows.mapInArrow(join_bytes, f"{schema}, decoded binary")
