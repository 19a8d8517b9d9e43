"""Hard negatives, sequenced changes and the pair index against plain versions."""

import datetime
import hashlib
import math
import pathlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import hard_negatives, pair_index, registry, sequenced_changes
from granary.llm.common import read_table

DATA = "/root/testdata/sf0.001"
WORD_BPE = P.path("word_bpe_49k.json")


# ---- pair index


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_pair_index_query(spark, library):
    want = {}
    for r in read_table(spark, DATA, "documents").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.op13_pair_index_bpe(spark, DATA).collect()} == want


PARTS = ["a", "aaaa", "abab", "é", "é", "'s", "'S", "İ", "ß", "Σς", " ", "\n", " ", "　", "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "12", "中文", "🙂‍", "!...", "\x1c", "\x00", "don't", "Hello", "ǅ"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=30).filter(lambda t: t.isprintable()), max_size=20))
def test_pair_index_equals_the_library(library, texts):
    ids, edges = pair_index.encoder(WORD_BPE).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pair_index_of_long_words_and_in_small_runs(library, monkeypatch):
    rng = random.Random(2)
    words = ["a" * 50_000, "ab" * 30_000, "".join(rng.choices("abcdefgh", k=40_000)), *("".join(rng.choices("etaoin", k=rng.randint(1, 12))) for _ in range(500))]
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    merges = pair_index.encoder(WORD_BPE).merges
    assert merges.encode([w.encode() for w in words]) == want
    monkeypatch.setattr(pair_index, "SYMBOLS", 64)
    assert merges.encode([w.encode() for w in words[3:]]) == want[3:]


def test_pair_index_defined_cases(spark, library):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id"), (5, "long words " * 120_000)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS _text")
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in pair_index.encode(docs, WORD_BPE).collect())
    of = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    want = Counter((i, len(of(t or "")) // 4, of(t or "")) for i, t, *_ in map(tuple, docs.collect()))
    assert got == want
    assert pair_index.encode(docs.filter("doc_id = 9"), WORD_BPE).count() == 0
    ids = spark.createDataFrame([(1, None), (2, bytearray(np.array([320, 99_999, 49407], "<u4").tobytes()))], "doc_id long, ids binary")
    assert [r["decoded"] for r in pair_index.decode(ids, WORD_BPE).orderBy("doc_id").collect()] == ["", library.decode([320, 99_999, 49407], skip_special_tokens=False)]
    with pytest.raises(ValueError):
        pair_index.decode(ids.withColumn("decoded", F.lit(1)), WORD_BPE, keep=("decoded",))
    with pytest.raises(ValueError):
        pair_index.encode(ids.withColumn("text", F.lit("")).withColumnRenamed("doc_id", "n_tokens"), WORD_BPE, id_col="n_tokens")
    vocab = {**{c: i for c, i in library.get_vocab().items() if len(c) == 1 or len(c) == 5 and c.endswith("</w>")}, "ab": 600, "abc": 601, "bc": 602}
    spec = {"type": "BPE", "vocab": vocab, "end_of_word_suffix": "</w>"}
    for merges in ([["ab", "c"], ["a", "b"]], [["a", "b"], ["ab", "c"], ["b", "c"], ["a", "bc"]]):  # parts come later; a token made twice
        with pytest.raises(ValueError):
            pair_index.Merges({**spec, "merges": merges})


# ---- hard negatives


def plain_negatives(rows, anchors, k=5):
    """rows: id, label, whole numbers; every pair by loops."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = sorted(((-dot(v, w), j, m) for j, m, w in rows if j != i and len(w) == len(v)))
        positives = [(-s, j) for s, j, m in scored if m == label][:k]
        for p, j in positives:
            found = [(n, -s) for s, n, m in scored if m != label and 80 * p <= 100 * -s <= 100 * p][:k]
            out += [(i, j, r, n, p, s) for r, (n, s) in enumerate(found, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("rows_per_block", "anchors_per_block", "chunk"), [(16384, 1024, 1 << 20), (60, 7, 100)])
def test_hard_negatives_against_plain_loops(spark, monkeypatch, rows_per_block, anchors_per_block, chunk):
    """Many ties, copies of a vector, two dimensions and values beyond what doubles hold exactly."""
    monkeypatch.setattr(hard_negatives, "ROWS", rows_per_block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors_per_block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(4 if i % 5 else 2)]) for i in range(300)]
    rows += [(1000 + i, rng.randrange(2), [1e9 + rng.randrange(3), 0.5]) for i in range(20)]
    odd = [(2001, 1, None), (2002, None, [1.0] * 4), (2003, 1, [1.0, None, 1.0, 1.0]), (2004, 1, [1.0, math.inf, 0.0, 0.0]), (2005, 1, [math.nan] * 4), (None, 1, [1.0] * 4)]
    frame = spark.createDataFrame([*rows, *odd, *rows[:9]], "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS row", "2 AS vec", "3 AS dim")
    found = hard_negatives.mine(hard_negatives.integer_rows(frame, 256.0), F.col("vec_id") % 10 == 0)
    whole = [(i, m, [math.floor(256 * x) for x in v]) for i, m, v in rows]
    limit = (1 << 63) - 1
    want = sorted((*r[:4], min(r[4], limit), min(r[5], limit)) for r in plain_negatives(whole, lambda i: i % 10 == 0))
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == want and len(want) > 300


def test_hard_negatives_of_one_id_and_none(spark):
    schema = "vec_id long, label int, embedding array<double>"
    same = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [2.0]), (5, 2, [1.5])], schema)
    got = hard_negatives.mine(hard_negatives.integer_rows(same, 1.0), F.col("vec_id") == 0).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, 5, 2, 2)] or all(r["negative_id"] == 5 for r in got)
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])]):
        assert hard_negatives.mine(hard_negatives.integer_rows(spark.createDataFrame(rows, schema)), F.col("vec_id") == 0).count() == 0


def test_hard_negatives_query(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(connection.sql(hard_negatives.NEGATIVES_SQL).fetchall())
    assert sorted(map(tuple, registry.op11_hard_negatives(spark, DATA).select(*COLUMNS).collect())) == want and want


# ---- sequenced changes


def plain_changes(rows, batches=10):
    """The contract, row by row."""
    rows = set(rows)
    seqs = defaultdict(set)
    for r in rows:
        seqs[r[1]].add(r[2])
    rank = {c: {s: i for i, s in enumerate(sorted(v, key=lambda x: (x is not None, x or 0)), 1)} for c, v in seqs.items()}
    fed = defaultdict(list)
    for change, client, seq, op, at, _, _, city, balance in rows:
        if at is None or change is None or (h := zlib.crc32(str(change).encode())) % 11 == 0:
            continue
        day = (at.date() - datetime.date(1970, 1, 1)).days + 5 * (h % 4)
        fed[min(batches, 1 + math.floor((day - 19723) * 10 / 160))].append((day, change, client, rank[client][seq], op, city, balance))
    following, held, now, last, out, clock = defaultdict(lambda: 1), defaultdict(dict), {}, {}, [], None

    def apply(c, n, batch):
        _, change, op, city, balance = held[c].pop(n)
        old = now.get(c, (None, None))
        new = {"I": (city, balance), "U": (old[0] if city is None else city, old[1] if balance is None else balance), "D": (None, None)}.get(op, old)
        last[c] = len(out)
        out.append([change, c, "applied", batch, n - following[c], new[0], None if new[1] is None else math.floor(100 * new[1] + 0.5), op != "D"])
        now[c], following[c] = new, n + 1

    for batch in range(1, batches + 2):
        for c in list(held):
            while held[c] and (batch > batches or clock is not None and min(x[0] for x in held[c].values()) + 8 <= clock):
                apply(c, min(held[c]), batch)
                while following[c] in held[c]:
                    apply(c, following[c], batch)
        for day, change, c, n, op, city, balance in sorted(fed[batch], key=lambda x: x[:2]):
            if n in held[c] or n < following[c]:
                out.append([change, c, "rejected", batch, 0, None, None, False])
                continue
            held[c][n] = (day, change, op, city, balance)
            while following[c] in held[c]:
                apply(c, following[c], batch)
        clock = max([x[0] for x in fed[batch]] + ([clock] if clock is not None else []), default=None)
    for i, r in enumerate(out):
        r[7] = r[7] and last.get(r[1]) == i
    return sorted(map(tuple, out), key=repr)


def applied(frame):
    return sorted((tuple(r) for r in frame.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current").collect()), key=repr)


SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def test_changes_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in read_table(spark, DATA, "client_changes").select(*sequenced_changes.COLUMNS).collect()]
    assert applied(registry.op12_sequenced_changes(spark, DATA)) == plain_changes(rows)


def test_changes_of_a_hot_client_with_gaps_and_odd_rows(spark, tmp_path, monkeypatch):
    """One client has most rows and more of them in a batch than a task holds; nulls, copies, unknown operations, empty batches."""
    monkeypatch.setattr(sequenced_changes, "FRESH", 5)
    monkeypatch.setattr(sequenced_changes, "INLINE", 3)
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(260):
        client = rng.choice([7, 7, 7, 7, 1, 2, None])
        day = i // 2 + rng.choice([0, 0, 0, 3, 30]) if i < 200 else rng.randrange(150)
        at = None if i % 40 == 3 else start + datetime.timedelta(days=day, hours=rng.randrange(24))
        rows.append((i, client, None if i % 50 == 7 else i // rng.choice([1, 1, 2]), rng.choice(["I", "U", "U", "U", "D", None, "x"]), at, "s", None, rng.choice(["A", None, "long " * 50]), rng.choice([None, 1.005, -3.5, 12.25])))
    rows = [r for r in rows if r[4] is None or not 60 <= (r[4] - start).days < 95]  # empty batches
    rows += rows[:20] + [(None, 1, 3, "I", start, "s", None, "A", 1.0)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS day").write.parquet(f"{tmp_path}/client_changes.parquet")
    assert applied(registry.op12_sequenced_changes(spark, str(tmp_path))) == plain_changes(rows)


def test_state_stores_are_opened_by_the_stream_alone(spark, monkeypatch):
    """What is held follows from rows and output; each reader of a store would open it again."""
    opened, plain = [], DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, source: (opened.append(source), plain(self, source))[1])
    assert registry.op12_sequenced_changes(spark, DATA).filter("current").count() > 0
    assert "statestore" not in opened


def test_changes_held_after_a_batch(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    held = frame([(1, 4, 10), (1, 5, 11), (None, 2, 12)], "client_id long, n long, day int")
    fed = frame([(1, 4, 20, False), (1, 6, 21, False), (1, 6, 22, True), (None, 3, 23, False), (2, 1, 24, False)], "client_id long, n long, day int, later boolean")
    out = frame([(1, 4), (1, 6), (2, 1), (None, 2)], "client_id long, n long")  # the second 4, the later 6; 1 and 2 are applied
    got = sequenced_changes.waiting(held, fed, out).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 4, 10), (1, 5, 11), (1, 6, 21), (None, 3, 23)], key=repr)


def test_a_commit_of_the_state_writes_what_changed(spark, monkeypatch):
    """A snapshot of a store at its first commit and after ten more, else one file a commit; no checksum files beside them."""
    roots, plain = [], sequenced_changes.new_path
    monkeypatch.setattr(sequenced_changes, "new_path", lambda session, name: (roots.append(plain(session, name)), roots[-1])[1])
    assert registry.op12_sequenced_changes(spark, DATA).filter("current").count() > 0
    files = [f.name for f in pathlib.Path(roots[0].removeprefix("file:"), "checkpoint").rglob("*") if f.is_file() and not f.name.startswith(".")]
    assert {f for f in files if f.endswith(".zip")} == {"1.zip", "11.zip"}
    assert {f"{n}.changelog" for n in range(2, 12)} <= set(files)
    assert not [f for f in files if f.endswith(".crc")]
    assert spark.conf.get(sequenced_changes.MANAGER, None) is None


def test_tables_between_starts_have_a_file_a_core_and_not_a_partition(spark, monkeypatch):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    roots, plain = [], sequenced_changes.new_path
    monkeypatch.setattr(sequenced_changes, "new_path", lambda session, name: (roots.append(plain(session, name)), roots[-1])[1])
    monkeypatch.setattr(sequenced_changes, "stream", None)  # the first start ends it
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        with pytest.raises(TypeError):
            registry.op12_sequenced_changes(spark, DATA)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    parts = [list(part.glob("part-*")) for part in pathlib.Path(roots[0].removeprefix("file:")).glob("*/*") if part.name.startswith(("part=", "rows-1"))]
    assert len(parts) > 5 and all(1 <= len(files) <= cores for files in parts)
    monkeypatch.setattr(sequenced_changes, "TASK_ROWS", 100)
    assert sequenced_changes.tasks_for(spark.range(100 * cores + 101)) == cores + 2


def test_no_changes(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/client_changes.parquet")
    assert registry.op12_sequenced_changes(spark, str(tmp_path)).collect() == []


class Plain:
    """Value and map state in dictionaries, as a stateful processor sees them."""

    class Held:
        def __init__(self, handle):
            self.handle, self.by_key = handle, {}

        def get(self):
            return self.by_key.get(self.handle.key)

        def update(self, value):
            self.by_key[self.handle.key] = value

        def own(self):
            return self.by_key.setdefault(self.handle.key, {})

        def containsKey(self, n):
            return n[0] in self.own()

        def getValue(self, n):
            return self.own().get(n[0])

        def updateValue(self, n, value):
            self.own()[n[0]] = value

        def removeKey(self, n):
            del self.own()[n[0]]

        def iterator(self):
            return iter([((n,), v) for n, v in self.own().items()])

    key = None

    def getValueState(self, *_):
        self.value = Plain.Held(self)
        return self.value

    def getMapState(self, *_):
        return Plain.Held(self)


@pytest.mark.parametrize(("fresh", "inline"), [(20_000, 32), (5, 3), (2, 1), (3, 0)])
def test_changes_in_any_order_and_beyond_the_bounds(fresh, inline):
    """The processor alone: rows of a batch and the clock in any order, more changes than a value or a task holds."""
    start = datetime.datetime(2024, 1, 1)
    for seed in range(8):
        rng, rows = random.Random(seed), []
        for i in range(260):
            day = i // 2 + rng.choice([0, 0, 0, 3, 30]) if i < 200 else rng.randrange(150)
            rows.append((i, rng.choice([7, 7, 7, 1, None]), i // rng.choice([1, 1, 2]), rng.choice(["I", "U", "D", None]), start + datetime.timedelta(days=day, hours=rng.randrange(24)), "s", None, rng.choice(["A", None]), rng.choice([None, 1.005, 12.25])))
        rank = {c: {s: n for n, s in enumerate(sorted({r[2] for r in rows if r[1] == c}), 1)} for c in (7, 1, None)}
        fed = defaultdict(lambda: defaultdict(dict))
        out, clock, handle = [], None, Plain()
        for change, client, seq, op, at, _, _, city, balance in rows:
            h = zlib.crc32(str(change).encode())
            day = (at.date() - datetime.date(1970, 1, 1)).days + 5 * (h % 4)
            batch = min(10, 1 + math.floor((day - 19723) * 10 / 160))
            if h % 11:
                fed[batch][client].setdefault(rank[client][seq], []).append((day, change, op, city, balance))
        applier = sequenced_changes.Applier(fresh, inline)
        applier.init(handle)
        for batch in range(1, 12):
            today = sequenced_changes.END_OF_TIME if batch > 10 else clock
            late = set() if clock is None else {c for c, v in handle.value.by_key.items() if any(x[2] <= today - 8 for x in v[4]) or v[5] > 0 and v[6] <= today - 8}
            for client in {*fed[batch], *late}:
                own = []
                for n, given in fed[batch][client].items():
                    given.sort(key=lambda x: x[:2])
                    own.append(sequenced_changes.Row(n=n, change_id=given[0][1], day=given[0][0], op=given[0][2], city=given[0][3], balance=given[0][4], batch=batch, clock=None))
                    out += [(x[1], client, "rejected", batch, 0, None, None) for x in given[1:]]
                if client in late:
                    own.append(sequenced_changes.Row(n=None, change_id=None, day=None, op=None, city=None, balance=None, batch=batch, clock=today))
                rng.shuffle(own)
                handle.key = client
                told = applier.handleInputRows((client,), iter(own), None)
                out += [(r.change_id, client, r.status, r.batch, r.missed, r.city, None if r.balance is None else math.floor(100 * r.balance + 0.5)) for r in told]
            days = [x[0] for by in fed[batch].values() for given in by.values() for x in given]
            clock = max(days + ([clock] if clock is not None else []), default=None)
        assert sorted(out, key=repr) == sorted((r[:7] for r in plain_changes(rows)), key=repr)
