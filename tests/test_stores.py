"""What is kept between runs: indexes, keyed tables, summaries, followed files; and the trained classifier."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import index, quotes, retrieval, trainer, word_index
from granary.operators.word_index import TrigramIndex, WordIndex
from granary.sources import readers
from granary.streaming import attempts
from granary.streaming.keyed import KeyedTable


def docs_frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def test_a_followed_index_equals_one_built_anew(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices("alpha beta gamma delta eps zeta".split(), k=rng.randint(0, 9)))
    now = {i: text() for i in range(30)}
    queries = spark.createDataFrame([(0, "alpha beta beta"), (1, "zeta nothing"), (2, None)], "query_id long, text string")
    held = WordIndex(spark, str(tmp_path / "index"), buckets=4)
    assert held.apply("1", docs_frame(spark, now)) and not held.apply("1", docs_frame(spark, {99: "alpha"}))

    def equal():
        got = {(r["query_id"], r["doc_id"]): r["bm25"] for r in held.bm25(queries).collect()}
        want = {(r["query_id"], r["doc_id"]): r["bm25"] for r in index.bm25(docs_frame(spark, now), queries).collect()}
        assert got == pytest.approx(want) and want
        assert held.size().head()["n"] == len(now)

    equal()
    new = {i: text() for i in (3, 7, 40)}
    gone = spark.createDataFrame([(5,), (6,), (77,)], "doc_id long")
    write = held.write
    held.write = lambda name, rows, replaces: (rows.write.parquet(f"{held.path}/docs/batch={name}"), (_ for _ in ()).throw(RuntimeError("broken off")))
    with pytest.raises(RuntimeError):
        held.apply("2", docs_frame(spark, new), gone)
    held.write = write
    equal()
    held.apply("2", docs_frame(spark, new), gone)
    now = {i: t for i, t in (now | new).items() if i not in (5, 6)}
    equal()
    assert held.compact("all") and held.batches() == (["all"], ["1", "2", "all"]) and not held.apply("2", docs_frame(spark, {8: "x"}))
    equal()


def test_a_search_reads_the_asked_buckets_only(spark, tmp_path):
    held = WordIndex(spark, str(tmp_path / "index"), buckets=64)
    held.apply("1", docs_frame(spark, {i: f"word{i} common" for i in range(200)}))
    asked = held.asked(spark.createDataFrame([("word7",)], "text string").select(F.explode(held.terms(F.col("text"))).alias("word")), "word")
    plan = held.read("postings", asked)._jdf.queryExecution().executedPlan().toString()
    assert len(asked) == 1 and f"bucket" in plan.split("PartitionFilters")[1].split("]")[0] + "]"
    assert held.read("postings", asked).select("bucket").distinct().count() == 1


def test_substrings_by_their_rarest_runs(spark, tmp_path):
    texts = {1: "The Cat sat", 2: "concatenate", 3: "", 4: None, 5: "ca t", 6: "CAT", 7: "été là"}
    docs = docs_frame(spark, texts)
    held = TrigramIndex(spark, str(tmp_path / "grams"), buckets=4)
    held.apply("1", docs)
    for query in ("cat", "e c", "at", "concaten", "zzz", "ÉTÉ", "t sat"):
        want = sorted(i for i, t in texts.items() if t is not None and query.lower() in t.lower())
        assert sorted(r["doc_id"] for r in held.holding(docs, query).collect()) == want, query


def test_short_and_repeated_quotes(spark):
    passages = {1: "a b c d e f", 2: "the  Cat, sat", 3: "b c d b c d x", 4: "t", 5: None}
    asked = {1: "cat, sat", 2: "T", 3: "b c d b c d", 4: "a b c", 5: "", 6: "zz", 7: ", s", 8: None}
    frame = lambda rows, key: spark.createDataFrame(sorted(rows.items()), f"{key} long, text string")
    flat = lambda t: " ".join((t or "").lower().split())
    want = sorted((i, d) for i, q in asked.items() for d, p in passages.items() if flat(q) and flat(q) in flat(p))
    assert sorted(map(tuple, quotes.quote_matches(frame(asked, "item_id"), frame(passages, "doc_id")).collect())) == want


def test_a_keyed_table_writes_what_changes(spark, tmp_path):
    held, path = KeyedTable(spark, str(tmp_path / "table"), "k", "at", buckets=2, fanout=3), tmp_path / "table"
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    size = lambda name: sum(p.stat().st_size for p in (path / name).rglob("*.parquet"))
    held.fold(frame([(i, 0, f"first value of {i}") for i in range(20_000)]), 0)
    now = {i: (0, f"first value of {i}") for i in range(20_000)}
    for batch in range(1, 8):
        rows = [(i, batch, f"b{batch}") for i in range(batch, 200, 7)]
        held.fold(frame(rows), batch)
        held.fold(frame([(1, 99, "again")]), batch)  # a batch that is repeated changes nothing
        now |= {k: (at, v) for k, at, v in rows}
        assert sum(size(p.name) for p in path.glob("level0-*") if not p.name.endswith("-0-0")) < 0.2 * 20_000 * 20
    assert {r["k"]: (r["at"], r["v"]) for r in held.latest().collect()} == now
    assert len(held.runs()) <= 5 and len(list(path.glob("level*"))) <= 9
    assert sum(first <= b <= last for _, first, last in held.runs() for b in range(8)) == 8


def test_a_summary_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "model_alias string, status string")
    rows = [("m", s) for s in ("accepted", "rejected", "error", "skipped", "accepted")] + [("n", "skipped")]
    for i, r in enumerate(rows):
        frame([r]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: attempts.follow(spark, str(tmp_path / "in"), "model_alias string, status string", "parquet", 1)
    args = (str(tmp_path / "out"), str(tmp_path / "checkpoint"), "model_alias")
    real, calls = attempts.folders, []

    def broken(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("broken off")
        return real(*a, **k)

    monkeypatch.setattr(attempts, "folders", broken)
    with pytest.raises(Exception, match="broken off"):
        attempts.summarise(stream(), *args).awaitTermination()
    monkeypatch.undo()
    attempts.summarise(stream(), *args).awaitTermination()
    got = {r["model_alias"]: (r["accepted"], r["rejected"], r["errors"], r["skipped"], r["attempts"]) for r in attempts.summary(spark, args[0]).collect()}
    assert got == {"m": (2, 1, 1, 1, 4), "n": (0, 0, 0, 1, 0)} and len(list((tmp_path / "out").glob("after=*"))) <= 3


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) if i % 3 else "" for i in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "b.txt").write_text("one\r\n\r\nthree\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.numbered(spark.read.text(str(tmp_path / "*.txt")), "line")
        assert rows.rdd.getNumPartitions() > 1
        got = readers.numbered_lines(spark, str(tmp_path / "a.txt")).collect()
        assert [r["value"] for r in sorted(got, key=lambda r: r["line"])] == texts and sorted(r["line"] for r in got) == list(range(400))
        assert [r["value"] for r in readers.numbered_lines(spark, str(tmp_path / "b.txt")).orderBy("line").collect()] == ["one", "", "three"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_gradient_and_a_trained_classifier(spark):
    rng = np.random.default_rng(1)
    model = rng.standard_normal((3, 9))
    at = [np.sort(rng.choice(8, size=n, replace=False)).astype(np.int32) for n in (3, 0, 5, 1)]
    x = [rng.standard_normal(len(a)) for a in at]
    y, w = np.array([0, 2, 1, 2]), np.array([1.0, 0.5, 2.0, 3.0])

    def loss(m):
        total = 0.0
        for a, v, label, weight in zip(at, x, y, w):
            s = m[:, a] @ v + m[:, -1]
            total -= weight * (s[label] - np.log(np.exp(s).sum()))
        return total

    got, value = trainer.gradient(model, y, w, at, x)
    plain = np.zeros_like(model)
    for i in np.ndindex(model.shape):
        step = np.zeros_like(model)
        step[i] = 1e-6
        plain[i] = (loss(model + step) - loss(model - step)) / 2e-6
    assert value == pytest.approx(loss(model)) and got == pytest.approx(plain, abs=1e-6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = trainer.train(docs, held, features=1 << 11, epochs=4)
    told = trainer.predict(found, docs.filter(held), "doc_id", "label").filter("label IS NOT NULL").toPandas()
    majority = told["label"].value_counts(normalize=True).iloc[0]
    classes = told["label"].nunique()
    assert found.epochs[found.best - 1]["macro_f1"] == max(e["macro_f1"] for e in found.epochs)
    assert found.epochs[found.best - 1]["macro_f1"] > 2 * majority / (1 + majority) / classes + 0.2
    assert (told["label"] == told["label_pred"]).mean() == pytest.approx(found.epochs[found.best - 1]["accuracy"])


def shuffled(spark, work):
    """Records that ``work`` shuffles."""
    store, new = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def told():
        rows = store.stageList(None, False, False, new, None)
        return sum(rows.apply(i).shuffleWriteRecords() for i in range(rows.size()))

    before = told()
    work()
    return told() - before


def test_an_index_is_built_without_shuffling_its_postings(spark, tmp_path):
    rng = random.Random(6)
    texts = {i: " ".join(rng.sample([f"w{k}" for k in range(60)], 50)) for i in range(300)}
    held = WordIndex(spark, str(tmp_path / "index"), buckets=2)
    assert shuffled(spark, lambda: held.apply("1", docs_frame(spark, texts))) < 300 * 50 / 4
    assert shuffled(spark, lambda: held.compact("all")) < 300 * 50 / 4
    assert held.read("words").agg(F.sum("df")).head()[0] == 300 * 50


def test_the_best_of_an_index_without_its_pairs(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randint(0, 40)))
    held, asked = WordIndex(spark, str(tmp_path / "index"), buckets=3), {i: text() for i in range(40)} | {90: None, 91: "absent"}
    held.apply("1", docs_frame(spark, {i: text() for i in range(300)}))
    held.apply("2", docs_frame(spark, {i: text() for i in range(0, 300, 4)}), spark.createDataFrame([(i,) for i in range(0, 300, 7)], "doc_id long"))
    queries = spark.createDataFrame(sorted(asked.items()), "query_id long, text string")
    rows = lambda found, score: {(r["query_id"], r["rank"]): (r["doc_id"], pytest.approx(r[score])) for r in found.collect()}
    want = rows(retrieval.ranked(held.bm25(queries), 5, "bm25"), "bm25")
    found = []
    records = shuffled(spark, lambda: found.append(rows(retrieval.ranked(held.best(queries, 5), 5), "score")))
    assert found == [want] and len(want) == 200
    assert records < 300 * 30 + 2 * 2000  # postings, not pairs times words


def test_trigrams_are_not_shuffled(spark, tmp_path):
    rng = random.Random(7)
    texts = {i: "".join(rng.choices("abcdef ", k=400)) + " Ünï𝄞code" for i in range(200)}
    held = TrigramIndex(spark, str(tmp_path / "grams"), buckets=2)
    assert shuffled(spark, lambda: held.apply("1", docs_frame(spark, texts))) < 200 * 150 / 4
    for query in ("ï𝄞C", "abc", "f a"):
        want = sorted(i for i, t in texts.items() if query.lower() in t.lower())
        assert sorted(r["doc_id"] for r in held.holding(docs_frame(spark, texts), query).collect()) == want


def test_runs_are_packed_and_follow_their_batches(spark, tmp_path):
    """Runs and their documents lie in bytes, not in arrays; odd characters, no text, no id; documents change and go."""
    rng = random.Random(3)
    made = lambda: "".join(rng.choices("ab Ü𝄞\n", k=rng.choice([0, 2, 30])))
    texts = {i: made() for i in range(60)} | {60: None, 61: "".join(map(chr, range(0x4E00, 0x4E40)))}
    held = TrigramIndex(spark, str(tmp_path / "grams"), buckets=2)
    held.apply("1", docs_frame(spark, texts).unionByName(spark.createDataFrame([(None, "abab")], "doc_id long, text string")))
    assert dict(held.read("docs").dtypes)["words"] == dict(held.read("postings").dtypes)["docs"] == "binary"
    texts |= {i: made() for i in range(0, 60, 4)}
    held.apply("2", docs_frame(spark, {i: texts[i] for i in range(0, 60, 4)}), spark.createDataFrame([(7,), (61,)], "doc_id long"))
    live = {i: t for i, t in texts.items() if i not in (7, 61)}
    for query in ("ab ", "ü𝄞A", "\u4e03\u4e04\u4e05"):
        want = sorted(i for i, t in live.items() if query.lower() in (t or "").lower())
        assert sorted(r["doc_id"] for r in held.holding(docs_frame(spark, texts), query).collect()) == want


def test_runs_of_few_and_many_characters():
    """One number per text and run, or two where they do not fit."""
    for texts in (["abcabc", "", "xyz", "aaaa"], ["".join(map(chr, range(0x100, 0xD800))), "".join(map(chr, range(0xE000, 0x110000))), "ab", *[""] * 7]):
        values, bounds = word_index.distinct_runs(texts)
        for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
            assert values[a:b].tolist() == sorted({ord(x) << 42 | ord(y) << 21 | ord(z) for x, y, z in zip(t, t[1:], t[2:], strict=False)})


def test_vectors_in_slices_equal_plain_ones(spark, monkeypatch):
    """Texts are taken a bounded number of words at a time, across rows without words."""
    monkeypatch.setattr(trainer, "SLICE", 7)
    texts = ["a b a", "", None, "c " * 30, "b", "?", "a c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string").coalesce(1)
    got = {r["k"]: (r["at"], r["x"]) for r in trainer.vectorised(rows, 64, "k").collect()}
    for k, w in ((r["k"], r["w"]) for r in trainer.hashed_words(rows, 64, "k").collect()):
        places, n = np.unique(np.array(w, np.int64), return_counts=True)
        assert got[k][0] == places.tolist() and got[k][1] == pytest.approx((n / max(1.0, np.sqrt((n * n).sum()))).tolist())
    found = trainer.train(rows.select("text", F.when(F.col("k") < 3, "x").otherwise("y").alias("label")), F.lit(False), features=64, epochs=2)
    told = trainer.predict(found, rows, "k").collect()
    assert len(told) == len(texts) and all(0 < r["confidence"] <= 1 for r in told)
