"""Quality, language, token totals, decontamination and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import decontaminate, kneser_ney, language_mix, registry, token_rollups
from granary.llm.common import new_path, read_table

DATA = "/root/testdata/sf0.001"


def plain_kneser_ney(texts):
    """log p(byte | four before) by the textbook, for texts of bytes."""
    n = kneser_ney.ORDER
    counts = {n: Counter()}
    for t in texts:
        padded = b"\n" * (n - 1) + t
        for i in range(len(t)):
            counts[n][padded[i : i + n]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k in range(1, n + 1):
        exact = Counter(counts[k].values())
        y = exact[1] / max(1, exact[1] + 2 * exact[2])
        disc[k] = {i: min(i, max(0.1, (i - (i + 1) * y * exact[i + 1] / exact[i]) if exact[i] else 0.5 * i)) for i in (1, 2, 3)}
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, c in counts[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += disc[k][min(c, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        total, mass = ctx[k].get(g[:-1], (0, 0.0))
        if not total:
            return p(g[1:])
        c = counts[k].get(g, 0)
        return (max(0.0, c - disc[k][min(c, 3)]) / total if c else 0.0) + mass / total * p(g[1:])

    def score(t):
        padded = b"\n" * (n - 1) + t
        return sum(math.log(p(padded[i : i + n])) for i in range(len(t)))

    return score


def fold_of(text):
    """pmod(xxhash64(text), FOLDS) as Spark hashes strings (FOLDS is a power of two)."""
    return xxhash.xxh64_intdigest((text or "").encode(), 42) % kneser_ney.FOLDS


def plain_quality(rows, trusted, quantile=0.985):
    """(id, lang, text) to log perplexity per byte and bound, by models trained on the other folds' trusted texts."""
    out = []
    for lang in {x or "" for _, x, _ in rows}:
        own = [(i, t or "") for i, x, t in rows if (x or "") == lang]
        texts = {f: [t.encode() for i, t in own if i in trusted and fold_of(t) != f] for f in range(kneser_ney.FOLDS)}
        score = {f: plain_kneser_ney(t) if any(t) else None for f, t in texts.items()}
        found = [(i, t, -score[fold_of(t)](t.encode()) / len(t.encode()) if t and score[fold_of(t)] else None) for i, t in own]
        place = lambda values, share: sorted(values)[min(len(values), math.ceil((len(values) + 1) * share)) - 1]
        binned = lambda values, share: (math.floor(place(values, share) * 1000) + 1) / 1000
        held = [(x, len(t.encode())) for i, t, x in found if i in trusted and x is not None]
        middle = binned([x for x, _ in held], 0.5) if held else None
        apart = binned([(x - middle) * math.sqrt(n) for x, n in held], quantile) if held else None
        out += [(i, lang, t, x, middle + apart / math.sqrt(len(t.encode())) if t and held else None) for i, t, x in found]
    return out


@pytest.mark.parametrize("entries", [10**6, 150])
def test_kneser_ney(spark, entries):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "été", "hat"]) for _ in range(30))
    trusted = [(i, "en" if i % 3 else None, prose()) for i in range(24)]
    others = [(100, "en", "the cat ### $$$ zzz qq"), (101, None, "été"), (102, "xx", "no model"), (103, "en", ""), (104, "en", None), (105, "en", prose()), (105, "en", "same id, other text")]
    docs = spark.createDataFrame([*trusted, *others, others[5]], "doc_id long, lang string, text string").withColumn("digest", F.lit(1)).withColumn("threshold", F.lit(0))
    ids = spark.createDataFrame([(i,) for i, _, _ in trusted] + [(None,)], "doc_id long")
    got = kneser_ney.classify(docs, ids, shard_entries=entries).collect()
    told = lambda i, lang, x, bound, kept: (i, lang, None if x is None else round(x, 5), None if bound is None else round(bound, 5), kept)
    plain = plain_quality([*trusted, *others, others[5]], {i for i, _, _ in trusted})
    want = Counter(told(i, lang, x, b, x is None or b is None or x <= b) for i, lang, _, x, b in plain)
    assert Counter(told(r["id"], r["lang"], r["log_ppl"] if r["n_bytes"] else None, r["threshold"], r["kept"]) for r in got) == want
    assert all(r["kept"] for r in got if r["id"] in (102, 103, 104))
    assert not next(r for r in got if r["id"] == 100)["kept"]


def test_models_of_all_folds_share_their_jobs(spark):
    """Plans and jobs fill the driver's memory; small models of four folds need no more of them than those of two."""
    words = ["the", "cat", "sat", "on", "mat"]
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", " ".join(words[(i * k) % 5] for k in range(1, 30)) + str(i)) for i in range(40)], "doc_id long, lang string, text string")
    jobs = {}
    for folds in (2, 4):
        spark.sparkContext.setJobGroup(f"folds-{folds}", "jobs of one run")
        kneser_ney.classify(docs, docs.select("doc_id"), folds=folds).collect()
        jobs[folds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{folds}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] <= jobs[2] + 4, jobs  # a fetch of the model per fold


def test_held_out_trusted_documents_stay(spark):
    """Half of the trusted documents train; of the other half, just as trusted, at most 2 % go in every language."""
    data = "/root/testdata/sf0.1"
    marks = read_table(spark, data, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = kneser_ney.classify(read_table(spark, data, "documents"), marks.filter(half))
    held = got.join(marks.filter(~half).toDF("id"), "id")
    for r in held.groupBy("lang").agg(F.count_if(~F.col("kept")).alias("gone"), F.count(F.lit(1)).alias("n")).collect():
        assert r["n"] > 100 and r["gone"] <= 0.02 * r["n"], r


def test_without_trusted_text_all_stays(spark):
    docs = spark.createDataFrame([(1, "en", "x" * 100)], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert kneser_ney.classify(docs, none).filter("NOT kept").count() == 0
    assert kneser_ney.classify(docs.filter("doc_id = 2"), none).count() == 0


def test_quality_separates_labels(spark):
    data = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r for r in read_table(spark, data, "labels").collect()}
    got = {r["doc_id"]: r["kept"] for r in registry.op1_quality(spark, data).collect()}
    good = [got[i] for i, r in marks.items() if r["quality"] == 1 and r["toxic"] == 0]
    bad = [got[i] for i, r in marks.items() if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.2


def test_rows_of_languages_without_a_model_come_back(spark):
    rows = [(1, "en", "the cat sat on the mat " * 5), (2, "xx", "y" * 100), (2, "xx", "y" * 100), (3, None, "z" * 100), (4, "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for ids in ([(1,)], [(4,)], []):
        got = kneser_ney.classify(docs, spark.createDataFrame(ids, "doc_id long")).collect()
        assert Counter(r["id"] for r in got) == {1: 1, 2: 2, 3: 1, 4: 1} and all(r["kept"] for r in got)
        assert {r["id"]: r["n_bytes"] for r in got} == {1: 115, 2: 100, 3: 100, 4: 0}
        assert all(r["log_ppl"] is None for r in got if r["id"] != 1)


def test_quality_rejects_toxic_and_short_junk(spark):
    data = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r for r in read_table(spark, data, "labels").collect()}
    got = {r["doc_id"]: r for r in registry.op1_quality(spark, data).collect()}

    def rejected(ids):
        ids = list(ids)
        return sum(not got[i]["kept"] for i in ids) / len(ids)

    english = [i for i in marks if got[i]["lang"] == "en" and got[i]["n_bytes"] >= 64]
    assert rejected(i for i in english if marks[i]["quality"] == 1 and marks[i]["toxic"] == 1) > 0.4
    assert rejected(i for i in marks if marks[i]["quality"] == 0 and got[i]["n_bytes"] >= 64) > 0.95
    short = [i for i in marks if 0 < got[i]["n_bytes"] < 64]
    assert rejected(i for i in short if marks[i]["quality"] == 0 or marks[i]["toxic"] == 1) > 0.7
    good = [i for i in marks if marks[i]["quality"] == 1 and marks[i]["toxic"] == 0]
    assert rejected(good) < 0.01


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in read_table(spark, data, "documents").collect()}
    rows = [r for r in registry.op3_language(spark, data).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixtures(spark):
    train = spark.createDataFrame([("aa", "kala tala mala " * 30), ("bb", "zoru poru voru " * 30), (None, "ignored"), ("cc", None)], "lang string, text string")
    langs, table = language_mix.learn(train)
    assert langs == ["aa", "bb"]
    docs = spark.createDataFrame([(1, "kala mala zoru poru kala voru " * 5), (2, None), (3, "12 !"), (4, "KALA tala"), (None, "zoru")], "doc_id long, text string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in language_mix.predict(docs, (langs, table)).collect()}
    assert got[1]["mixture"].keys() == {"aa", "bb"} and abs(got[1]["mixture"]["aa"] - 0.5) < 0.1
    assert (got[2]["lang_pred"], got[2]["score"], got[3]["lang_pred"]) == ("und", 0.0, "und")
    assert (got[4]["lang_pred"], got[None]["lang_pred"]) == ("aa", "bb")
    nothing = language_mix.learn(train.filter("lang = 'zz'"))
    assert {r["lang_pred"] for r in language_mix.predict(docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_mix.learn(train, most_languages=1)


def test_held_out_rule(spark):
    import zlib

    ids = [*range(50), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language_mix.held_out().alias("h")).collect()
    assert all(r["h"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, old_source string")


def test_rollups_are_idempotent(spark):
    rollup = token_rollups.Rollup(spark, new_path(spark, "test-rollup"))
    assert rollup.totals().count() == 0
    first = changes(spark, [("insert", "s", "en", "v1", 10, None, None), ("insert", "s", None, "v1", None, None, None), ("insert", "t", "en", "v1", 5, None, None)])
    assert rollup.apply("1", first) and not rollup.apply("1", first)
    assert rollup.apply("2", changes(spark, [("revise", "s", "en", "v1", 7, 10, None), ("delete", "t", "en", "v1", None, 5, None), ("revise", "u", None, "v1", 0, 0, "s")]))
    assert rollup.committed() == ["1", "2"]
    assert {(r["source"], r["lang"], r["docs"], r["tokens"]) for r in rollup.totals().collect()} == {("s", "en", 1, 7), ("u", None, 1, 0)}


def test_token_totals(spark):
    import tiktoken

    from granary.llm import byte_bpe

    def encoding(name):
        return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(name)), special_tokens={})

    one, two = encoding("byte_bpe_50k.tiktoken"), encoding("byte_bpe_multi_50k.tiktoken")
    rows = sorted(read_table(spark, DATA, "documents").collect(), key=lambda r: r["doc_id"])
    want, seen = Counter(), set()
    for r in rows:
        text = r["text"] or ""
        if text not in seen:
            want[r["source"], r["lang"], "byte_bpe_50k", "docs"] += 1
            want[r["source"], r["lang"], "byte_bpe_50k", "tokens"] += len(one.encode_ordinary(text))
        seen.add(text)
        want[r["source"], r["lang"], "byte_bpe_multi_50k", "docs"] += 1
        want[r["source"], r["lang"], "byte_bpe_multi_50k", "tokens"] += len(two.encode_ordinary(" ".join(x for x in byte_bpe.regex.split("[ \t\r\n]+", text) if x)))
    got = Counter()
    for r in registry.op5_token_counts(spark, DATA).collect():
        for c in ("docs", "tokens"):
            got[r["source"], r["lang"], r["tokenizer"], c] = r[c]
    assert got == want


def plain_distance(pattern, text):
    """Smallest edit distance of the pattern to any substring."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(pattern=st.text(alphabet="abc", min_size=1, max_size=12), text=st.text(alphabet="abc", max_size=40))
def test_bit_parallel_distance(pattern, text):
    limit = len(pattern) + len(text)
    found = decontaminate.best_match(decontaminate.peq(pattern), len(pattern), text, limit)
    assert (found[0] if found else len(pattern)) == plain_distance(pattern, text) or (found is None and not text)


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_all_matches_within_the_budget(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(1, 6)))
    items = tuple(decontaminate.normalise(" ".join(word() for _ in range(rng.randint(3, 15)))) for _ in range(4))
    matcher = decontaminate.Matcher(items, 0.1)
    chars = list(rng.choice(items))
    for _ in range(rng.randint(0, 6)):
        chars[rng.randrange(len(chars))] = rng.choice("abcd ")
    text = decontaminate.normalise(" ".join(word() for _ in range(10)) + "".join(chars) + " ".join(word() for _ in range(10)))
    want = {n: d for n, item in enumerate(items) if (d := plain_distance(item, text)) <= int(0.1 * len(item))}
    found = matcher.matches(text)
    assert {n: d for n, d, _, _ in found} == want
    for n, d, a, b in found:
        assert plain_distance(items[n], text[a:b]) == d


def test_contaminated(spark):
    items = spark.createDataFrame([(1, "The quick brown fox, jumps over the lazy dog again and again."), (2, None), (3, "!!"), (4, "tiny"), (5, "The quick brown fox, jumps over the lazy dog again and again.")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "so the QUICK brown fox jumps\nover the lazy cat again and again it was"), (2, "tinyness"), (3, None), (4, "a tiny one"), (None, "tiny"), (4, "a tiny one")], "doc_id long, text string").withColumn("item", F.lit(1))
    for block in (1, 20_000):
        got = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, items, block_items=block).collect())
        assert got == [(0, 4, 0), (1, 1, 3), (1, 5, 3), (4, 4, 0), (4, 4, 0)]
        assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items, block_items=block).collect()) == [2, 3]
    assert decontaminate.contaminated(docs, items.filter("item_id = 2")).count() == 0
    assert decontaminate.contaminated(docs.filter("doc_id = 99"), items).count() == 0


def test_decontamination_query(spark):
    items = {r["item_id"]: decontaminate.normalise(r["text"] or "") for r in read_table(spark, DATA, "benchmark").collect()}
    docs = {r["doc_id"]: decontaminate.normalise(r["text"] or "") for r in read_table(spark, DATA, "documents").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op10_decontaminate(spark, DATA).filter("distance = 0").collect()}
    assert got == exact


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = read_table(spark, DATA, "documents").select(*C.COLUMNS)
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in C.STAGES[:4]:
        before = docs
        docs = C.written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == C.COLUMNS
        now, was = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in before.collect()}
        assert now and set(now) <= set(was)
        if name != "repeated_passages":
            assert all(was[i] == t for i, t in now.items())
    last = C.token_ids(spark, docs, DATA).collect()
    assert len(last) == docs.count() and all(r["n_tokens"] * 4 == len(r["ids"]) for r in last)
    texts = list(now.values())
    assert len(set(texts)) == len(texts) and len(texts) < len(every)


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as C

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", "en", "s", 4), (None, "text", "en", "s", 4), (3, "x" * 2000, "en", "s", 2000), (3, "x" * 2000, "en", "s", 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, DATA), f"odd-{name}")
    assert sorted((r["doc_id"] or 0) for r in docs.collect())[0] == 0
