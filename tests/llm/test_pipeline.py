"""Each stage of the pipeline against a brute-force version, and on odd rows."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from granary.llm import byte_bpe, decontaminate
from tests.llm.test_duplicates import brute_word_repeats, plain_components
from tests.llm.test_models import plain_distance, plain_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_rows():
    rng = random.Random(12)
    vocabulary = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("en", "abcdeth"), ("de", "uvwxyzs"))}
    prose = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    rows, labels = [], []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append([i, prose(lang, rng.choice([4, 8, 60, 120])), lang, f"s{i % 3}"])
        if i < 40:
            labels.append((i, 1, 0))
    for i in range(60, 70):
        rows.append([i, "".join(rng.choices("#$%&0123456789qjk ", k=rng.choice([20, 400]))), "en", "junk"])
        labels.append((i, 0, 0))
    passage = prose("en", 55)
    items = [(0, prose("en", 20)), (1, prose("de", 25)), (2, None)]
    for i in range(70, 76):
        rows.append([i, f"{prose('en', 30)} {passage} {prose('en', 30)}", "en", "p"])
    for i in range(76, 80):
        near = rows[2 * (i - 76)][1].split()
        if len(near) > 50:
            near[7] = "other"
        rows.append([i, " ".join(near), rows[2 * (i - 76)][2], "copy"])
    for i in range(80, 84):
        held = list(items[i % 2][1])
        for _ in range(i - 80):
            held[rng.randrange(len(held))] = "z"
        rows.append([i, f"{prose('en', 40)} {''.join(held)} {prose('en', 40)}", "en", "leak"])
    rows += [[90, None, "en", "s"], [91, "", "de", "s"], [92, prose("en", 70), None, "s"], [93, prose("de", 70), "xx", "s"]]
    return [(*r, len(r[1] or "")) for r in rows], labels, items


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows, labels, items = made_rows()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, labels, items


def ids(frame):
    return sorted(r["doc_id"] for r in frame.collect())


def test_quality(spark, world):
    path, rows, labels, _ = world
    trusted = {i for i, q, t in labels if q == 1 and t == 0}
    kept = [i for i, _, _, x, bound in plain_quality([(r[0], r[2], r[1]) for r in rows], trusted) if x is None or bound is None or x <= bound]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert ids(C.quality(spark, docs, path)) == sorted(kept) and not {r[0] for r in rows if r[3] == "junk"} <= set(kept)


def test_near_duplicates(spark, world):
    path, rows, _, _ = world
    want = sorted(set(plain_components([r[0] for r in rows], [r[1] for r in rows])))
    assert ids(C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), path)) == want and len(want) < len(rows)


def test_repeated_passages(spark, world):
    path, rows, _, _ = world
    texts = [r[1] or "" for r in rows]
    cut = brute_word_repeats(texts, C.WORDS, True)
    first = {}
    for r in rows:
        first.setdefault(r[1] or "", r[0])
    want = {r[0]: k for r, t, k in zip(rows, texts, cut) if (not t or k == t or k.strip())}
    assert any(k != t for k, t in zip(cut, texts))
    got = {r["doc_id"]: r for r in C.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), path).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_decontamination(spark, world):
    path, rows, _, items = world
    asked = [x for _, t in items if (x := decontaminate.normalise(t or "")) != " "]
    clean = [r[0] for r in rows if all(plain_distance(x, decontaminate.normalise(r[1] or "")) > int(0.08 * len(x)) for x in asked)]
    assert ids(C.benchmark_free(spark, spark.createDataFrame(rows, SCHEMA), path)) == clean and len(clean) < len(rows)


def test_token_ids(spark, world):
    path, rows, _, _ = world
    ranks = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(ranks), special_tokens={})
    got = {r["doc_id"]: r for r in C.token_ids(spark, spark.createDataFrame(rows, SCHEMA), path).collect()}
    for i, text, *_ in rows:
        want = library.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], bytes(got[i]["ids"])) == (len(want), np.array(want, "<u4").tobytes())
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


ODD = [(201, None, None, None, None), (202, "", "en", "s", 0), (None, "text", "en", "s", 4), (None, "text", "en", "s", 4), (203, "x" * 2000, "en", "s", 2000), (203, "x" * 2000, "en", "s", 2000), (203, "another text of the same id", "en", "s", 27), (204, "w " * 300_000, "en", "s", 600_000)]
CLASH = ["digest", "node", "size", "kept", "first", "text_key", "id", "component", "n_copies", "spans", "threshold", "item", "chunk", "ids", "n_tokens"]
#: What stays of ODD, as (id, how many rows): copies of one id and text are one document to stages that drop copies.
STAYS = {"near_duplicates": {None: 1, 201: 1, 203: 2, 204: 1}}
EVERY = {None: 2, 201: 1, 202: 1, 203: 3, 204: 1}


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_odd_rows(spark, world, name):
    """Null ids and texts, repeated rows, one id with two texts, a very long text, columns named like those the stages make, an empty table."""
    stage, path = dict(C.STAGES)[name], world[0]
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *(f"1 AS {c}" for c in CLASH))
    out = stage(spark, docs, path)
    found = {}
    for r in out.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == STAYS.get(name, EVERY)
    assert name == "byte_bpe" or out.columns == C.COLUMNS
    assert stage(spark, docs.filter("doc_id = 99"), path).count() == 0


def test_run(spark, world):
    path = world[0]
    rows = C.run(spark, path).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r[0] for r in world[1]} and len({r["decoded_sha256"] for r in rows}) == len(rows)
