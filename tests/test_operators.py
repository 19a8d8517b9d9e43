"""Edge cases of the operators on small tables."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import nested, text, vectors
from granary.operators import arrays, cards, chunking, ensemble, index, layout, metrics, models, profile, retrieval, review, scoring, splits
from granary.sources import readers, sinks
from granary.streaming import attempts


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("r")).head()["r"]


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize(("n", "starts"), [(0, []), (39, []), (40, [0]), (350, [0, 270]), (351, [0, 270]), (620, [0, 270, 540])])
def test_chunk_ladder(spark, n, starts):
    docs = spark.createDataFrame([(1, words(n))], "doc_id long, text string")
    assert [r["start"] for r in chunking.chunk_words(docs).orderBy("start").collect()] == starts


def test_chunks_of_null_text_and_overlap_over_size(spark):
    docs = spark.createDataFrame([(1, None), (2, words(45))], "doc_id long, text string")
    rows = chunking.chunk_words(docs, size=44, overlap=50).orderBy("start").collect()
    assert [r["start"] for r in rows] == [0, 1, 2, 3, 4, 5]


def test_chunk_numbers_run_through_a_source(spark):
    docs = spark.createDataFrame([(1, "A", words(360)), (2, "A", words(50)), (3, "B", words(40))], "doc_id long, source string, text string")
    rows = chunking.number_chunks(chunking.chunk_words(docs), "source", "doc_id").orderBy("source", "doc_id", "start").collect()
    assert [r["chunk_id"] for r in rows] == ["A_CHUNK_0001", "A_CHUNK_0002", "A_CHUNK_0003", "B_CHUNK_0001"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 900))
def test_chunks_cover_all_words(spark, n):
    docs = spark.createDataFrame([(1, words(n))], "doc_id long, text string")
    seen = {w for r in chunking.chunk_words(docs, least=1).collect() for w in r["chunk"].split()}
    assert seen == set(words(n).split())


def test_tokens_and_space(spark):
    assert one(spark, text.tokens, "Ça d'Été, 9x") == ["ça", "d'été", "9x"]
    assert one(spark, text.tokens, "a × b ÷") == ["a", "×", "b", "÷"]  # the range of letters holds both signs
    assert one(spark, text.normalize_space, " a \n b\x1cc ") == "a b c"
    assert one(spark, text.normalize_space, None) == ""
    assert one(spark, text.slug, "--") == "item"
    assert one(spark, text.year_of, "report 1899-2024") == 2024
    assert one(spark, lambda x: text.definition_of(x), "x EDOS definition:  y z ") == "y z"
    assert one(spark, text.strip_control, "a\x00b\x1f") == "ab"


@pytest.mark.parametrize(("quote", "passage", "hit"), [("A  b", "x a B y", True), ("", "x", False), ("a-b c d e", "a b, c d e f", True), ("a-b c", "a b c", False)])
def test_quotes(spark, quote, passage, hit):
    row = spark.createDataFrame([(quote, passage)], "q string, p string").select(text.quote_in_passage("q", "p").alias("r")).head()
    assert row["r"] is hit


def test_keyword_overlap_counts_multiplicity(spark):
    row = spark.createDataFrame([("a b",)], "x string").select(text.keyword_overlap("x", ["a a", "c"]).alias("r"), text.keyword_overlap("x", []).alias("n")).head()
    assert (round(row["r"], 9), row["n"]) == (round(2 / 3, 9), 0.0)


def library(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bm25_by_hand(spark):
    docs = library(spark, [(1, "a b"), (2, "a a a"), (3, "")])
    queries = spark.createDataFrame([(1, "a zz"), (2, None)], "query_id long, text string")
    got = {r["doc_id"]: r["bm25"] for r in index.bm25(docs, queries).collect()}
    idf, avg = math.log((3 - 2 + 0.5) / 2.5 + 1), 5 / 3
    assert got.keys() == {1, 2}
    assert got[1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)))
    assert index.bm25(docs, queries, idf_mode="floored").count() == 2
    with pytest.raises(ValueError):
        index.bm25(docs, queries, idf_mode="x")


def test_empty_library_and_unknown_words(spark):
    empty = library(spark, [])
    queries = spark.createDataFrame([(1, "zz")], "query_id long, text string")
    assert index.basic(empty, queries).count() == 0
    assert retrieval.ranked(index.with_zeros(index.basic(empty, queries), empty, queries, 3), 3).count() == 0
    docs = library(spark, [(i, "a bb") for i in range(9)])
    got = retrieval.ranked(index.with_zeros(index.basic(docs, queries), docs, queries, 3), 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_zeros_fill_the_places_that_are_left(spark):
    docs = library(spark, [(1, "xx yy"), (2, "cc dd"), (3, "ee ff"), (4, "aa bb"), (5, "gg hh")])
    queries = spark.createDataFrame([(1, "aa bb cc"), (2, None)], "query_id long, text string")
    got = retrieval.ranked(index.with_zeros(index.tfidf(docs, queries), docs, queries, 4), 4, "tfidf").orderBy("query_id", "rank").collect()
    assert [r["doc_id"] for r in got] == [4, 2, 1, 3, 1, 2, 3, 4]


@pytest.mark.parametrize(("batch", "block", "waiting"), [(256, 256, 1 << 18), (7, 2, 4)])
def test_scores_by_document_against_pairs(spark, monkeypatch, batch, block, waiting):
    """The same ranking as from rows of all pairs, of which only a few per query and task leave the pass."""
    for name, value in (("BATCH", batch), ("ASKED_BLOCK", block), ("WAITING", waiting)):
        monkeypatch.setattr(scoring, name, value)
    _, _, docs, queries = random_cards(spark, 60)
    docs, told = docs.select("doc_id", "text"), lambda df, score: [(r["query_id"], r["rank"], r["doc_id"], round(r[score], 9)) for r in retrieval.ranked(df, 5, score).orderBy("query_id", "rank").collect()]
    for found, pairs, score in (
        (scoring.bm25_best(docs, queries, 5), index.bm25(docs, queries), "bm25"),
        (scoring.tfidf_best(docs, queries, 5), index.with_zeros(index.tfidf(docs, queries), docs, queries, 5), "tfidf"),
        (scoring.basic_best(docs, queries, 5), index.with_zeros(index.basic(docs, queries), docs, queries, 5), "score"),
    ):
        assert told(found, "score") == told(pairs, score)
        assert found.count() <= 4 * 5 * found.rdd.getNumPartitions() < 4 * 60
    empty = library(spark, [])
    assert scoring.basic_best(empty, queries, 3).count() == scoring.bm25_best(empty, queries, 3).count() == 0


def plain_tfidf(texts):
    """Unit vectors by word and word pair."""
    import re
    from collections import Counter

    each = [Counter((w := re.findall(r"\b\w\w+\b", t.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:])]) for t in texts]
    df = Counter(g for c in each for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    unit = lambda c: {g: n * idf[g] / (math.sqrt(sum((m * idf[x]) ** 2 for x, m in c.items() if x in idf)) or 1) for g, n in c.items() if g in idf}
    return [unit(c) for c in each], lambda t: unit(Counter((w := re.findall(r"\b\w\w+\b", t.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:])]))


def random_cards(spark, n):
    pick = random.Random(5)
    texts = [" ".join(pick.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=pick.randint(0, 12))) for _ in range(n)]
    rows = [(i, t, pick.choice(["s1", "s2", None]), pick.choice(["p", "q"]), pick.choice([[], ["p"]]), pick.choice([[], ["alpha", "mu"]]), pick.random()) for i, t in enumerate(texts)]
    asked = [(0, "alpha beta beta", "p"), (1, "zzz", "q"), (2, "kappa iota theta eta", None), (3, None, "q")]
    return rows, asked, spark.createDataFrame(rows, "doc_id long, text string, source_id string, primary string, secondary array<string>, keywords array<string>, quality double"), spark.createDataFrame(asked, "query_id long, text string, label string")


def all_pairs(scores):
    return scores.pairs(scores.asked.select("query_id"))


@pytest.mark.parametrize("block", [4096, 1])
@pytest.mark.parametrize("query_block", [1024, 2])
def test_whole_library_mmr_against_plain_loops(spark, monkeypatch, block, query_block):
    """The same choice whatever the sizes of the blocks; some blocks are empty."""
    monkeypatch.setattr(retrieval, "CARD_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", query_block)
    rows, asked, cards, queries = random_cards(spark, 40)
    vectors, vector_of = plain_tfidf([r[1] for r in rows])
    cosine = lambda a, b: sum(x * b.get(g, 0.0) for g, x in a.items())
    want = {}
    for q, text_, _ in asked:
        rel, chosen = [cosine(vector_of(text_ or ""), v) for v in vectors], []
        while len(chosen) < 6:
            gains = [(round(0.7 * rel[i] - 0.3 * max((cosine(vectors[i], vectors[j]) for j in chosen), default=0.0), 9), -i) for i in range(len(rows)) if i not in chosen]
            chosen.append(-max(gains)[1])
        want[q] = chosen
    library, got = index.Tfidf(cards.select("doc_id", "text")), {}
    scores = library.scores(queries).withColumnRenamed("tfidf", "score")
    for r in retrieval.lexical_mmr(scores, queries, library, 6, 0.7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want
    if block == 1:
        return
    given = spark.createDataFrame([(0, 7, 0.9), (0, 8, 0.5), (1, 3, 0.1)], "query_id long, doc_id long, similarity double")
    first = {r["query_id"]: (r["doc_id"], r["breakdown"]) for r in retrieval.retrieve("dense_mmr", cards, queries, 1, semantic=given).collect()}
    assert first[0] == (7, {"semantic_similarity": 0.9, "mmr_selected_rank": 1.0}) and (first[1][0], first[2][0]) == (3, 0)


@pytest.mark.parametrize("leaders", [1, 64])
def test_whole_library_selection_stores_no_row_per_word(spark, monkeypatch, leaders):
    """Whatever is settled among the leaders, the choice is that of plain loops; copies tie; blocks and parts of the words are many."""
    tables = {}

    def watched(df, label):
        out = layout.stored(df, label)
        tables[label] = max(tables.get(label, 0), out.count())
        return out

    for module in (index, retrieval, scoring):
        monkeypatch.setattr(module, "stored", watched)
    monkeypatch.setattr(retrieval, "LEADERS", leaders)
    monkeypatch.setattr(retrieval, "PIECE", 7)
    monkeypatch.setattr(index, "BLOCK_WORDS", 40)
    monkeypatch.setattr(index, "ROW_WORDS", 3)
    rows = [f"w{i % 7} w{i % 5} common w{i % 3} x{i // 4} tail" for i in range(40)] + ["", None, "common w1"]
    asked = ["w1 w2 common", "tail x3 x4", "nothing here", "w6 w6 x1"]
    cards = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    vectors, vector_of = plain_tfidf([r or "" for r in rows])
    cosine = lambda a, b: sum(x * b.get(g, 0.0) for g, x in a.items())
    want = {}
    for q, text_ in enumerate(asked):
        rel, chosen = [cosine(vector_of(text_), v) for v in vectors], []
        while len(chosen) < 4:
            gains = [(round(0.7 * rel[i] - 0.3 * max((cosine(vectors[i], vectors[j]) for j in chosen), default=0.0), 9), -i) for i in range(len(rows)) if i not in chosen]
            chosen.append(-max(gains)[1])
        want[q] = chosen
    got = {}
    for r in retrieval.lexical_mmr(None, queries, index.Tfidf(cards), 4, 0.7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want
    assert "tfidf-norms" in tables and not {"tfidf-counts", "mmr-vectors"} & set(tables)
    assert all(n <= len(rows) for label, n in tables.items() if label not in ("tfidf-parts", "mmr-lead"))


@pytest.mark.parametrize("leaders", [2, 64])
def test_given_relevances_store_no_vectors(spark, monkeypatch, leaders):
    """Given relevances of some documents, negative ones too: the choice of plain loops, and no row of a document and a word."""
    tables = []
    for module in (index, retrieval, scoring):
        monkeypatch.setattr(module, "stored", lambda df, label: tables.append(label) or layout.stored(df, label))
    monkeypatch.setattr(retrieval, "LEADERS", leaders)
    rows = [f"aa{i % 4} bb{i % 3} same words" for i in range(20)]
    cards = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "q"), (1, "q"), (2, "q")], "query_id long, text string")
    told = {(0, i): 0.9 - i / 40 for i in range(12)} | {(1, 5): 0.4, (1, 6): -0.2, (1, 9): 0.1}
    given = spark.createDataFrame([(q, i, x) for (q, i), x in told.items()], "query_id long, doc_id long, score double")
    vectors, _ = plain_tfidf(rows)
    cosine = lambda a, b: sum(x * b.get(g, 0.0) for g, x in a.items())
    want, got = {}, {}
    for q in range(3):
        chosen = []
        while len(chosen) < 4:
            gains = [(round(0.7 * told.get((q, i), 0.0) - 0.3 * max((cosine(vectors[i], vectors[j]) for j in chosen), default=0.0), 9), -i) for i in range(len(rows)) if i not in chosen]
            chosen.append(-max(gains)[1])
        want[q] = chosen
    for r in retrieval.lexical_mmr(given, queries, index.Tfidf(cards), 4, 0.7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want and not {"tfidf-counts", "mmr-vectors"} & set(tables)


def test_portfolio_by_steps_keeps_words_of_scored_cards_alone(spark, monkeypatch):
    tables = {}

    def watched(df, label):
        out = layout.stored(df, label)
        tables[label] = max(tables.get(label, 0), out.count())
        return out

    monkeypatch.setattr(retrieval, "stored", watched)
    monkeypatch.setattr(retrieval, "PIECE", 2)
    cards = spark.createDataFrame([(i, f"w{i} w{i % 2} same") for i in range(30)], "doc_id long, text string")
    scores = spark.createDataFrame([(q, i, f"s{i % 3}", 0.9 - i / 100) for q in (0, 1) for i in range(6)], "query_id long, doc_id long, source_id string, score double")
    picks = retrieval.portfolio_by_steps(scores, cards, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in picks] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert tables["card-words"] == 6 and "card-rows" not in tables


def test_numbers_in_few_bytes():
    for values in ([], [0], [1, 255], [1, 256, 0], [2**63, 2**64 - 1, 5]):
        found = np.array(values, np.uint64)
        assert arrays.regrown(arrays.shrunk(found)).tolist() == values


@pytest.mark.parametrize("rounds", [(64, 1024), (5, 12), (5,), ()])
def test_portfolio_against_plain_loops(spark, rounds):
    """The same choice whatever the number of leaders, and by steps over all rows."""
    rows, asked, cards, queries = random_cards(spark, 60)
    scores = {(r["query_id"], r["doc_id"]): r for r in all_pairs(retrieval.card_scores(cards, queries)).collect()}
    assert len(scores) == len(rows) * len(asked)
    words = [set(r[1].split()) for r in rows]
    want = {}
    for q, _, _ in asked:
        chosen, counts = [], {}
        while len(chosen) < 5:
            best = None
            for i, row in enumerate(rows):
                source = row[2] or "UNKNOWN"
                if i in chosen or counts.get(source, 0) >= 2:
                    continue
                near = max((len(words[i] & words[j]) / max(1, len(words[i] | words[j])) for j in chosen), default=0.0)
                adjusted = round(scores[q, i]["score"] + (0 if counts.get(source) else 0.08) - 0.15 * near, 9)
                best = max(best or (-9, 0), (adjusted, -i))
            chosen.append(-best[1])
            source = rows[-best[1]][2] or "UNKNOWN"
            counts[source] = counts.get(source, 0) + 1
        want[q] = chosen
    picks = retrieval.portfolio(retrieval.card_scores(cards, queries), cards, rounds=rounds).orderBy("query_id", "rank").collect()
    got = {}
    for r in picks:
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want
    if len(rounds) != 2:
        return
    for r in retrieval.retrieve("card_aware", cards, queries, 5).collect():
        parts = r["breakdown"]
        assert set(parts) == {*retrieval.WEIGHTS, "portfolio_adjusted_score"}
        assert r["score"] == pytest.approx(sum(w * parts[n] for n, w in retrieval.WEIGHTS.items()))
    with pytest.raises(ValueError):
        retrieval.card_scores(cards, queries, {"primary_match": 1.0})


def test_pairs_below_the_floor_are_never_chosen(spark):
    """Steps see only what can be chosen: fewer rows than pairs of a query and a card, and the same choice."""
    rows = [(i, f"w{i} w{i + 1}", f"s{i % 7}", "p" if i % 3 else "q", [], ["w1"], (i % 10) / 10) for i in range(60)]
    cards = spark.createDataFrame(rows, "doc_id long, text string, source_id string, primary string, secondary array<string>, keywords array<string>, quality double")
    queries = spark.createDataFrame([(0, "w5 w6", "p")], "query_id long, text string, label string")
    scores = retrieval.card_scores(cards, queries)
    lead, _ = scores.leaders(queries.select("query_id"), 20)
    floors = retrieval.reachable(lead, 5, 0.08, 0.15)
    few, every = scores.pairs(queries, floors), scores.pairs(queries)
    assert few.count() < every.count() == 60
    chosen = lambda pairs: [r["doc_id"] for r in retrieval.portfolio_by_steps(pairs, cards).orderBy("rank").collect()]
    assert chosen(few) == chosen(every)


def test_published_score_arithmetic():
    parts = {"lexical_similarity": 0.5927067523942996, "semantic_similarity": 0.18541350478859916, "keyword_overlap": 0.25, "validation_quality": 0.35}
    score = sum(retrieval.WEIGHTS[k] * v for k, v in parts.items())
    assert score == pytest.approx(0.2673947266760097, abs=1e-12)
    assert 0.5 * 0.18541350478859916 + 0.5 == pytest.approx(0.5927067523942996, abs=1e-12)


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, vec array<double>")


def test_mmr_limits(spark):
    items = vectors_frame(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])])
    q = spark.createDataFrame([(0, [1.0, 0.2])], "query_id int, vec array<double>")
    pool = retrieval.dense_topk(items, q, 3)
    pure = [r["item_id"] for r in retrieval.mmr(pool, 5, 1.0).orderBy("rank").collect()]
    assert pure == [r["item_id"] for r in pool.orderBy("candidate_rank").collect()]
    assert [r["item_id"] for r in retrieval.mmr(pool, 2, 0.0).orderBy("rank").collect()][1] == 3
    for bad in ((0, 5, 0.5), (5, 4, 0.5), (1, 1, 1.5)):
        with pytest.raises(ValueError):
            retrieval.check_arguments(*bad)


def test_portfolio_caps_sources_and_stops(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    scores = spark.createDataFrame([(0, i, 1.0 - i / 10, "s1" if i < 4 else None) for i in range(6)], "query_id int, doc_id long, score double, source_id string")
    picks = retrieval.portfolio_by_steps(scores, docs, k=6, per_source=1).orderBy("rank").collect()
    assert [(r["doc_id"], r["source_id"]) for r in picks] == [(0, "s1"), (4, "UNKNOWN")]


def test_methods(spark):
    with pytest.raises(ValueError):
        retrieval.retrieve("x", None, None)


def test_quality_default(spark):
    row = spark.createDataFrame([(None, 5.0)], "a double, b double").select(retrieval.validation_quality(F.col("a")).alias("d"), retrieval.validation_quality(F.col("a"), F.col("b")).alias("q")).head()
    assert (row["d"], row["q"]) == (0.35, 1.0)


def voters(spark, votes, fallback=7):
    def frame(v):
        return spark.createDataFrame([(1, v, [float(i) for i in range(11)])], "id int, pred_id int, probs array<double>")

    frames = {f"m{i}": frame(v) for i, v in enumerate(votes)} | {"f": frame(fallback)}
    return ensemble.vote(ensemble.aligned(frames, "id"), [f"m{i}" for i in range(len(votes))], "f").head()


@pytest.mark.parametrize(("votes", "pred", "tie"), [((1, 1, 1, 1), 1, False), ((1, 1, 1, 2), 1, False), ((1, 1, 2, 2), 7, True), ((1, 1, 2, 3), 1, False), ((1, 2, 3, 4), 7, True), ((1, 2), 7, True)])
def test_votes(spark, votes, pred, tie):
    row = voters(spark, votes)
    assert (row["pred_id"], row["used_fallback"], row["confidence"]) == (pred, tie, float(pred))
    back = voters(spark, votes[::-1])
    assert (back["pred_id"], back["used_fallback"]) == (pred, tie)


def test_alignment_is_asserted(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    with pytest.raises(ValueError):
        ensemble.aligned({"a": a, "b": a.filter("id = 1")}, "id")
    with pytest.raises(ValueError):
        ensemble.aligned({"a": a, "b": a.withColumn("text", F.lit("z"))}, "id", ("text",))
    with pytest.raises(ValueError):
        ensemble.exact_cover(a, a.filter("id = 2"), "id")
    assert ensemble.exact_cover(a.select("id"), a, "id").count() == 2


def test_metrics_corner_cases(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "gold string, pred string")
    report = {r["label"]: r for r in metrics.class_report(rows).collect()}
    assert report["c"]["precision"] == 0.0 and report["c"]["f1"] == 0.0 and report["c"]["support"] == 0
    summary = metrics.f1_summary(rows).head()
    assert summary["accuracy"] == pytest.approx(2 / 3) and summary["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert metrics.averages(metrics.class_report(rows)).count() == 2
    labels = spark.createDataFrame([("a",), ("z",)], "label string")
    assert [r["label"] for r in metrics.missing_classes(rows, labels, "gold").collect()] == ["z"]
    with pytest.raises(ValueError, match="classes without a row"):
        metrics.class_weights(rows, "gold", labels)


@pytest.mark.parametrize(("decision", "f", "a", "u", "ok"), [("Accepted", None, None, None, True), (" REJECTed", "5", "5", "5", False), ("", "4", "4", "3.5", True), (None, "4", "4", "", False), ("", "4", "x", "5", False), ("maybe", "4", "3.9", "5", False)])
def test_acceptance(spark, decision, f, a, u, ok):
    row = spark.createDataFrame([(decision, f, a, u)], "d string, f string, a string, u string").select(review.accepted("d", "f", "a", "u").alias("r")).head()
    assert row["r"] is ok


def test_dedupe_is_idempotent_and_judges_the_first(spark):
    rows = spark.createDataFrame([(1, "k", "bad"), (2, "k", "long enough"), (3, "m", "long enough")], "ord int, key string, quote string")
    valid = F.length("quote") >= 10
    once = cards.dedupe_cards(rows, [F.col("key")], "ord", valid)
    assert [r["ord"] for r in once.collect()] == [3]
    assert cards.dedupe_cards(once, [F.col("key")], "ord", valid).collect() == once.collect()


def test_passages_fall_back_to_the_first(spark):
    passages = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 3, "z")], "passage_id int, ord int, text string")
    labels = spark.createDataFrame([("l", ["nothing"]), ("m", ["y"])], "label string, terms array<string>")
    got = sorted((r["label"], r["passage_id"]) for r in cards.select_passages(passages, labels, 2).collect())
    assert got == [("l", 1), ("l", 2), ("m", 2)]


def test_label_checks(spark):
    tax = spark.createDataFrame([(0, "a", 0, "p")], "label_id int, label string, parent_id int, parent string")
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    with pytest.raises(ValueError):
        splits.with_label_ids(rows, tax)
    assert splits.with_label_ids(rows, tax, check=False).filter("label_id IS NULL").count() == 1
    with pytest.raises(ValueError):
        splits.require(rows, "text")
    corpus = spark.createDataFrame([("t", "sexist", "a", "test", 1)], "text string, label_sexist string, label string, split string, ord int")
    assert splits.test_slice(corpus, 1).count() == 1
    with pytest.raises(ValueError):
        splits.test_slice(corpus, 970)


def test_assembled_cards(spark):
    rows = spark.createDataFrame([("1", "1.1 threats of harm", "a chunk", " why ", "An argument here", "d"), ("2", "l", "c", "", "x", "d")], "card_id string, label string, chunk string, reasoning string, argument string, definition string")
    made = {r["card_id"]: r for r in cards.assemble_cards(rows).collect()}
    assert made["1"]["error"] is None and made["1"]["keywords"] == ["1.1 threats of harm", "threats", "harm", "argument"]
    assert made["2"]["error"] == "missing reasoning"
    blank = spark.createDataFrame([(1, "", "S", "1.1 threats"), (2, "x", "S", "1.1 threats")], "ord int, card_id string, source_id string, primary_label string")
    assert [r["card_id"] for r in cards.ensure_card_ids(blank).orderBy("ord").collect()] == ["S_1_1_001", "x"]
    lacking = spark.createDataFrame([("", "b", " ")], "a string, b string, c string").select(cards.missing_fields({"ab": ["a", "b"], "c": ["c"]}).alias("m")).head()
    assert lacking["m"] == ["c"]


def test_schema_errors(spark):
    rules = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string", "minLength": 10}, "n": {"type": ["integer", "null"]}, "s": {"type": "number"}}}
    check = lambda value: one(spark, lambda x: nested.schema_errors(x, rules), value)
    assert check('{"a": "long enough", "n": 2021.0, "s": 1.5}') == []
    assert check('{"a": "long enough", "n": null}') == []
    assert check("not json") == ["$: not JSON"]
    assert check('{"b": 1}') == ["$: a is required", "$: unknown b"]
    assert check('{"a": "short", "n": 1.5, "s": true}') == ["$.a: minLength", "$.n: type", "$.s: type"]


def test_literals_and_objects(spark):
    assert json.loads(one(spark, nested.literal_json, "{'a': None, 'b': [True, 'x']}")) == {"a": None, "b": [True, "x"]}
    assert one(spark, nested.literal_json, "{oops") is None
    assert one(spark, lambda x: F.to_json(nested.json_object(x)), 'noise {"a":1} noise') == '{"a":1}'
    assert one(spark, lambda x: nested.json_object(x).isNull(), "[1]")


def test_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1000.0, 1000.0])], "z array<double>, big array<double>").select(vectors.unit("z").alias("u"), vectors.softmax("big").alias("s"), vectors.argmax("big").alias("a")).head()
    assert (row["u"], row["s"], row["a"]) == ([0.0, 0.0], [0.5, 0.5], 0)


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, n int")
    assert profile.distinct_ratio(empty, "a").head()["ratio"] == 0.0
    assert profile.duplicates(empty, "a").head()["duplicate_rows"] == 0
    assert profile.schema_profile(empty).count() == 2
    assert profile.describe(empty, "n").head()["count"] == 0
    assert profile.search(empty, "a", "x").count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", "é"), ("a", None)], "card_id string, note string")
    sinks.jsonl(rows, str(tmp_path / "x.jsonl"))
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl"), "card_id string, note string").count() == 2
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "card_id string").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"card_id": "a"}\n\n{oops\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "card_id string", strict=True).collect()
    (tmp_path / "lines.jsonl").write_text('{"text": "a"}\n\n{"id": "k", "text": "b"}\n')
    assert sorted((r["instance_id"], r["text"]) for r in readers.jsonl_by_line(spark, str(tmp_path / "lines.jsonl"), "text string").collect()) == [("0", "a"), ("k", "b")]
    (tmp_path / "keyed.json").write_text('{"1": {"HATE_SPEECH": "x"}, "2": 5, "3": {"HATE_SPEECH": "y"}}')
    assert sorted(r["instance_id"] for r in readers.keyed_json(spark, str(tmp_path / "keyed.json"), "HATE_SPEECH string").collect()) == ["1", "3"]
    assert readers.strict_corpus(spark, str(tmp_path / "keyed.json")).count() == 2
    (tmp_path / "list.json").write_text('[{"text": "a"}, {"id": 7, "text": "b"}]')
    assert sorted(r["instance_id"] for r in readers.json_list(spark, str(tmp_path / "list.json"), "text string").collect()) == ["0", "7"]
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    assert readers.yaml_config(spark, str(tmp_path / "c.yaml")) == {"a": [1, 2]}
    (tmp_path / "p.csv").write_text("text,label\nx,1\ny,2\n")
    assert sorted(r["instance_id"] for r in readers.csv_with_ids(spark, str(tmp_path / "p.csv")).collect()) == ["0", "1"]
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "p.csv"), "missing")
    assert len(readers.fingerprint(spark, str(tmp_path / "p.csv"))) == 64
    assert readers.readiness(spark, {str(tmp_path / "p.csv"): ("text", "z"), str(tmp_path / "no.csv"): ("a",)}).count() == 2
    sinks.upsert_csv(spark, str(tmp_path / "sheet"), rows, ["card_id"])
    sinks.upsert_csv(spark, str(tmp_path / "sheet"), spark.createDataFrame([("a", "new", "1")], "card_id string, note string, extra string"), ["card_id"])
    assert {r["card_id"]: r["note"] for r in readers.annotations(spark, str(tmp_path / "sheet")).collect()} == {"a": "new", "b": "é"}
    sinks.label_maps(spark.createDataFrame([("l", 0)], "label string, label_id int"), str(tmp_path / "labels.json"))
    assert json.loads((tmp_path / "labels.json").read_text())["label2id"] == {"l": 0}
    for name in ("B 1999.pdf", "a.PDF", "c.txt"):
        (tmp_path / name).write_text(name)
    assert [(r["source_id"], r["year"]) for r in readers.files(spark, str(tmp_path)).select("source_id", "year").collect()] == [("A", None), ("B_1999", 1999)]
    assert one(spark, readers.parsed_html, "<p>a <script>x</script><b>b</b></p>") == "a b"
    broken = "<title>a &amp; b&amp</title><p>&lt;c&gt; &eacute; &amp;lt; &nbsp;d &lt"
    assert one(spark, readers.parsed_html_closed, broken) == one(spark, text.html_text, broken) == "a & b&amp <c> &eacute; &lt; d &lt"
    assert one(spark, text.html_text, "<p>a <script>x</script><b>b</b></p>") == "a b"


def test_sheets_hold_texts_as_they_are(spark, tmp_path):
    import csv
    import random

    rng = random.Random(5)
    odd = [None, "", " ", "\n", "\r\n", "\x00", '"\x00', 'a"\x00b', "  lead", "trail\t", "a\r", "a\rb", '"', '""', '","', "a\\", '\\"', "#a", "\ufeffa", "a\u0085", "null"]
    odd += ["".join(rng.choice('",\n\r\\ \tab\x00é#') for _ in range(rng.randint(1, 8))) for _ in range(500)]
    rows = [(str(i), text, rng.choice(["en", "", None, " e\r"])) for i, text in enumerate(odd)]
    sinks.csv(spark.createDataFrame(rows, "key string, text string, lang string").repartition(3), str(tmp_path / "sheet"))
    got = readers.csv(spark, str(tmp_path / "sheet"), "key", "text", keep_empty=True)
    assert sorted(map(tuple, got.collect()), key=lambda r: int(r[0])) == rows
    assert readers.csv(spark, str(tmp_path / "sheet"), "text").filter("text = ''").isEmpty()
    plain = {r[0]: r[1] for p in (tmp_path / "sheet").glob("*.csv") for r in csv.reader(p.open(newline=""))}  # other readers see the same texts
    assert all(plain[key] == (text or "") for key, text, _ in rows)


def test_cards_need_unique_ids(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text('{"card_id": "same"}\n')
    with pytest.raises(ValueError):
        readers.cards(spark, {"m": str(tmp_path / "a.jsonl"), "n": str(tmp_path / "b.jsonl")})
    assert readers.cards(spark, {"m": str(tmp_path / "a.jsonl")}).count() == 1
    assert readers.single_card(spark, str(tmp_path / "a.jsonl")).count() == 1


def test_resuming_twice_does_nothing(spark):
    plan = spark.createDataFrame([("l", 1), ("l", 2)], "label string, chunk int")
    log = spark.createDataFrame([("l", 1, "error")], "label string, chunk int, status string")
    assert attempts.remaining(plan, log, "label", "chunk").count() == 1
    assert attempts.all_attempted(plan, plan, "label", "chunk")
    assert attempts.may_resume(None, "x") and not attempts.may_resume("y", "x")


def test_models(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [len(r["embedding"]) for r in models.embed(rows, models.hash_embedder(8)).collect()] == [8, 8]
    assert models.classify(rows, models.hash_embedder(3)).filter(F.size("probs") == 3).count() == 2
    made = models.generate(rows.select(F.coalesce("text", F.lit("")).alias("prompt")), models.echo_generator())
    assert made.filter("error IS NULL").count() == 2

    def broken():
        def fail(_):
            raise ValueError("no")

        return fail

    failed = models.route(models.generate(rows.select(F.lit("p").alias("prompt")), broken, retries=1, back_off=0.0), F.lit(False))
    assert [r["status"] for r in failed.collect()] == ["error", "error"]
    specs = [{"alias": "a"}, {"alias": "b", "enabled": False}]
    assert [s["alias"] for s in models.select_models(specs)] == ["a"] and models.select_models(specs, ["b"])
    with pytest.raises(ValueError):
        models.select_models(specs, ["c"])


# Published confusion matrices (rows gold, columns predicted) with their accuracy, macro and weighted F1.
PUBLISHED = [
    ([[73, 10, 5, 1], [12, 346, 84, 12], [8, 97, 216, 12], [4, 22, 16, 52]], (0.7082474226804124, 0.699642701254964, 0.7063626754734937)),
    (
        [
            [10, 5, 0, 0, 1, 0, 0, 0, 0, 0, 0], [2, 57, 0, 7, 2, 3, 0, 0, 0, 0, 2], [0, 0, 113, 20, 10, 2, 37, 4, 0, 3, 16], [2, 6, 15, 116, 6, 39, 2, 0, 0, 1, 5],
            [0, 1, 8, 4, 28, 6, 7, 3, 0, 0, 0], [1, 4, 5, 43, 4, 123, 0, 1, 0, 0, 1], [1, 0, 32, 3, 2, 2, 68, 1, 3, 1, 6], [0, 0, 3, 0, 3, 2, 4, 6, 0, 0, 0],
            [0, 0, 4, 0, 1, 0, 4, 0, 1, 0, 4], [0, 3, 3, 2, 0, 0, 1, 0, 0, 11, 1], [0, 2, 10, 3, 0, 2, 7, 0, 0, 0, 49],
        ],
        (0.6, 0.5413706383283265, 0.5968118791151259),
    ),
]


@pytest.mark.parametrize(("matrix", "figures"), PUBLISHED)
def test_published_metrics(spark, matrix, figures):
    cells = [(g, p, n) for g, row in enumerate(matrix) for p, n in enumerate(row) if n]
    rows = spark.createDataFrame(cells, "gold int, pred int, n int").select("gold", "pred", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    got = metrics.f1_summary(rows).head()
    assert (got["accuracy"], got["macro_f1"], got["weighted_f1"]) == pytest.approx(figures, abs=1e-12) and got["n"] == 970
    grid = {(r["gold"], r["pred"]): r["n"] for r in metrics.confusion(rows, spark.range(len(matrix)).select(F.col("id").cast("int").alias("label"))).collect()}
    assert [[grid[g, p] for p in range(len(matrix))] for g in range(len(matrix))] == matrix


def test_mock_cards(spark):
    passages = spark.createDataFrame([("1.2 incitement and encouragement of harm", 1, words(30), 7)], "label string, rank long, text string, passage_id int")
    row = cards.mock_cards(passages, F.lit("d")).head()
    assert row["card_id"] == "MOCK_1_2_incitement_and_encouragement_of_harm_001"
    assert row["keywords"] == ["and", "encouragement", "harm", "incitement"]
    assert row["source_quote"] == words(28)


def test_normalized_cards(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"card_id": "1", "source": {"source_id": ""}, "claim": " a \n b", "keywords": [" B", "a", "b", " "], "validation": None}) + "\n")
    row = cards.normalize_cards(readers.jsonl(spark, str(tmp_path / "c.jsonl"), readers.CARD_SCHEMA)).head()
    assert (row["status"], row["claim"], row["keywords"], row["secondary_labels"]) == ("candidate", "a b", ["a", "b"], [])
    assert (row["source"]["source_id"], row["validation"]["status"]) == ("UNKNOWN", "not_validated")


def test_generic_votes(spark):
    def frame(label, confidence):
        return spark.createDataFrame([(1, label, confidence)], "id int, label string, confidence double")

    def voted(*labels):
        frames = {f"m{i}": frame(x, i / 10) for i, x in enumerate(labels)} | {"f": frame("F", 0.9)}
        return ensemble.vote_generic(ensemble.aligned(frames, "id"), [f"m{i}" for i in range(len(labels))], "f").head()

    assert (voted("a", "a", "b")["label_pred"], voted("a", "a", "b")["confidence"]) == ("a", 0.2)
    assert (voted("a", "b")["label_pred"], voted("a", "b")["confidence"], voted("a", "b")["used_fallback"]) == ("F", 0.9, True)
    assert voted("a", "a", "b", "b")["used_fallback"] and not voted("a", "b", "a", "c")["used_fallback"]


def test_splits(spark):
    corpus = spark.createDataFrame([("t1", "sexist", "a\nb", "train", 1), ("d", "sexist", "a", "dev", 2), ("n", "not", "a", "train", 3), (" ", "sexist", "a", "train", 4)], "text string, label_sexist string, label string, split string, ord int")
    more = spark.createDataFrame([("g", "a", 1)], "text string, label string, ord int")
    got = [(r["part"], r["piece"], r["text"], r["label"]) for r in splits.build_splits(corpus, more).orderBy("part", "piece").collect()]
    assert got == [("dev", 0, "d", "a"), ("train", 0, "t1", "a b"), ("train", 1, "g", "a"), ("train", 2, "d", "a")]
    assert splits.build_splits(corpus, None, dev_in_train=False).filter("part = 'train'").count() == 1


def test_review_defaults_and_upsert(spark):
    old = spark.createDataFrame([("b", "x", 1)], "card_id string, note string, at int")
    new = spark.createDataFrame([("b", "y", 2, "e"), ("a", "z", 1, "e")], "card_id string, note string, at int, extra string")
    merged = {r["card_id"]: (r["note"], r["extra"]) for r in review.upsert(old, new, "card_id", "at").collect()}
    assert merged == {"b": ("y", "e"), "a": ("z", "e")}
    assert review.arranged(merged and new, ["note"]).columns == ["note", "at", "card_id", "extra"]
    with pytest.raises(ValueError):
        review.annotated_state(old, new, "x")
    assert review.progress(old, new).head()["ratio"] == 1.0
    assert review.progress(old.filter("at > 9"), new).head()["ratio"] == 0.0


def test_turns_and_data(spark):
    raw = spark.createDataFrame([("k", "{'data': [{'speaker': 'A', 'text': 'x'}, {'speaker': 'B', 'text': None}]}"), ("n", "broken {")], "id string, raw string")
    kind = "array<struct<speaker:string,text:string>>"
    listed = raw.select("id", nested.data_turns(nested.literal_json("raw"), kind).alias("data"))
    assert [(r["id"], r["turn_number"], r["speaker"]) for r in profile.turns(listed, "id", "data").orderBy("turn_number").collect()] == [("k", 1, "A"), ("k", 2, "B")]


def test_display_and_fallback_objects(spark):
    row = spark.createDataFrame([(["a", "b"], None)], "l array<string>, s string").select(text.display(F.col("l"), "array<string>").alias("l"), text.display(F.col("s"), "string").alias("s"), text.display(F.struct("s"), "struct<s:string>").alias("o")).head()
    assert (row["l"], row["s"], row["o"]) == ("a; b", "", "{}")
    fallback = lambda x: F.to_json(nested.json_object_or(x, F.struct(x.alias("raw"))))
    assert json.loads(one(spark, fallback, "plain words")) == {"raw": "plain words"}
    assert json.loads(one(spark, fallback, 'x {"a": 2} y')) == {"a": 2}


def test_prediction_frames(spark):
    tax = spark.createDataFrame([(0, "a"), (1, "b")], "label_id int, label string")
    probs = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], "row_id int, probs array<double>")
    got = {r["row_id"]: r for r in ensemble.prediction_frame(probs, tax, ["prob_0", "prob_1"]).collect()}
    assert [(got[i]["label_pred"], got[i]["confidence"], got[i]["prob_1"]) for i in (1, 2)] == [("a", 0.5, 0.5), ("b", 0.9, 0.9)]


def test_records_and_uploads(spark, tmp_path):
    rows = readers.jsonl_from_text(spark, '{"card_id": "a"}\n\n{"card_id": "b"}\n', "card_id string")
    assert rows.count() == 2
    made = rows.selectExpr("card_id", "'h' AS hate_speech", "'l' AS label", "'s' AS strategy", "'en' AS language", "'c' AS claim", "'m' AS model", "'{\"counterspeech\": \" hi \"}' AS output")
    record = models.generation_record(made).head()
    assert (record["generation"]["counterspeech"], record["generation"]["notes"]) == ("hi", "")
    sinks.annotation_tables(rows.selectExpr("card_id", "'a\u0007b' AS note"), rows.groupBy().count(), str(tmp_path / "book"))
    assert spark.read.parquet(str(tmp_path / "book" / "annotations")).head()["note"] == "ab"
    (tmp_path / "x.pdf").write_text("no pdf")
    with pytest.raises(Exception):
        readers.pdf_pages(readers.files(spark, str(tmp_path))).collect()


def test_linear_stand_in(spark):
    rows = spark.createDataFrame([("good fine nice", 0), ("bad awful poor", 1)] * 10, "text string, label_id int")
    model = models.linear_classifier(rows)
    assert model.transform(rows).filter("prediction = label_id").count() == 20


def test_selected_passages_are_fetched_without_shuffling_texts(spark):
    """Only the few selected rows are sent; repeated and absent words and İ count as before."""
    passages = spark.createDataFrame([(i, i, t) for i, t in enumerate(["The the of", "x of", None, "nothing", "İn Of"])], "passage_id long, ord long, text string")
    labels = spark.createDataFrame([("a", ["the of", "The"]), ("b", ["absent"]), ("c", [])], "label string, terms array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cards.select_passages(passages, labels, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["label"], r["rank"], r["passage_id"], round(r["score"], 4), r["text"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", 1, 0, 1.0, "The the of"), ("a", 2, 1, 0.3333, "x of"), ("b", 1, 0, 0.0, "The the of"), ("b", 2, 1, 0.0, "x of"), ("c", 1, 0, 0.0, "The the of"), ("c", 2, 1, 0.0, "x of")]
    assert "SortMergeJoin" not in plan and "array_intersect" in plan


def test_models_are_fed_few_rows_and_keep_the_others_columns(spark):
    """Rows pass as Arrow: a long beside a null stays exact, and no more than a few rows are objects at once."""
    rows = spark.createDataFrame([(2**53 + 1, "a b"), (None, None), (3, "b")], "id long, text string")
    assert sorted(str(r["id"]) for r in models.embed(rows, models.hash_embedder(4)).collect()) == ["3", str(2**53 + 1), "None"]
    assert sorted(str(r["id"]) for r in models.classify(rows, models.hash_embedder(4)).collect()) == ["3", str(2**53 + 1), "None"]
    out = models.generate(rows.withColumn("prompt", F.coalesce("text", F.lit("none"))), models.echo_generator(), back_off=0.0).collect()
    assert sorted(str(r["id"]) for r in out) == ["3", str(2**53 + 1), "None"] and all(r["error"] is None for r in out)

    def factory():
        return lambda texts: [[float(len(texts))] for _ in texts]

    told = models.embed(spark.range(300, numPartitions=1).select("id", F.lit("t").alias("text")), factory, batch=50).collect()
    assert {r["embedding"][0] for r in told} == {50.0} and len(told) == 300
