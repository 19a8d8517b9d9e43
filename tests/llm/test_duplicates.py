"""SimHash, components, vectors and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import buckets, graph, itq_dedup, near_copies, registry, simhash, suffix_dedup
from granary.llm.common import read_table

DATA = "/root/testdata/sf0.001"


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aB c \x0b\x1cÉ\n")), max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 80), radius=st.integers(0, 4))
def test_bit_planes(seed, n, radius):
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    fps = np.array([base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for _ in range(n)], np.uint64)
    planes = simhash.Planes(fps, radius)
    for i in range(n):
        assert planes.near(i) == sum(1 << j for j in range(n) if bin(int(fps[i] ^ fps[j])).count("1") <= radius)


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(2, 40))
def test_spanning_links_connect_what_is_connected(seed, n):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    near = [1 << i for i in range(n)]
    for a, b in pairs:
        near[a] |= 1 << b
        near[b] |= 1 << a
    whole = buckets.spanning_links(n, near.__getitem__, [(1 << n) - 1])
    assert union(n, whole) == union(n, pairs) and len(whole) < n
    first = rng.getrandbits(n) | 1
    first &= (1 << n) - 1
    rest = (1 << n) - 1 & ~first
    split = [p for side in (first, rest) for p in buckets.spanning_links(n, lambda i: near[i], [side])]
    split += buckets.spanning_links(n, near.__getitem__, [first, rest])
    assert union(n, split) == union(n, pairs)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(min, groups.values())) == [0, 1000, 2000] and sorted(map(len, groups.values())) == [3, 50, 301]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in read_table(spark, DATA, "documents").collect()}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    roots = union(len(ids), near)
    want = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op9_simhash(spark, DATA).collect()} == want


@pytest.mark.parametrize("tile", [3, 8192])
def test_simhash_links_in_tiles(spark, tile):
    rng = random.Random(3)
    base = rng.getrandbits(62)
    fps = sorted({base ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(25)} | {rng.getrandbits(62) for _ in range(10)})
    found = [(fps.index(r["a"]), fps.index(r["b"])) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=tile).collect()]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert union(len(fps), found) == union(len(fps), near)


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(3, None, 1), (2, "", 2), (None, "a b c d", 3), (7, "a b c d", 4), (7, "a b c d", 4)], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"] or 0, r["component"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 7), (2, 2), (3, 2), (7, 7), (7, 7)]
    assert simhash.near_duplicates(docs.filter("doc_id > 99")).count() == 0


def brute_vectors(x, threshold):
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    return v @ v.T >= threshold


@pytest.mark.parametrize("tile", [16, 2048])
def test_vectors(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    x = np.concatenate([c + rng.standard_normal((n, 64)) * s for c, n, s in zip(centres, [40, 5, *[2] * 20, *[1] * 38], [0.15, 0.2, *[0.2] * 20, *[0] * 38])])
    x = np.concatenate([x, x[:3], x[:1]]).astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [None] * 64), (n + 4, [1.0, 2.0]), (None, x[0].tolist())]
    got = {r["vec_id"]: r for r in itq_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node"), 0.95, tile=tile).collect()}
    near = brute_vectors(x, 0.95)
    degree = near.sum(axis=1) - 1
    told = np.array([got[i]["n_links"] for i in range(n)])
    assert (told <= degree).all() and told.sum() >= 0.9 * degree.sum()
    roots = union(n, list(zip(*np.nonzero(near))))
    assert np.mean([got[i]["component"] == roots[i] for i in range(n)]) > 0.9
    for i in range(n, n + 5):
        assert (got[i]["n_links"], got[i]["component"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["kept"]) == (0, False)


def test_vector_recall_at_the_threshold(spark):
    """Pairs made to lie just over the threshold, the hardest to find."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.952 * a + np.sqrt(1 - 0.952**2) * side
    x = np.concatenate([a, b])
    got = itq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.95)
    assert sum(r["n_links"] for r in got.collect()) >= 0.9 * (brute_vectors(x, 0.95).sum() - len(x))


@pytest.mark.parametrize("common", [1.0, 2.0, 3.0])
def test_vectors_of_a_common_mean(spark, common):
    """Centring leaves less of such vectors, so that their bits flip more often; average cosines of 0.5, 0.8 and 0.9."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(unit(rng.standard_normal((1500, 64))) + common * unit(rng.standard_normal((1, 64))))
    side = rng.standard_normal(a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    x = np.concatenate([a, 0.955 * a + np.sqrt(1 - 0.955**2) * side])
    got = itq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.95)
    degree = brute_vectors(x, 0.95).sum(axis=1) - 1
    told = np.array([r["n_links"] for r in sorted(got.collect(), key=lambda r: r["vec_id"])])
    assert (told <= degree).all() and told.sum() >= 0.96 * degree.sum()


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in itq_dedup.near_duplicates(frame).collect()] == [(1, 0, 1, True)]
    assert itq_dedup.near_duplicates(frame.filter("vec_id = 2")).count() == 0


def brute_repeats(docs, length, keep_first):
    count = {}
    for _, t in docs:
        for p in range(len(t) - length + 1):
            count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
    seen, out = set(), []
    for _, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen if keep_first else count[s] > 1:
                gone[p : p + length] = True
            seen.add(s)
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b"")
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(120), "Same line here. "
    docs = [prose(40) + shared + prose(30) for _ in range(6)] + [prose(20) + shared[100:560] + prose(20) for _ in range(3)]
    docs += [line * 40 + prose(5), prose(3) + line * 60, "a" * 900, "ab" * 300 + prose(10), "a" * 420, prose(200), prose(200)]
    docs += [docs[-1], docs[-1], "", "short", "short", shared, shared[:400]]
    near = docs[15].split(" ")
    docs += [" ".join([*near[:k], "CHANGED", *near[k + 1 :]]) for k in (10, 90, 150)]
    return [t.encode() for t in docs]


@pytest.mark.parametrize("group", [512, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, group, keep_first):
    texts = passages(4)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").selectExpr("*", "1 AS first", "2 AS n")
    found = suffix_dedup.Repeats(frame, 400, keep_first, group=group)
    told = {bytes(r["text_key"]): r for r in found.texts.collect()}
    firsts = {bytes(r["text_key"]): r["first"] for r in found.firsts().collect()}
    want = brute_repeats(docs, 400, keep_first)
    for r in found.members.collect():
        key, text = bytes(r["text_key"]), texts[r["id"]]
        if keep_first and r["id"] != firsts[key] and len(text) >= 400:
            assert want[r["id"]] == b""
        else:
            assert bytes(told[key]["kept"]) == want[r["id"]], r["id"]
            assert told[key]["n_bytes"] == len(text)


def test_repeats_query(spark):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in read_table(spark, DATA, "documents").collect())
    want = {i: hashlib.sha256(k).hexdigest() for (i, _), k in zip(docs, brute_repeats(docs, 400, False))}
    got = registry.op8_suffix_dedup(spark, DATA).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == want
    size = dict(docs)
    assert all(r["n_bytes"] == len(size[r["doc_id"]]) for r in got)


def test_whole_characters_stay(spark):
    texts = ["é" * 300 + "x", "zé" + "é" * 300]
    found = suffix_dedup.Repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 401, whole_chars=True)
    for r in found.texts.collect():
        bytes(r["kept"]).decode()


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.Repeats(empty).texts.count() == 0
    nulls = suffix_dedup.Repeats(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string"))
    assert [(r["n_bytes"], r["n_copies"]) for r in nulls.texts.collect()] == [(0, 2)]
    with pytest.raises(ValueError):
        suffix_dedup.Repeats(empty, 99)


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_components(ids, texts, similarity=0.8):
    sets = [plain_shingles(t) for t in texts]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return [ids[r] for r in union(len(ids), near)]


@pytest.mark.parametrize("tile", [4, 1024])
def test_near_copies_of_five_word_shingles(spark, tile):
    rng = random.Random(5)
    prose = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice("uvwxyz") + str(rng.randrange(30)) for _ in range(n)]
    texts = []
    for size in (40, 120, 300):
        for _ in range(8):
            base = prose(size)
            texts.append(" ".join(base))
            for changes in (1, 2, 4, size // 40):
                near = list(base)
                for _ in range(changes):
                    near[rng.randrange(size)] = "CHANGED"
                texts.append("  ".join(near))
    base = prose(200)
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(20)] + [None, "", " ", "one two", "One TWO", "three"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(frame, tile=tile).collect()}
    want = dict(enumerate(plain_components(range(len(texts)), texts)))
    assert got == want and len(set(want.values())) < 0.6 * len(texts)


def test_pipeline_removes_repeats_of_over_fifty_words(spark):
    import corpus_pipeline as C

    rng = random.Random(7)
    prose = lambda n, most=9: [f"{rng.choice('abcdefgh')}{rng.randrange(10 ** rng.randint(1, most - 1))}" for _ in range(n)]
    tiny = lambda n: [rng.choice("abcdefghijklmnop") for _ in range(n)]
    passages = [prose(51, 6), tiny(51), prose(50, 6), prose(120), tiny(50), prose(52, 30)]
    texts = [" ".join(prose(30) + p + prose(30)) for p in passages for _ in range(3)] + [" ".join(tiny(51) + prose(20))]
    assert len(" ".join(passages[0])) < 400 and len(" ".join(passages[1])) == 101
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in C.repeated_passages(spark, docs, DATA).collect()}
    for i, text in enumerate(texts):
        passage = " ".join(passages[i // 3]) if i < 18 else None
        gone = i % 3 and i < 18 and i // 3 not in (2, 4)
        assert (passage not in got[i] and len(text) - len(got[i]) <= len(passage) + 4) if gone else got[i] == text, i


WORD = re.compile("[\u3000-\U0010ffff]|[^\\x20\\x09-\\x0D\u3000-\U0010ffff]+")


def brute_word_repeats(texts, length, keep_first):
    words = [[m.group() for m in WORD.finditer(t)] for t in texts]
    count, seen, out = {}, set(), []
    for w in words:
        for p in range(len(w) - length + 1):
            count[tuple(w[p : p + length])] = count.get(tuple(w[p : p + length]), 0) + 1
    for t, w in zip(texts, words):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            s = tuple(w[p : p + length])
            if s in seen if keep_first else count[s] > 1:
                gone[p : p + length] = True
            seen.add(s)
        marks, kept, last = [m.span() for m in WORD.finditer(t)], "", 0
        for i in np.flatnonzero(gone).tolist():
            a = marks[i - 1][1] if i and gone[i - 1] else marks[i][0]
            kept, last = kept + t[last:a], marks[i][1]
        out.append(kept + t[last:])
    return out


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aé日。😀 \n\x0b\x1c\u2028\u3000")), max_size=60))
def test_words(text):
    raw = text.encode()
    starts, stops = suffix_dedup.word_marks(raw)
    words = [m.group() for m in WORD.finditer(text)]
    assert [raw[a:b].decode() for a, b in zip(starts, stops)] == words
    symbols = suffix_dedup.word_symbols(raw).tolist()
    assert {w: s for w, s in zip(words, symbols)} == dict(zip(words, symbols)) and len(set(symbols)) == len(set(words))


def test_words_over_segments(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcé日", k=rng.choice([1, 3, 8, 300]))) for _ in range(500)).encode()
    whole = suffix_dedup.word_symbols(text).tolist()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 97)
    assert suffix_dedup.word_symbols(text).tolist() == whole


def test_anchors_over_segments(monkeypatch):
    data = np.random.default_rng(1).integers(0, 200, 20_000).astype(np.uint8)
    at, grams = suffix_dedup.anchors_of(data, 100)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    again = suffix_dedup.anchors_of(data, 100)
    assert at.tolist() == again[0].tolist() and grams.tolist() == again[1].tolist()


@pytest.mark.parametrize("group", [512, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_word_repeats(spark, group, keep_first):
    texts = [t.decode() for t in passages(4)]
    cjk = "".join(random.Random(3).choices("日本語文字列、。", k=90))
    texts += [cjk + " end", "begin " + cjk[:70], texts[0].replace(" ", "\n")]
    found = suffix_dedup.Repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 51, keep_first, unit="word", group=group)
    told = {bytes(r["text_key"]): r for r in found.texts.collect()}
    firsts = {bytes(r["text_key"]): r["first"] for r in found.firsts().collect()}
    want = brute_word_repeats(texts, 51, keep_first)
    for r in found.members.collect():
        key = bytes(r["text_key"])
        if not keep_first or r["id"] == firsts[key]:
            assert bytes(told[key]["kept"]).decode() == want[r["id"]], r["id"]
    found.close()


@pytest.mark.parametrize("length", [101, 250])
def test_shorter_repeats(spark, length):
    docs = list(enumerate(passages(4)))
    found = suffix_dedup.Repeats(spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string"), length, True, group=2)
    told = {bytes(r["text_key"]): r for r in found.texts.collect()}
    firsts = {bytes(r["text_key"]): r["first"] for r in found.firsts().collect()}
    want = brute_repeats(docs, length, True)
    assert all(bytes(told[k := bytes(r["text_key"])]["kept"]) == want[r["id"]] for r in found.members.collect() if r["id"] == firsts[bytes(r["text_key"])])


def test_pipeline_keeps_one_text_of_each_component_if_ids_repeat(spark):
    import corpus_pipeline as C

    rng = random.Random(8)
    one, two, three = (" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(3))
    rows = [(5, one), (5, two), (5, two), (6, two), (3, one), (7, three), (7, three + " more"), (8, three), (9, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"][:200]) for r in C.near_duplicates(spark, docs, DATA).collect())
    assert [i for i, _ in got] == [3, 5, 7] and got[:2] == [(3, one[:200]), (5, two[:200])]
    twice = spark.createDataFrame([(5, one, "en", "s", 0), (5, two, "en", "s", 0)], docs.schema)
    assert {r["text"] for r in C.near_duplicates(spark, twice, DATA).collect()} == {one, two}


def test_pipeline_near_duplicates_against_brute_force(spark):
    import corpus_pipeline as C

    docs = read_table(spark, DATA, "documents").select(*C.COLUMNS)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    ids = [i for i, _ in rows]
    want = sorted(set(plain_components(ids, [t for _, t in rows])))
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, DATA).collect()) == want and len(want) < len(ids)


def test_pipeline_near_duplicates_come_through_simhash(spark, monkeypatch):
    """The stage compares what SimHash groups; the exact check decides."""
    import corpus_pipeline as C

    long, seen, plain = " ".join(f"word{i}" for i in range(400)), [], near_copies.near_copies
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, "quite another text of a few words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def recorded(docs, **more):
        seen.append({r["digest"]: r["component"] for r in more["proposed"].collect()})
        return plain(docs, **more)

    monkeypatch.setattr(near_copies, "near_copies", recorded)
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, DATA).collect()) == [1, 3]
    digest = {r["doc_id"]: r["d"] for r in docs.selectExpr("doc_id", "xxhash64(text) AS d").collect()}
    assert seen[0].keys() == set(digest.values()) and seen[0][digest[1]] == seen[0][digest[2]] != seen[0][digest[3]]
    one_group = spark.createDataFrame([(d, 0) for d in digest.values()], "digest long, component long")
    assert {r["doc_id"]: r["component"] for r in plain(docs, proposed=one_group).collect()} == {1: 1, 2: 1, 3: 3}


def test_pipeline_removes_near_copies(spark):
    """Copies that differ in a word of every hundred, most of them more than two bits apart."""
    import corpus_pipeline as C

    rng = random.Random(6)
    rows = []
    for i in range(0, 60, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows.append((i, " ".join(base), "en", "s", 0))
        base[rng.randrange(200)] = base[rng.randrange(200)] = "other"
        rows.append((i + 1, " ".join(base), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, DATA).collect()) == list(range(0, 60, 2))


def test_longest_previous_factors():
    """Against the definition: the longest string that starts at an earlier position too."""
    rng = random.Random(6)
    for n in (1, 2, 7, 60):
        for letters in ("a", "ab", "abcd"):
            text = "".join(rng.choices(letters, k=n))
            order = sorted(range(n), key=lambda i: text[i:])
            common = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or text[i + k] != text[j + k]), n)
            prefixes = np.array([0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))])
            got = dict(zip(order, suffix_dedup.longest_factors(np.array(order), prefixes).tolist(), strict=True))
            assert got == {i: max((common(i, j) for j in range(i)), default=0) for i in range(n)}
