"""Chat windows against a plain statement of the rules."""

import hashlib
import re

import duckdb
import pytest

from granary.llm import chat_windows as C

TURNS = [
    (1, 0, "system", "be brief & kind"), (1, 1, "user", "hello there <|im_end|> you"), (1, 2, "assistant", "hi <|"), (1, 3, "user", "tell me " + "more " * 30), (1, 4, "assistant", "ok " * 12), (1, 5, "assistant", "&lt;| &amp;"), (1, 6, "user", "x"), (1, 7, "assistant", ""),
    (2, 0, "user", None), (2, 0, "user", None), (2, 1, None, "role is null"), (2, 2, "assi\nstant", "odd role"),
    (3, 0, "system", "alone"), (4, 0, "assistant", "first"), (4, 1, "system", "late system"), (None, None, "assistant", "no id"),
]


def esc(t):
    return t.replace("&", "&amp;").replace("<|", "&lt;|")


def plain(turns, budget, history):
    """Windows by the rules: (text, [(formatted, repeated, target text or None)])."""
    rows = [(r or "", t or "") for _, _, r, t in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
    made = [f"<|im_start|>{esc(r).replace(chr(10), '&#10;')}\n{esc(t)}<|im_end|>\n" for r, t in rows]
    tokens = [len(re.findall(C.TOKEN, m)) for m in made]
    lead = bool(rows) and rows[0][0] == "system"
    s = tokens[0] if lead else 0
    stride = max(1, (budget - s) // 2)
    windows, last, prefix, runs, before = [], None, 0, 0, []
    for i in range(lead, len(rows)):
        prefix += tokens[i]
        before.append((i, prefix - tokens[i]))
        own = tokens[i] > stride
        runs += own
        key = (own, runs, 0 if own else (prefix - 1) // stride)
        if key != last:
            windows.append([])
            last = key
        windows[-1].append((i, prefix - tokens[i]))
    if not windows:
        windows = [[]]
    out = []
    for w, new in enumerate(windows):
        items = [(0, w > 0)] if lead else []
        if new and w:
            room = max(0, min(history, budget - s - sum(tokens[i] for i, _ in new)))
            items += [(i, True) for i, p in before if i < new[0][0] and p >= new[0][1] - room]
        items += [(i, False) for i, _ in new]
        assert len(new) < 2 or s + sum(tokens[i] for i, _ in new) <= budget
        out.append(("".join(made[i] for i, _ in items), [rows[i] for i, again in items if not again], "".join(rows[i][1] for i, again in items if not again and rows[i][0] == "assistant")))
    return out


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 20), (40, 0), (1, 5)])
def test_windows(spark, budget, history):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "'x' AS body")
    windows = C.format_windows(frame, budget, history)
    texts = {(r["conv_id"], r["window"]): r["text"] for r in windows.collect()}
    read = {(r["conv_id"], r["window"]): r for r in C.read_turns(windows).collect()}
    digests = {r["conv_id"]: r for r in C.digests(windows).collect()}
    for conv in {t[0] for t in TURNS}:
        own = [t for t in TURNS if t[0] == conv]
        want = plain(own, budget, history)
        assert [texts[conv, w] for w in range(len(want))] == [x[0] for x in want]
        assert [[(p["role"], p["text"]) for p in read[conv, w]["parsed"]] for w in range(len(want))] == [x[1] for x in want]
        loss = "".join(x[2] for x in want)
        told = "".join(f"{r}\n{t}\n" for x in want for r, t in x[1])
        d = digests[conv]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(own), len(loss), sum(len(x[0]) for x in want))
        assert (d["turns_sha256"], d["loss_sha256"]) == (hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())


def test_no_turns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_windows(frame)).count() == 0


def test_sql_states_the_same(spark):
    from granary.llm import registry

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{data}/conversations.parquet')")
    got = registry.op7_chat_windows(spark, data).collect()
    want = con.sql(C.DIGESTS_SQL)
    assert sorted(map(tuple, got)) == sorted(want.project(", ".join(got[0].__fields__)).fetchall())
