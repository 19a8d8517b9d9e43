"""Commands, SQL functions and checks end to end on small files."""

import json

import pytest

from granary import cli
from granary.functions import sql
from granary.operators import checks, models
from granary.streaming.commits import Commits

WORDS = " ".join(f"w{i}" for i in range(400))
PROFILES = "labels:\n  '1.1 threats of harm':\n    definition: d one\n    search_terms: [w1, w2]\n  '2.1 descriptive attacks':\n    definition: d two\n    search_terms: [zz]\n"


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_cards_from_pages_to_validated(spark, tmp_path):
    run = lambda *a: cli.main(list(a), spark)
    at = lambda name: str(tmp_path / name)
    (tmp_path / "profiles.yaml").write_text(PROFILES)
    (tmp_path / "pages.jsonl").write_text("".join(json.dumps({"source_id": s, "page": 1, "text": WORDS}) + "\n" for s in "AB"))
    run("parse", "--pages", at("pages.jsonl"), "--output", at("chunks"))
    assert [r["chunk_id"] for r in sorted(lines(tmp_path / "chunks"), key=lambda r: r["chunk_id"])] == ["A_CHUNK_0001", "A_CHUNK_0002", "B_CHUNK_0001", "B_CHUNK_0002"]
    run("encode", "--chunks", at("chunks"), "--output", at("index"), "--dim", "16")
    run("retrieve-chunks", "--index", at("index"), "--profiles", at("profiles.yaml"), "--output", at("found"), "--top-k", "2", "--candidate-pool-size", "4", "--dim", "16")
    assert len(lines(tmp_path / "found")) == 4
    run("extract", "--chunks", at("chunks"), "--profiles", at("profiles.yaml"), "--output", at("cards"), "--cards-per-label", "1", "--mock")
    made = lines(tmp_path / "cards")
    assert sorted(r["card_id"][-4:] for r in made) == ["_001", "_001"] and {"primary_edos_label", "retrieval_keywords"} <= set(made[0])
    run("normalize", "--input", at("cards"), "--output", at("normal"), "--dedupe")
    assert len(lines(tmp_path / "normal")) == 2
    run("sheet", "--cards", at("normal"), "--output", at("sheet"))
    ids = [r["card_id"] for r in lines(tmp_path / "normal")]
    (tmp_path / "votes.csv").write_text("card_id,decision_accept_reject_revision,faithfulness_1_5,edos_alignment_1_5,usefulness_1_5\n" + f"{ids[0]},accept,,,\n{ids[1]},,1,1,1\n")
    run("adjudicate", "--cards", at("normal"), "--validation", at("votes.csv"), "--output", at("valid"), "--report", at("report"))
    assert [(r["card_id"], r["status"]) for r in lines(tmp_path / "valid")] == [(ids[0], "validated")]
    run("retrieve-cards", "--cards", at("normal"), "--hate-speech", "w1 w2 threats", "--label", "1.1 threats of harm", "--method", "all", "--output", at("best"))
    assert {r["method"] for r in lines(tmp_path / "best")} == {"basic", "dense_mmr", "card_aware"}


SCHEMA = {"type": "object", "required": ["card_id", "source_quote", "primary_edos_label"], "properties": {"source_quote": {"type": "string", "minLength": 10}, "retrieval_keywords": {"type": "array", "items": {"type": "string"}}}}


def card(name, quote, label="1.1 threats of harm", **more):
    return {"card_id": name, "status": "candidate", "source": {"source_id": "S"}, "source_quote": quote, "claim": f"claim of {name}", "primary_edos_label": label, "retrieval_keywords": ["B", "a"], **more}


def test_cards_in_file_order(spark, tmp_path):
    run = lambda *a: cli.main(list(a), spark)
    at = lambda name: str(tmp_path / name)
    (tmp_path / "schema.json").write_text(json.dumps(SCHEMA))
    rows = [card("z", "a quote long enough"), card("a", "A quote  long enough"), card("short", "tiny"), card("m", "another long quote", claim="first"), card("m", "a third long quote", claim="last")]
    (tmp_path / "cards.jsonl").write_text("\n".join(map(json.dumps, rows)))
    run("normalize", "--input", at("cards.jsonl"), "--output", at("normal"), "--dedupe", "--schema", at("schema.json"))
    assert [r["card_id"] for r in lines(tmp_path / "normal")] == ["z", "m", "m"]
    assert all(r["retrieval_keywords"] == ["a", "b"] for r in lines(tmp_path / "normal"))
    (tmp_path / "votes.csv").write_text("card_id,decision_accept_reject_revision,faithfulness_1_5,edos_alignment_1_5,usefulness_1_5\nm,accept,,,\n")
    run("adjudicate", "--cards", at("cards.jsonl"), "--validation", at("votes.csv"), "--output", at("valid"), "--report", at("report"))
    assert [(r["card_id"], r["claim"]) for r in lines(tmp_path / "valid")] == [("m", "last")]
    (tmp_path / "bad.jsonl").write_text('{"card_id": "x"}\n\n{"card_id": \n')
    with pytest.raises(ValueError, match="line 3"):
        run("sheet", "--cards", at("bad.jsonl"), "--output", at("sheet"))


def test_generated_cards_and_resuming(spark, tmp_path, monkeypatch):
    run = lambda *a: cli.main(list(a), spark)
    at = lambda name: str(tmp_path / name)
    (tmp_path / "profiles.yaml").write_text(PROFILES)
    source = {"source_id": "S", "title": "T"}
    (tmp_path / "chunks.jsonl").write_text("\n".join(json.dumps({"chunk_id": f"S_CHUNK_{i:04d}", "source": source, "text": f"text number {i}"}) for i in range(4)))
    found = [{"query_id": label, "item_id": f"S_CHUNK_{i:04d}", "rank": i + 1} for label in ("1.1 threats of harm", "2.1 descriptive attacks") for i in range(4)]
    (tmp_path / "found.jsonl").write_text("\n".join(map(json.dumps, found)))
    common = ["generate-cards", "--chunks", at("chunks.jsonl"), "--retrieved", at("found.jsonl"), "--profiles", at("profiles.yaml"), "--output-dir", at("out")]
    run(*common, "--cards-per-label", "1", "--labels", "1.1 threats of harm")
    assert [r["argument"] for p in sorted((tmp_path / "out/echo_cards").glob("run=*")) for r in lines(p)] == ["text number 0"]
    with pytest.raises(ValueError):
        run(*common)
    run(*common, "--cards-per-label", "2", "--resume")
    cards = [r for p in (tmp_path / "out/echo_cards").glob("run=*") for r in lines(p)]
    assert len(cards) == 4 and len({r["card_id"] for r in cards}) == 4 and all(r["primary_edos_label"] in r["edos_alignment"] for r in cards)
    assert json.loads((tmp_path / "out/echo_summary.json").read_text()) == [{"model_alias": "echo", "accepted": 4, "rejected": 0, "errors": 0, "attempts": 4, "skipped": 1}]
    log = tmp_path / "out/echo_attempts"
    before = sorted(p.name for p in log.glob("run=*"))
    monkeypatch.setattr(Commits, "commit", lambda self, run: (_ for _ in ()).throw(RuntimeError("stopped between the outputs and the manifest")))
    with pytest.raises(RuntimeError):
        run(*common, "--cards-per-label", "3", "--resume")
    monkeypatch.undo()
    assert len(list(log.glob("run=*"))) == len(before) + 1
    run(*common, "--cards-per-label", "3", "--resume")
    runs = {p.stem for p in (tmp_path / "out/echo_commits").glob("*.json")}
    cards = [r for p in (tmp_path / "out/echo_cards").glob("run=*") for r in lines(p)]
    assert {p.name for p in (tmp_path / "out/echo_cards").glob("run=*")} == {p.name for p in log.glob("run=*")} == {f"run={r}" for r in runs}
    assert len(cards) == 6 and len({r["card_id"] for r in cards}) == 6
    (tmp_path / "found.jsonl").write_text("\n".join(map(json.dumps, found[:3])))
    with pytest.raises(ValueError, match="others than"):
        run(*common, "--resume")
    with pytest.raises(ValueError):
        run("generate-cards", "--chunks", at("chunks.jsonl"), "--retrieved", at("found.jsonl"), "--profiles", at("profiles.yaml"), "--output-dir", at("out2"), "--labels", "unknown")


def test_one_answer_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked, said = [], ['{"counter_narrative": " answer ", "used_claim": "claim of c2"}']

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": said[0]}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "cards.jsonl").write_text(json.dumps(card("c1", "a quote")) + "\n" + json.dumps(card("c2", "other", edos_alignment="serves the label")))
    with pytest.raises(ValueError, match="edos_alignment"):
        cli.main(["generate-one", "--cards", str(tmp_path / "cards.jsonl"), "--card-id", "c1", "--hate-speech", "x", "--output", str(tmp_path / "none.json")], spark)
    one = ["generate-one", "--cards", str(tmp_path / "cards.jsonl"), "--card-id", "c2", "--hate-speech", "go away", "--url", f"http://127.0.0.1:{server.server_port}/api/chat", "--output"]
    cli.main([*one, str(tmp_path / "one.json")], spark)
    said[0] = "  just an answer, no object "
    cli.main([*one, str(tmp_path / "plain.json")], spark)
    server.shutdown()
    record = json.loads((tmp_path / "one.json").read_text())[0]
    assert record["generation"] == {"counter_narrative": "answer", "used_claim": "claim of c2", "grounding_note": ""} and record["card"]["card_id"] == "c2"
    assert record["card"]["argument"] == "claim of c2" and record["model"]["provider"] == "ollama" and record["input"]["max_sentences"] == 2
    plain = json.loads((tmp_path / "plain.json").read_text())[0]
    assert plain["generation"] == {"counter_narrative": "just an answer, no object", "used_claim": "", "grounding_note": models.NO_JSON} and plain["raw_model_output"] == said[0]
    assert len(asked) == 3 and "go away" in asked[1]["messages"][0]["content"] and "claim of c2" in asked[1]["messages"][0]["content"]
    with pytest.raises(ValueError):
        cli.main(["generate-one", "--cards", str(tmp_path / "cards.jsonl"), "--card-id", "none", "--hate-speech", "x", "--output", str(tmp_path / "two.json")], spark)


def test_predictions_and_official_votes(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "corpus.json").write_text(json.dumps({str(i): {"HATE_SPEECH": f"text {i}"} for i in range(5)}))
    for name in ("m1", "m2", "m3", "m4", "f"):
        cli.main(["predict", "--task", "c", "--input", at("corpus.json"), "--output", at(name), "--include-probs"], spark)
    cli.main(["vote-official", "--base-preds", *map(at, ("m1", "m2", "m3", "m4")), "--fallback-preds", at("f"), "--output", at("voted")], spark)
    rows = spark.read.option("header", True).csv(at("voted")).collect()
    assert len(rows) == 5 and all(r["used_fallback"] == "false" and r["top_vote_count"] == "4" for r in rows)


def test_a_sheet_outlives_a_broken_replacement(spark, tmp_path):
    from granary.sources import readers, sinks

    path = str(tmp_path / "sheet")
    frame = lambda *rows: spark.createDataFrame(rows, "card_id string, note string")
    sinks.upsert_csv(spark, path, frame(("a", "1"), ("b", "1")), ["card_id"])
    (tmp_path / "sheet").rename(tmp_path / "sheet.old")  # what a crash between the renames leaves
    assert readers.annotations(spark, path).count() == 2
    sinks.upsert_csv(spark, path, frame(("b", "2")), ["card_id"])
    assert sorted((r["card_id"], r["note"]) for r in readers.annotations(spark, path).collect()) == [("a", "1"), ("b", "2")]


def test_votes_and_annotations(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    for name, label in (("a", "x"), ("b", "x"), ("f", "z")):
        (tmp_path / f"{name}.csv").write_text(f"instance_id,label_pred,confidence,gold_label\n1,{label},0.5,x\n2,{label if name != 'b' else 'y'},0.25,z\n")
    cli.main(["vote", "--base-preds", at("a.csv"), at("b.csv"), "--fallback-preds", at("f.csv"), "--output", at("voted")], spark)
    assert spark.read.option("header", True).csv(at("voted")).filter("used_fallback = 'true'").count() == 1
    cli.main(["evaluate", "--predictions", at("a.csv"), "--output", at("metrics.json")], spark)
    assert json.loads((tmp_path / "metrics.json").read_text())[0]["accuracy"] == 0.5
    (tmp_path / "corpus.json").write_text('{"1": {"HATE_SPEECH": "x"}, "3": {"HATE_SPEECH": "y"}}')
    cli.main(["annotate", "--input", at("corpus.json"), "--task-b", at("a.csv"), "--task-c", at("b.csv"), "--output", at("noted")], spark)
    assert {r["instance_id"]: (r["TASK_B"] or {}).get("label_pred") for r in lines(tmp_path / "noted")} == {"1": "x", "3": None}
    again = ["annotate", "--input", at("corpus.json"), "--task-b", at("a.csv"), "--task-c", at("b.csv"), "--output", at("noted"), "--output-csv", at("flat")]
    with pytest.raises(ValueError):
        cli.main(again, spark)
    cli.main([*again, "--overwrite"], spark)
    assert [r["TASK_C_label_pred"] for r in spark.read.option("header", True).csv(at("flat")).collect()] == ["x", None]
    (tmp_path / "labelled.csv").write_text("rewire_id,text,label_sexist,label_category,label_vector,split\n1,t,sexist,c,v,train\n2,u,sexist,c,v,test\n3,w,not sexist,none,none,train\n")
    cli.main(["prepare", "--task", "c", "--corpus", at("labelled.csv"), "--output-dir", at("splits")], spark)
    assert spark.read.option("header", True).csv(at("splits/train")).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["retrieve-cards", "--method", "none"], spark)


def test_sql_functions(spark):
    assert "chunk_words" in sql.register(spark)
    row = spark.sql("SELECT normalize_space(' a  b ') AS s, word_tokens('Ça d\\'Été') AS t, keyword_overlap('a b', array('a a', 'c')) AS k, keyword_overlap('a', array()) AS n, quote_in_passage('a-b c d e', 'x a b, c d e') AS q").head()
    assert (row["s"], row["t"], round(row["k"], 6), row["n"], row["q"]) == ("a b", ["ça", "d'été"], 0.666667, 0.0, True)
    got = spark.sql(f"SELECT start FROM chunk_words('{WORDS}', 350, 80, 40)").collect()
    assert [r["start"] for r in got] == [0, 270]
    assert spark.sql("SELECT * FROM chunk_words('', 350, 80, 40)").count() == 0


def test_checks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "t"), ("b", "u")], "chunk_id string, text string")
    checks.check_chunks(chunks)
    checks.check_index(chunks, chunks)
    for bad in (chunks.union(chunks), spark.createDataFrame([("c", " ")], "chunk_id string, text string")):
        with pytest.raises(ValueError):
            checks.check_chunks(bad)
    with pytest.raises(ValueError):
        checks.check_index(chunks, chunks.filter("chunk_id = 'a'"))
    labels = spark.createDataFrame([("l", "d"), ("m", " ")], "label string, definition string")
    with pytest.raises(ValueError):
        checks.check_profiles(labels, labels)
    assert checks.shared_labels(labels, labels, labels).count() == 2
    with pytest.raises(ValueError):
        checks.shared_labels(labels, labels.filter("label = 'l'"), labels)
    assert checks.point(chunks.selectExpr("*", "1 AS ord"), "chunk_id", "a").count() == 1
    with pytest.raises(ValueError):
        checks.point(chunks.selectExpr("*", "1 AS ord"), "chunk_id", "z")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "m.pt").write_text("x")
    assert checks.resolve_checkpoint(spark, str(tmp_path), "m.pt").endswith("deep/m.pt")
    with pytest.raises(FileNotFoundError):
        checks.resolve_checkpoint(spark, str(tmp_path), "n.pt")
    assert checks.is_complete(spark, [str(tmp_path / "deep" / "m.pt")]) and not checks.is_complete(spark, [str(tmp_path / "no")])
    assert checks.label_names({0: "LABEL_0"}, ["a"]) == {0: "a"} and checks.label_names({0: "b"}, ["a"]) == {0: "b"}
    (tmp_path / "m.json").write_text('{"accuracy": 0.5, "macro_f1": 0.25, "weighted_f1": 1.0}')
    assert checks.metric_files(spark, str(tmp_path / "*.json")).head()["accuracy"] == 0.5
    assert (checks.clamp(-1, 3), checks.clamp(9, 3)) == (0, 2)
