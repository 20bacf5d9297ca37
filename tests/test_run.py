import json

import pytest

from chatmill.run import main
from chatmill.sources import records

ANSWER = '{"extracted_data": {"document_classification": "%s"}}'


def chat_line(user, answer, **extra):
    roles = zip(("system", "user", "assistant"), ("long prompt", user, answer))
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in roles], **extra}) + "\n"


def out_lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def reports(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith('{"report"')]


@pytest.fixture()
def files(spark, tmp_path):
    (tmp_path / "system.txt").write_text(" short \n")
    (tmp_path / "prefix.txt").write_text("PRE\n")
    (tmp_path / "raw.jsonl").write_text(
        chat_line("PRE [PRIVATE_PERSON] a", "```json\n" + ANSWER % "Pre-Service Appeal" + "\n```")
        + chat_line("PRE b", ANSWER % "Inquiry") + "{bad\n\n" + chat_line("c", "{}") + chat_line("PRE d", "{")
    )
    return tmp_path


def test_clean_augment_filter_combine(files, capsys):
    main(["clean", "--input", f"{files}/raw.jsonl", "--output", f"{files}/clean", "--system", f"{files}/system.txt",
          "--strip-prefix-file", f"{files}/prefix.txt"])
    (report,) = reports(capsys)
    assert report == {
        "report": "clean", "kept": 2, "dropped_oversize": 0, "dropped_invalid": 2, "dropped_no_prefix": 1,
        "prefixes_stripped": 3, "fences_stripped": 1,
    }
    assert {r["messages"][0]["content"] for r in out_lines(files / "clean")} == {"short"}

    main(["augment", "--input", f"{files}/clean", "--output", f"{files}/more"])
    assert {r["cls"]: r["total"] for r in reports(capsys)} == {"Pre-Service Appeal": 13, "Inquiry": 5}
    assert len(out_lines(files / "more")) == 18

    main(["token-filter", "--input", f"{files}/more", "--output", f"{files}/none", "--max-tokens", "1", "--report-only"])
    got = reports(capsys)
    assert len(got) == 20 and got[-1]["n"] == 0 and got[-2]["dropped"] == 18 and not (files / "none").exists()
    main(["token-filter", "--input", f"{files}/more", "--output", f"{files}/capped", "--max-tokens", "1000"])
    assert len(out_lines(files / "capped")) == 18

    (files / "extra.jsonl").write_text(chat_line("x", "{}", tag=7))
    main(["combine", "--real", f"{files}/extra.jsonl", "--synth", f"{files}/capped", "--output", f"{files}/mix"])
    mixed = out_lines(files / "mix")
    assert len(mixed) == 21 and sum(r.get("tag") == 7 for r in mixed) == 3


def test_synth(files, spark):
    (files / "seeds.jsonl").write_text(chat_line("has case-7 inside", ANSWER % "A") + chat_line("other", ANSWER % "B") + chat_line("x", "{"))
    (files / "marks.txt").write_text("case-7\n\n")
    main(["synth-plan", "--input", f"{files}/seeds.jsonl", "--failure-cases", f"{files}/marks.txt", "--output", f"{files}/plan"])
    plan = {r.rec_id: r.n_variants for r in spark.read.parquet(f"{files}/plan").collect()}
    assert plan == {0: 12, 1: 4}
    (files / "variants.json").write_text(
        json.dumps({"seed_id": 0, "variant": 1, "variant_text": "v", "label_text": ANSWER % "A"}) + "\n"
        + json.dumps({"seed_id": 1, "variant": 1, "variant_text": "v", "label_text": ANSWER % "A"}) + "\n"
    )
    main(["synth-gate", "--input", f"{files}/seeds.jsonl", "--variants", f"{files}/variants.json", "--output", f"{files}/gated"])
    assert sorted(r["messages"][1]["content"] for r in out_lines(files / "gated")) == ["has case-7 inside", "other", "v"]


def test_focus_eval_backtest(files, spark, rows, capsys):
    asserts = 'c | j @$.extracted_data.document_classification | expected="Pre-Service Appeal"'
    cases = rows([(0, "a", "u", asserts, ANSWER % "Inquiry"), (1, "b", "u", asserts, ANSWER % "Pre-Service Appeal")],
                 "case_pos long, name string, input string, asserts string, output string")
    cases.write.parquet(f"{files}/cases")
    main(["focus", "--backtest", f"{files}/cases", "--short-prompt", f"{files}/system.txt", "--output", f"{files}/focus"])
    (report,) = reports(capsys)
    assert (report["records"], report["failure_seeds"], report["anchor_seeds"]) == (41 + 16, 1, 1)
    main(["backtest", "--input", f"{files}/cases", "--output", f"{files}/scored"])
    assert reports(capsys)[0]["passed"] == 1
    assert spark.read.parquet(f"{files}/scored").count() == 2
    (files / "gold.jsonl").write_text("\n" + chat_line("u", ANSWER % "A") + chat_line("u", ANSWER % "B"))
    (files / "pred.json").write_text(json.dumps({"case_id": 0, "raw_output": ANSWER % "A"}) + "\n")
    main(["eval", "--input", f"{files}/gold.jsonl", "--predictions", f"{files}/pred.json", "--output", f"{files}/eval"])
    assert reports(capsys)[0]["pct"] == 50.0


def written(path):
    return out_lines(path)


def test_rejects_have_file_line_and_reason(files):
    main(["clean", "--input", f"{files}/raw.jsonl", "--output", f"{files}/c2", "--system", f"{files}/system.txt",
          "--strip-prefix-file", f"{files}/prefix.txt", "--rejects", f"{files}/bad"])
    got = sorted((r["line_no"], r["drop_reason"]) for r in written(files / "bad"))
    assert got == [(3, "malformed"), (5, "no_prefix"), (6, "bad_json")]
    main(["combine", "--real", f"{files}/raw.jsonl", "--synth", f"{files}/c2", "--output", f"{files}/m2", "--rejects", f"{files}/bad2"])
    assert [(r["source_name"], r["line_no"]) for r in written(files / "bad2")] == [("real", 3)]


def test_prepare_alpaca_ocr_detections(files, spark, capsys):
    (files / "chats.jsonl").write_text(chat_line("u", "{}") + chat_line("longer text here", "{}"))
    main(["prepare", "--input", f"{files}/chats.jsonl", "--output", f"{files}/prep", "--max-tokens", "1000", "--limit", "1", "--biggest"])
    assert "longer" in spark.read.parquet(f"{files}/prep").first().text
    (files / "alpaca.jsonl").write_text("".join(json.dumps({"instruction": f"i{k}", **({"output": "o"} if k else {})}) + "\n" for k in range(20)))
    main(["alpaca", "--input", f"{files}/alpaca.jsonl", "--output", f"{files}/alp", "--rejects", f"{files}/alpbad"])
    assert spark.read.parquet(f"{files}/alp").count() == 19 and written(files / "alpbad") == [{"rec_id": 0, "field": "output"}]
    assert {r["field"]: r["missing"] for r in reports(capsys)} == {"instruction": 0, "output": 1}
    (files / "pages.json").write_text("".join(json.dumps({"doc_id": 1, "page_no": n, "text": f"p{n}"}) + "\n" for n in range(3)))
    main(["ocr", "--input", f"{files}/pages.json", "--output", f"{files}/ocr", "--page-cap", "2"])
    assert spark.read.parquet(f"{files}/ocr").first().text == "p0\np1\n"
    (files / "dets.json").write_text(json.dumps({"det_id": 1, "image_id": 2, "score": 0.9, "box": "[1,2,11,12]"}) + "\n")
    main(["detections", "--input", f"{files}/dets.json", "--output", f"{files}/det"])
    assert spark.read.parquet(f"{files}/det").first().xmax == 11


def test_routes_inventory_runs_bench_retest(files, spark, capsys):
    (files / "routes.json").write_text(json.dumps({"backend": "b", "url": "http://b", "served_model": "big", "model": "m"}) + "\n")
    (files / "paths.json").write_text(json.dumps({"path": "/v1/z", "backend": "b"}) + "\n")
    request = {"req_id": 1, "path": "/v1/z", "content_type": "application/json", "body": '{"model": "m"}'}
    (files / "in").mkdir()
    (files / "in" / "a.json").write_text(json.dumps(request) + "\n" + json.dumps({**request, "req_id": 2, "body": '{"model": "x"}'}) + "\n")
    config = ["--routes", f"{files}/routes.json", "--path-routes", f"{files}/paths.json"]
    main(["route", "--input", f"{files}/in", "--output", f"{files}/routed", *config])
    assert {(r["backend"], r["status"]) for r in reports(capsys)} == {("b", 200), (None, 404)}
    assert written(files / "routed-unknown-models") == [{"requested_model": "x", "requests": 1}]
    main(["route-stream", "--input", f"{files}/in", "--output", f"{files}/rs", "--checkpoint", f"{files}/rsc", "--once", *config])
    assert spark.read.parquet(f"{files}/rs").count() == 2
    (files / "hub" / "models--org--a").mkdir(parents=True)
    (files / "hub" / "models--org--a" / "w").write_text("x" * 2048)
    (files / "reg.json").write_text(json.dumps({"alias": "a", "hf_id": "org/a", "line_no": 1}) + "\n")
    main(["inventory", "--registry", f"{files}/reg.json", "--root", f"{files}/hub", "--output", f"{files}/inv"])
    assert [(r["alias"], r["size"]) for r in written(files / "inv")] == [("a", "2.0 KB")]
    (files / "meta" / "run-1").mkdir(parents=True)
    (files / "meta" / "run-1" / "metadata.json").write_text(json.dumps({"base_model": "x", "created_at": "2024-01-01T00:00:00Z"}))
    (files / "run-1.log").write_text("{'loss': 0.5, 'epoch': 1.0}\nAdapter saved to x\n")
    main(["runs", "--metadata", f"{files}/meta", "--logs", f"{files}/run-1.log", "--output", f"{files}/runs"])
    assert [(r["dir"], r["loss"], r["completed"]) for r in written(files / "runs")] == [("run-1", 0.5, True)]
    (files / "res.json").write_text(json.dumps({"max_concurrency": 4, "p50_ttft_ms": 2.675}))
    main(["bench", "--results", f"{files}/res.json", "--output", f"{files}/bench"])
    assert [(r["p50_ttft_ms"], r["request_throughput"]) for r in written(files / "bench")] == [("2.67", "-")]
    (files / "cases.jsonl").write_text(json.dumps({"case_name": "c", "input_text": "t", "expected_failures": [["a", "X"]]}) + "\n")
    (files / "outs.json").write_text(json.dumps({"case_name": "c", "raw_output": '{"extracted_data": {"a": "x"}}'}) + "\n")
    main(["retest", "--cases", f"{files}/cases.jsonl", "--outputs", f"{files}/outs.json", "--output", f"{files}/retest"])
    assert [r["outcome"] for r in written(files / "retest")] == ["PASS"]


def test_streams_once(files, spark):
    for name in ("logs", "cases"):
        (files / name).mkdir()
    (files / "logs" / "a.json").write_text(json.dumps({"run": "r", "line_no": 1, "value": "{'loss': 0.25, 'epoch': 1}"}) + "\n")
    main(["follow-logs", "--input", f"{files}/logs", "--output", f"{files}/st", "--checkpoint", f"{files}/stc", "--once"])
    assert spark.read.parquet(f"{files}/st").first().loss == 0.25
    (files / "cases" / "a.json").write_text(json.dumps({"case_pos": 1, "name": "n", "input": "u", "asserts": "", "output": "{}"}) + "\n")
    main(["score-stream", "--input", f"{files}/cases", "--output", f"{files}/sc", "--checkpoint", f"{files}/scc", "--once"])
    assert spark.read.parquet(f"{files}/sc").first().passed


def test_jobs_read_their_input_once(files, spark, monkeypatch, capsys):
    """Reports and data come from what was read once: the input is scanned by one read, and is gone for the rest."""
    reads = []
    placed = records.placed_lines

    def counting(session, path, *more):
        reads.append(path)
        return placed(session, path, *more)

    monkeypatch.setattr(records, "placed_lines", counting)
    (files / "in.jsonl").write_text(
        chat_line("[PRIVATE_PERSON] a", ANSWER % "Pre-Service Appeal") + chat_line("b", '{"a": "[PRIVATE_PERSON]"') + chat_line("c", ANSWER % "X")
    )
    main(["augment", "--input", f"{files}/in.jsonl", "--output", f"{files}/a1"])
    got = {r["cls"]: (r["originals"], r["variants"]) for r in reports(capsys)}
    assert got == {"Pre-Service Appeal": (1, 12), "(unknown)": (1, 0), "X": (1, 4)} and len(out_lines(files / "a1")) == 19
    main(["token-filter", "--input", f"{files}/in.jsonl", "--output", f"{files}/t1", "--max-tokens", "1000"])
    assert len(reads) == 2 and len(out_lines(files / "t1")) == 3
