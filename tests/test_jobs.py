import json

import pytest
from pyspark.sql import functions as F

from chatmill.operators import chat, scoring
from chatmill.plans import alpaca, augment, clean, combine, detect, evaluate, focus, inventory, ocr, routing, runs, synth, token_filter
from chatmill.functions.numbers import fixed
from chatmill.functions.tokens import count_quarter, counter_from

MSG = "array<struct<role: string, content: string>>"


def chats(rows, *records):
    return rows(list(enumerate(records)), f"rec_id long, messages {MSG}")


# -- clean -----------------------------------------------------------------------------


def test_clean_reasons_in_order_and_conservation(rows):
    data = [
        (0, "PRE\n  hello", '```json\n{"a": 1}\n```'),  # kept, fence stripped
        (1, None, "{}"), (2, "PRE x", None),  # missing role
        (3, "no prefix", "{}"),
        (4, "PRE" + "x" * 11, "{}"),  # oversize after the strip
        (5, "PRE" + "x" * 10, "{bad"),
        (6, "PRE ok", '  {"a": 1}\n'),  # kept, only blanks stripped: counted as a fence too
        (7, "PRE ok", "```\n{bad\n```"),  # dropped, but its fence counts
        (8, "PRE😀" * 1, "{}"),
    ]
    result = clean.clean(rows(data, "rec_id long, user_text string, assistant_text string"), " sys ", " PRE ", 10)
    kept = {r.rec_id: [m.content for m in r.messages] for r in result.data.collect()}
    assert kept == {0: ["sys", "hello", '{"a": 1}'], 6: ["sys", "ok", '{"a": 1}'], 8: ["sys", "😀", "{}"]}
    rejects = {r.rec_id: r.drop_reason for r in result.rejects.collect()}
    assert rejects == {1: "missing_role", 2: "missing_role", 3: "no_prefix", 4: "oversize", 5: "bad_json", 7: "bad_json"}
    s = result.summary.first()
    assert (s.kept, s.dropped_oversize, s.dropped_invalid, s.dropped_no_prefix) == (3, 1, 4, 1)
    assert (s.prefixes_stripped, s.fences_stripped) == (6, 3)
    assert s.kept + s.dropped_oversize + s.dropped_invalid + s.dropped_no_prefix == len(data)


def test_clean_without_prefix_is_idempotent(rows):
    data = [(0, "  u", '```json\n{"a": 1}\n```'), (1, "u", "[1, 2]")]
    first = clean.clean(rows(data, "rec_id long, user_text string, assistant_text string"), "s").data
    again = clean.clean(clean.from_chats(first), "s").data
    assert sorted(first.collect()) == sorted(again.collect())
    assert {r.messages[1].content for r in first.collect()} == {"  u", "u"}


def test_clean_from_chats_takes_first_of_each_role(rows):
    df = chats(
        rows,
        [("assistant", "{}"), ("user", "a"), ("user", "b")],
        [("system", "s"), ("user", "a")],
        [("user", None), ("assistant", "{}")],
        [],
    )
    got = clean.from_chats(df).orderBy("rec_id").collect()
    assert [(r.user_text, r.assistant_text) for r in got] == [("a", "{}"), ("a", None), ("", "{}"), (None, None)]


# -- chat ------------------------------------------------------------------------------


def test_chat_stages(rows):
    df = chats(rows, [("user", "abc"), ("user", "abcdef"), ("assistant", "xyz")], [("system", "😀")], [])
    got = df.orderBy("rec_id").select(chat.longest_user(F.col("messages")), chat.total_chars(F.col("messages"))).collect()
    assert [tuple(r) for r in got] == [(6, 12), (0, 1), (0, 0)]
    assert chat.cap_longest_user(df, 0).count() == 3 and chat.cap_longest_user(df, 5).count() == 2
    assert [r.rec_id for r in chat.biggest_first(df, 2).collect()] == [0, 1]
    text = df.where("rec_id = 1").select(chat.render(F.col("messages"))).first()[0]
    assert text == "<|system|>\n😀<|end|>\n"


@pytest.mark.parametrize("n, kept", [(500, 500), (700, 512)])
def test_keep_tail(rows, n, kept):
    user = " ".join(f"w{i}" for i in range(n))
    df = rows([("s", user)], "s string, u string").select(chat.keep_tail(F.col("s"), F.col("u"), 520))
    words = df.first()[0].split()
    assert len(words) == kept and words[-1] == f"w{n - 1}"


def test_token_filter_report_only_and_counters(rows):
    df = chats(rows, *[[("user", "w " * i)] for i in range(1, 40)])
    result = token_filter.token_filter(df, 30, report_only=True)
    assert result.data is None
    counted = token_filter.with_tokens(df)
    sizes = sorted(r.n_tokens for r in counted.collect())
    kept = [s for s in sizes if s <= 30]
    report = result.report.first()
    assert (report.n, report.p50, report.p99, report.max) == (len(kept), kept[len(kept) // 2], kept[int(len(kept) * 0.99)], kept[-1])
    assert [r.n_tokens for r in result.dropped_top.collect()] == sorted([s for s in sizes if s > 30], reverse=True)[:20]
    own = counter_from(lambda: len)
    got = df.limit(1).select(own(F.lit("12345")), count_quarter(F.lit("12345"))).first()
    assert tuple(got) == (5, 2)
    biggest = token_filter.prepare(df, 30, limit=1, biggest=True).first()
    assert biggest.n_tokens == kept[-1]
    assert token_filter.prepare(df, 30, limit=2).count() == 2


# -- mix -------------------------------------------------------------------------------


def test_combine(rows):
    real = rows([(0, "a" * 5, 1), (1, "b" * 9, 2)], "rec_id long, text string, tag int")
    synth_rows = rows([(0, "c")], "rec_id long, text string")
    mixed = combine.combine({"real": real, "synth": synth_rows}, max_user_chars=6, longest=F.length("text"))
    assert sorted((r.source_name, r.text, r.tag) for r in mixed.data.collect() if r.source_name == "real") == [("real", "aaaaa", 1)] * 3
    assert mixed.data.where("source_name = 'synth'").count() == 1
    counts = {r.source_name: (r.loaded, r.kept, r.dropped, r.combined) for r in mixed.counts.collect()}
    assert counts == {"real": (2, 1, 1, 3), "synth": (1, 1, 0, 1)}
    none = combine.combine({"real": real, "synth": synth_rows}, {"real": 0}, longest=F.length("text"), shuffle=False)
    assert [r.source_name for r in none.data.collect()] == ["synth"]


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(2000).select(F.col("id").alias("rec_id"), F.lit("s").alias("source_name"), F.lit(0).alias("copy"))
    one = [r.rec_id for r in combine.shuffled(df, partitions=4).collect()]
    assert one == [r.rec_id for r in combine.shuffled(df.repartition(5), partitions=4).collect()]
    assert sorted(one) == list(range(2000)) and one != sorted(one)
    assert one != [r.rec_id for r in combine.shuffled(df, seed=7, partitions=4).collect()]


def test_alpaca(rows):
    good = rows([(0, "i", None, "o"), (1, "i", "x", "o")], "rec_id long, instruction string, input string, output string")
    assert alpaca.check(good) == {"count": 2, "format": "alpaca"}
    texts = {r.text for r in alpaca.prepare_alpaca(good, eos="!").data.collect()}
    assert texts == {"### Instruction:\ni\n\n### Response:\no!", "### Instruction:\ni\n\n### Input:\nx\n\n### Response:\no!"}
    bad = good.withColumn("output", F.when(F.col("rec_id") == 0, F.col("output")))
    with pytest.raises(ValueError, match="row 1 has no field 'output'"):
        alpaca.check(bad)
    with pytest.raises(ValueError):
        alpaca.audit(good, "other")


# -- scoring ---------------------------------------------------------------------------

CASE = "case_pos long, name string, input string, asserts string, output string"
PASSING = '{"extracted_data": {"document_classification": "%s", "n": 1.0, "t": " x "}}'


def one(cls, extra=""):
    return f'c = "{cls}" | json_path_exact @$.extracted_data.document_classification | expected="{cls}"{extra}'


def test_assertion_scoring(rows):
    data = [
        (0, "a", "", one("A", " ; t | j @$.extracted_data.t | expected=x ; n | j @$.extracted_data.n | expected=1.0"), PASSING % "A"),
        (1, "b", "", one("A"), PASSING % "B"),
        (2, "c", "", "", "prose " + PASSING % "B"),
        (3, "d", "", "", "no json"),
        (4, "e", "", one("A"), "ERROR: X " + PASSING % "A"),
        (5, "f", "", one("A"), None),
        (6, "g", "", one("A", " ; m | j @$.extracted_data.missing | expected="), PASSING % "A"),
    ]
    cases = rows(data, CASE)
    report = evaluate.backtest_report(cases)
    got = {r.case_pos: (r.passed, r.outcome) for r in report.cases.collect()}
    assert got == {
        0: (True, "passed"), 1: (False, "failed"), 2: (True, "passed"), 3: (False, "unparseable"),
        4: (False, "inference_error"), 5: (False, "unparseable"), 6: (True, "passed"),
    }
    s = report.summary.first()
    assert (s.cases, s.passed, s.failed) == (7, 3, 4)
    grid = {(r.gold, r.pred): r.n for r in report.confusion.collect()}
    assert grid == {("A", "A"): 2, ("A", "B"): 1, ("A", ""): 2} | {k: v for k, v in grid.items() if k[0] != "A"}
    dense = {(r.gold, r.pred): r.n for r in scoring.confusion_grid(report.confusion, ["A", "B", "", "A"]).collect()}
    assert dense["A", ""] == 2 and dense["B", "B"] == 0 and len(dense) == 9
    running = report.running.orderBy("case_pos").collect()
    assert [r.passed_so_far for r in running] == [1, 1, 2, 2, 2, 2, 3]
    # focus reads the raw text even of an error line
    assert {r.case_pos: r.category for r in focus.categorise(cases, "A").collect()} == {
        0: "anchor", 1: "failure", 2: "ignored", 3: "ignored", 4: "anchor", 5: "failure", 6: "anchor",
    }


def test_confusion_has_one_form_for_any_number_of_labels(rows):
    checks = [(i, [("p.document_classification", f"g{i}", f"p{i}")]) for i in range(1001)]
    scored = rows(checks, "case_pos long, checks array<struct<path: string, expected: string, actual: string>>")
    pairs = scoring.class_pairs(scored)
    assert pairs.count() == 1001
    grid = {(r.gold, r.pred): r.n for r in scoring.confusion_grid(pairs, ["g7", "p7", "other"]).collect()}
    assert len(grid) == 9 and grid["g7", "p7"] == 1 and sum(grid.values()) == 1


def test_eval_denominators_and_untrimmed_comparison(rows):
    gold = rows([(i, g) for i, g in enumerate(['{"a": "x"}', '{"a": "x"}', "bad", '{"a": null}', '{"a": true}', '{"a": "x"}'])], "case_id long, gold string")
    preds = rows([(0, '{"a": "x"}'), (1, '{"a": "x "}'), (2, "{}"), (3, "{}"), (4, "nothing"), (9, "{}")], "case_id long, raw_output string")
    scored = scoring.score_fields(gold, preds, ["$.a"])
    assert {r.case_id: r.outcome for r in scored.collect()} == {
        0: "passed", 1: "failed", 2: "gold_invalid", 3: "passed", 4: "no_json", 5: "error",
    }
    s = scoring.pass_summary(scored, F.col("outcome") == "passed").first()
    assert (s.cases, s.passed, s.failed) == (6, 2, 4)
    f = scoring.field_accuracy(scored).first()
    assert (f.correct, f.total) == (2, 3)
    empty = scoring.pass_summary(scored.where("case_id > 99"), F.lit(True)).first()
    assert (empty.cases, empty.pct) == (0, None)


def test_retest(rows):
    data = [
        (0, '{"extracted_data": {"f": " Yes "}}', {"f": "yes"}),
        (1, '```json\n{"extracted_data": {"f": "", "case_specific_fields": {"f": "v"}}}\n```', {"f": "V "}),
        (2, '{"extracted_data": {}}', {"f": ""}),
        (3, '{"extracted_data": {"f": "no"}}', {"f": "yes", "g": ""}),
        (4, 'x {"extracted_data": {}}', {"f": ""}),
        (5, '{"extracted_data": {"case_specific_fields": null}}', {"f": "a"}),
    ]
    cases = rows(data, "case_id long, raw_output string, expected map<string, string>")
    got = {r.case_id: r.outcome for r in scoring.score_retest(cases).collect()}
    assert got == {0: "PASS", 1: "PASS", 2: "PASS", 3: "FAIL", 4: "ERROR", 5: "FAIL"}
    assert {r.outcome: r.cases for r in evaluate.retest_report(cases).collect()} == {"PASS": 3, "FAIL": 2, "ERROR": 1}


def test_corrected_answers_score_as_passing(rows):
    psa, fields = focus.FAILURE_CLASS, " ; p | j @$.extracted_data.case_specific_fields.case_type_pre_service | expected=std"
    data = [
        (0, "wrong", "u", one(psa, fields), PASSING % "Inquiry"),
        (1, "empty", "u [PRIVATE_PERSON]", one(psa, fields), "no json"),
        (2, "good", "u", one(psa), PASSING % psa),
        (3, "good too", "u", one(psa), PASSING % psa),
        (4, "inquiry", "u", one("Inquiry"), PASSING % "Inquiry"),
        (5, "discarded", "u", one("Inquiry"), PASSING % psa),
    ]
    cases = rows(data, CASE)
    result = focus.focus(cases, "sys", per_failure=3, per_anchor=2, anchors_per_class=1, noise=0.0)
    got = {(r.rec_id, r.variant): r for r in result.data.collect()}
    assert sorted(got) == [(i, v) for i, n in [(0, 4), (1, 4), (2, 3), (4, 3)] for v in range(n)]
    fixed = rows([(i, "n", "u", data[i][3], got[i, 0].messages[2].content) for i in (0, 1)], CASE)
    assert scoring.score_asserts(fixed).where("passed").count() == 2
    wrong = json.loads(got[0, 0].messages[2].content)["extracted_data"]
    assert wrong["t"] == " x " and wrong["service_type"] == "Pre-Service"
    assert json.loads(got[1, 0].messages[2].content)["extracted_data"]["n"] == 1.0  # from the donor
    counts = {r.cls: (r.records, r.failure_seeds, r.anchor_seeds) for r in result.summary.collect()}
    assert counts == {psa: (11, 2, 1), "Inquiry": (3, 0, 1)}
    no_donor = focus.focus(cases.where("case_pos < 2"), "sys", per_failure=0, noise=0.0).data
    assert json.loads(no_donor.where("rec_id = 1").first().messages[2].content)["extracted_data"]["service_type"] == "Pre-Service"


def test_donor_edits_for_unknown_class(spark):
    got = spark.range(1).select(focus.default_edits(F.lit("other")), focus.default_edits(F.lit("Grievance"))).first()
    assert got[0] == [] and len(got[1]) == 3


def test_synth_gate(rows):
    seeds = rows([(0, "s", "u", '{"extracted_data": {"document_classification": "A"}}'), (1, "s", "u", "bad"), (2, "s", "u", "{}")],
                 "rec_id long, system string, user_text string, answer string")
    label = '```json\n{"extracted_data":{"document_classification":"A"},"é":1}\n```'
    data = [
        (0, 1, "t", label), (0, 2, "", label), (0, 3, None, label), (0, 4, "t", "null"),
        (0, 5, "t", "{}"), (0, 6, "t", None), (1, 1, "t", label), (2, 1, "t", "[1]"),
        (77, 1, "t", label),
    ]
    result = synth.synth_gate(rows(data, "seed_id long, variant int, variant_text string, label_text string"), seeds)
    counts = {r.outcome: r.n for r in result.summary.collect()}
    assert counts == {"kept": 2, "paraphrase_failed": 2, "label_failed": 2, "drift": 1, "original": 2, "seed_invalid": 1, "no_seed": 1}
    assert sum(n for outcome, n in counts.items() if outcome != "original") == len(data)
    got = {(r.seed_id, r.variant): r.messages[2].content for r in result.data.collect()}
    assert got[0, 1] == json.dumps(json.loads(label[8:-4]), ensure_ascii=False, indent=2)
    assert sorted(got) == [(0, 0), (0, 1), (2, 0), (2, 1)]


# -- OCR, detection --------------------------------------------------------------------


def test_ocr_job(rows):
    pages = [(1, n, f"<|ref|>p{n}<|/ref|>") for n in range(30, 0, -1)] + [(2, 5, " only  \n")]
    got = {r.doc_id: r for r in ocr.corpus(rows(pages, "doc_id long, page_no int, text string"), cap=20).collect()}
    assert (got[1].pages, got[1].kept_pages, got[1].dropped_pages) == (30, 20, 10)
    assert got[1].text == "\n".join(f"p{n}" for n in range(1, 21)) + "\n"
    assert (got[2].text, got[2].removed_chars) == ("only\n", 3)
    reqs = {r.doc_id: r for r in ocr.requests(rows(pages, "doc_id long, page_no int, text string")).collect()}
    assert (reqs[1].ngram_window, reqs[2].ngram_window) == (1024, 128)
    assert reqs[2].content.startswith("<image>document parsing.\n")


def test_detection_geometry(rows):
    data = [(0, 1, 0.9, "[1,2,11,12]"), (1, 1, 0.5, "[[4, 5],[1, 9],[7,2]]"), (2, 1, 0.4, "[0,0,99,99]"), (3, 2, 0.45, "[1,1,2,2]")]
    df = rows(data, "det_id long, image_id long, score double, box string")
    got = {r.det_id: r for r in detect.geometry(df).collect()}
    assert got[0].bbox == [1, 2, 11, 12]
    assert [tuple(p) for p in got[0].polygon] == [(1, 2), (1, 12), (11, 12), (11, 2)]
    assert got[1].bbox == [1, 2, 7, 9] and [tuple(p) for p in got[1].polygon] == [(4, 5), (1, 9), (7, 2)]
    per = {r.image_id: r for r in detect.per_image(df).collect()}
    assert (per[1].detections, per[1].max_score, per[1].xmax) == (2, 0.9, 11) and per[2].detections == 1
    assert detect.per_image(df, most=1).where("image_id = 1").first().xmin == 1


# -- routing ---------------------------------------------------------------------------

ROUTES = [("big", "http://b", "org/Big", "org/Big"), ("big", "http://b", "org/Big", "big-alias"), ("det", "http://d", "det-1", "det-1")]
ROUTE = "backend string, url string, served_model string, model string"
REQ = "req_id long, path string, content_type string, body string, model_header string"


@pytest.mark.parametrize(
    "request_, status, backend, forwarded",
    [
        (("/v1/chat", "application/json", '{"model":"big-alias","é":1}', None), 200, "big", '{"model":"org/Big","\\u00e9":1}'),
        (("/v1/detect", "image/png", "png-bytes", None), 200, "det", "png-bytes"),
        (("/custom", "image/jpeg", "jpeg", "det-1"), 200, "det", "jpeg"),
        (("/v1/chat", "application/json", '{"model":"big-alias"}', "det-1"), 400, None, None),
        (("/v1/chat", "application/json", '{"model":"big-alias"}', "big-alias"), 200, "big", '{"model":"org/Big"}'),
        (("/v1/chat", "Application/JSON; charset=utf-8", "{bad", None), 400, None, None),
        (("/v1/chat", "text/plain", "{bad", "big-alias"), 200, "big", "{bad"),
        (("/v1/chat", "application/json", "", "big-alias"), 200, "big", ""),
        (("/v1/chat", "application/json", '{"model":"nope"}', None), 404, None, None),
        (("/v1/chat", "application/json", '["model"]', None), 400, None, None),
        (("/v1/detect", "application/json", '["x"]', None), 200, "det", '["x"]'),
        (("/v1/detect", "application/json", '{"model":"","x":1}', ""), 200, "det", '{"model":"det-1","x":1}'),
        (("/v1/detect", "application/json", '{"x":1}', None), 200, "det", '{"x":1,"model":"det-1"}'),
        (("/v1/chat", None, None, None), 400, None, None),
        (("/v1/chat", "application/json", '{"model":"big-alias","pad":"' + "x" * 200 + '"}', None), 413, None, None),
    ],
)
def test_route(rows, request_, status, backend, forwarded):
    got = routing.route(
        rows([(1, *request_)], REQ), rows(ROUTES, ROUTE), rows([("/v1/detect", "det")], "path string, backend string"),
        max_body_bytes=150, forward=True,
    ).first()
    assert (got.status, got.backend, got.forwarded_body) == (status, backend, forwarded)
    assert (got.error is None) == (status == 200)


def test_route_audit(rows):
    paths = rows([("/v1/detect", "det")], "path string, backend string")
    good = rows(ROUTES, ROUTE)
    assert routing.audit(good, paths).count() == 0
    assert {r.problem for r in routing.audit(good, paths, max_concurrency=0).collect()} == {"max_concurrency must be at least 1"}
    assert "no backends" in {r.problem for r in routing.audit(good.limit(0), paths).collect()}
    assert sorted(r.id for r in routing.advertised(good).collect()) == ["big-alias", "det-1", "org/Big"]


# -- inventory, runs -------------------------------------------------------------------


def test_human_sizes_round_halves_to_even(rows):
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1536 * 1024, 3 * 1024**5, 2000 * 1024**5, None]
    df = rows([(i, s) for i, s in enumerate(sizes)], "i int, s long")
    got = [r[0] for r in df.orderBy("i").select(inventory.human_size(F.col("s"))).collect()]
    assert got == ["0.0 B", "1.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.5 MB", "3.0 PB", "2000.0 PB", None]


def test_nested_model_names(rows):
    files = rows([("models--a--b--c", 1), ("other", 5), ("models--a--b--c", 2)], "dir string, length long")
    assert [tuple(r) for r in inventory.sizes(files).collect()] == [("a/b/c", 3)]
    assert {r.hf_id: r.size for r in inventory.totals(files).collect()} == {"a/b/c": "3.0 B", "TOTAL": "3.0 B"}
    assert inventory.totals(files.limit(0)).count() == 0


def test_elapsed(spark):
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    start = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    got = spark.range(1).select(runs.elapsed(start, now), runs.elapsed(F.lit(None).cast("timestamp"), now)).first()
    assert tuple(got) == ("27h 4m 5s", None)


# -- whole records, types of values, exact rounding --------------------------------------

FOUR = [("system", "s"), ("user", "u [PRIVATE_PERSON]"), ("assistant", "{}"), ("user", "and a late-marker")]
RECORD = "rec_id long, messages array<struct<role: string, content: string>>, raw string"


def test_originals_stay_whole(rows):
    raw = '{"id": 9, "messages": "as they were"}'
    seeds = chat.triples(rows([(0, FOUR, raw)], RECORD))
    made = augment.augment(seeds, normal=2, noise=0.0).data.collect()
    by_variant = {r.variant: r for r in made}
    assert [tuple(m) for m in by_variant[0].messages] == FOUR and by_variant[0].raw == raw
    assert [len(by_variant[v].messages) for v in (1, 2)] == [3, 3] and by_variant[1].raw is None
    none = rows([], "seed_id long, variant int, variant_text string, label_text string")
    kept = synth.synth_gate(none, seeds).data.first()
    assert [tuple(m) for m in kept.messages] == FOUR and kept.raw == raw


def test_markers_are_searched_in_the_whole_record(rows):
    seeds = chat.triples(rows([(0, FOUR, "{}"), (1, FOUR[:3], '{"id": "key-marker"}'), (2, FOUR[:3], "{}")], RECORD))
    marks = rows([("late-marker",), ("key-marker",)], "marker string")
    assert {r.rec_id: r.n_variants for r in synth.work_list(seeds, marks).collect()} == {0: 12, 1: 12, 2: 4}


def test_truth_of_a_value_is_that_of_its_type(rows):
    answers = ['{"extracted_data": {"a": %s}}' % v for v in ('"0"', "0", '"False"', "false", "[]", '"[]"', '""', "0.0")]
    cases = rows([(i, a) for i, a in enumerate(answers)], "case_id long, raw_output string")
    expected = F.element_at(F.array(*map(F.lit, ["0", "0", "False", "False", "[]", "[]", "", "0.0"])), (F.col("case_id") + 1).cast("int"))
    scored = scoring.score_retest(cases.withColumn("expected", F.create_map(F.lit("a"), expected))).collect()
    assert [r.outcome for r in sorted(scored, key=lambda r: r.case_id)] == ["PASS", "FAIL", "PASS", "FAIL", "FAIL", "PASS", "PASS", "FAIL"]
    routes = rows([("b", "http://b", "big", "0"), ("p", "http://p", None, "x")], "backend string, url string, served_model string, model string")
    paths = rows([("/v1/z", "p")], "path string, backend string")
    reqs = rows([(0, '{"model": "0"}'), (1, '{"model": 0}')], "req_id long, body string").selectExpr(
        "req_id", "'/v1/z' AS path", "'application/json' AS content_type", "body", "CAST(NULL AS STRING) AS model_header"
    )
    got = {r.req_id: (r.requested_model, r.backend) for r in routing.route(reqs, routes, paths).collect()}
    assert got == {0: ("0", "b"), 1: (None, "p")}


def test_a_model_of_two_backends_keeps_name_and_served_model_together(rows):
    routes = rows([("a", "u", "z", "m"), ("b", "u", "c", "m")], "backend string, url string, served_model string, model string")
    assert [tuple(r) for r in routing.model_table(routes).collect()] == [("m", "a", "z")]


def test_decimals_round_the_exact_value(rows):
    values = [2.675, 0.125, 1e15 + 0.3, -0.001, 2.5, None]
    got = rows([(v,) for v in values], "v double").select(fixed(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == [None if v is None else f"{v:.2f}" for v in values]
    shown = rows([(1034,), (1075,), (10**16,), (None,)], "n long").select(inventory.human_size(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["1.0 KB", "1.0 KB", "8.9 PB", None]


def test_a_null_answer_counts_as_a_changed_one(rows):
    chats = rows([(0, [("user", "u"), ("assistant", None)]), (1, [("user", "u"), ("assistant", "{}")])], "rec_id long, messages array<struct<role: string, content: string>>")
    assert clean.clean(clean.from_chats(chats), "s").summary.first().fences_stripped == 1
