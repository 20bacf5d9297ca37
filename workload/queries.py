"""Registered queries: each reads whole input tables of a scale-factor folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.functions import text as tx
from chatmill.functions.answers import json_ok, read_answer
from chatmill.functions.asserts import parse_asserts
from chatmill.operators import chat, markers, ranking, scoring
from chatmill.plans import (
    alpaca, augment, clean, combine, detect, evaluate, focus, inventory, ocr, routing, runs,
    synth, token_filter,
)
from chatmill.session import configure, materialise, shared_dir
from chatmill.sources import listing, records, tables
from chatmill.streaming import jobs
from workload.fixtures import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SYSTEM = "You classify cases."
PREFIX = "PROMPT>>"
SEED = 42


def query(*inputs: str):
    """Register a function of the named input tables under its own name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(*[table(spark, sf_dir, name) for name in inputs])

        REGISTRY[fn.__name__] = run
        return fn

    return add


# -- sources ---------------------------------------------------------------------------


def _scratch(df: DataFrame) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"


def _as_lines(chats: DataFrame, cut: bool = True) -> str:
    """Write the chats as JSONL, 64 files of ``rec_id`` modulo 64 in order; two blank lines follow every fifth.

    With ``cut`` every seventh line lacks its last character.
    """
    line = F.to_json(F.struct(F.col("rec_id").alias("conv_id"), "messages"))
    bad = F.lit(cut) & (F.col("rec_id") % 7 == 0)
    line = F.when(bad, F.left(line, F.length(line) - 1)).otherwise(line)
    with_blank = F.when(F.col("rec_id") % 5 == 0, F.concat(line, F.lit("\n  \n"))).otherwise(line)
    path = _scratch(chats)
    dealt = chats.select("rec_id", (F.col("rec_id") % 64).alias("part"), with_blank.alias("value"))
    dealt.repartition(64, "part").sortWithinPartitions("part", "rec_id").select("part", "value").write.partitionBy("part").text(path)
    return path


def _said(records_: DataFrame) -> DataFrame:
    return records_.select(
        F.get_json_object("raw", "$.conv_id").cast("long").alias("conv_id"),
        F.size("messages").alias("n_messages"),
        chat.total_chars(F.col("messages")).alias("total_chars"),
    )


@query("chat")
def src_jsonl_lenient(chats):
    return _said(records.read_jsonl(chats.sparkSession, _as_lines(chats)).records)


@query("chat")
def src_jsonl_rejects(chats):
    """The malformed lines by the conversation they begin with, with their exact line numbers."""
    rejects = records.read_jsonl(chats.sparkSession, _as_lines(chats)).rejects
    return rejects.select(
        F.regexp_extract("raw", r'^\{"conv_id":(\d+),', 1).cast("long").alias("conv_id"),
        F.regexp_extract("src_file", r"/part=(\d+)/", 1).cast("long").alias("file_no"), "line_no",
    )


@query("chat")
def src_strict(chats):
    """Every record of well-formed files, with its index over all of them in the order of file names and lines."""
    read = records.read_jsonl_strict(chats.sparkSession, _as_lines(chats, cut=False))
    place = F.regexp_extract("src_file", r"/part=(\d+)/", 1).cast("long").alias("file_no")
    said = _said(read).join(
        records.indexed(read.select("rec_id", F.get_json_object("raw", "$.conv_id").cast("long").alias("conv_id"), place)),
        "conv_id",
    )
    return said.select("conv_id", "n_messages", "total_chars", "file_no", "index")


@query("chat")
def src_sink(chats):
    """Chats written as JSONL and read back, text for text."""
    path = _scratch(chats)
    records.write_jsonl(chats, path, "rec_id", "messages")
    back = records.read_jsonl_strict(chats.sparkSession, path)
    told = F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return back.select(F.get_json_object("raw", "$.rec_id").cast("long").alias("rec_id"), told.alias("said"))


@query("alpaca")
def src_dataset(rows):
    """A dataset read by its key in a registry; absent fields are null."""
    root = _scratch(rows)
    line = F.to_json(F.struct("rec_id", "instruction", "input", "output"))  # leaves null fields out
    rows.select(line.alias("value")).write.text(f"{root}/data.jsonl")
    registry = {"tuning": {"path": "data.jsonl", "format": "alpaca", "split": [0.9, 0.05, 0.05]}}
    read = records.read_dataset(rows.sparkSession, registry, "tuning", root)
    return read.select(F.get_json_object("raw", "$.rec_id").cast("long").alias("rec_id"), "instruction", "input", "output")


@query("benchmark", "events")
def src_markers(items, events):
    """A marker file with indented, blank and repeated lines."""
    path = _scratch(items)
    lines = items.select(F.concat(F.lit("  "), F.regexp_replace("text", r"\s+", " "), F.lit("\t")).alias("value"))
    repeated = events.select(F.concat(F.col("event_type"), F.lit("\n \n")).alias("value"))
    lines.unionByName(repeated).write.text(path)
    return tables.read_markers(items.sparkSession, path)


@query("retest")
def src_retest(rows):
    """Retest lines with expected values as an object or, for odd cases, as pairs."""
    path = _scratch(rows)
    pairs = F.array(*[F.array(F.lit(n), F.col(f"exp_{n}")) for n in ("document_classification", "case_type_pre_service")])
    named = F.struct(*[F.col(f"exp_{n}").alias(n) for n in ("document_classification", "case_type_pre_service")])
    common = [F.col("case_name"), F.col("raw_output").alias("input_text")]
    line = F.when(
        F.col("case_id") % 2 == 1, F.to_json(F.struct(*common, pairs.alias("expected_failures")))
    ).otherwise(F.to_json(F.struct(*common, named.alias("expected_failures"))))
    rows.select(line.alias("value")).write.text(path)
    return tables.read_retest(rows.sparkSession, path).select(
        "case_name", "input_text", F.col("expected")["document_classification"].alias("class"),
        F.col("expected")["case_type_pre_service"].alias("pre_service"),
    )


@query("run_log")
def src_log(lines):
    """Status from log files, one file a run, whose lines come in their order."""
    path = _scratch(lines)
    dealt = lines.repartition(8, "run").sortWithinPartitions("run", "line_no")
    dealt.select("run", "value").write.partitionBy("run").text(path)
    # The reader names a run after its file; here the folder says it.
    read = records.placed_lines(lines.sparkSession, path).select(
        F.regexp_extract("src_file", "/run=([^/]+)/", 1).alias("run"), F.col("rec_id").alias("line_no"), F.col("raw").alias("value")
    )
    return runs.log_status(read)


def _result_files(events: DataFrame) -> str:
    """64 result files of one object over several lines; every eighth lacks its end, one in 64 is a list."""
    per = events.groupBy((F.col("user_id") % 64).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    text = F.format_string('{\n "max_concurrency": %d,\n "request_throughput": %d,\n "failed": %d\n}', "part", "n", "failed")
    bad = F.when(F.col("part") % 8 == 3, F.left(text, F.length(text) - 1)).when(F.col("part") == 5, F.lit("[1, 2]"))
    path = _scratch(events)
    rows = per.select("part", F.coalesce(bad, text).alias("value"))
    rows.repartition(64, "part").write.partitionBy("part").text(path)
    return path


@query("events")
def src_results(events):
    return tables.read_results(events.sparkSession, _result_files(events)).data.select("max_concurrency", "request_throughput", "failed")


@query("events")
def src_results_rejects(events):
    """One row for every file that holds no object."""
    rejects = tables.read_results(events.sparkSession, _result_files(events)).rejects
    return rejects.select(F.regexp_extract("src_file", r"/part=(\d+)/", 1).cast("long").alias("part"), F.length("raw").alias("chars"))


def _model_folders(events: DataFrame) -> str:
    """16 model folders of up to four files each, a line with its type for every event."""
    part = F.col("user_id") % 64
    rows = events.select(
        F.concat(F.lit("models--org--u"), part % 16).alias("dir"), part.alias("part"), F.coalesce("event_type", F.lit("")).alias("value")
    )
    path = _scratch(events)
    rows.repartition(64, "part").write.partitionBy("dir", "part").text(path)
    return path


@query("events")
def src_file_listing(events):
    """Files and bytes of every model folder, as found on disk."""
    found = listing.scan_files(events.sparkSession, _model_folders(events)).where(F.col("path").endswith(".txt"))
    model = inventory.hf_id(F.substring_index("dir", "=", -1)).alias("hf_id")
    return found.groupBy(model).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("size_bytes"))


# -- records ---------------------------------------------------------------------------


@query("chat")
def chat_first_roles(chats):
    return chat.first_roles(chats)


@query("chat")
def mix_longest_user_cap(chats):
    return chat.cap_longest_user(chats, 4000).select(
        "rec_id", chat.longest_user(F.col("messages")).alias("longest_user")
    )


@query("chat")
def biggest_first(chats):
    return chat.biggest_first(chats, 5)


@query("chat")
def biggest_records(chats):
    found = chat.biggest_records(chats, 5)
    return found.select("rec_id", "total_chars", F.size("messages").alias("n_messages"),
                        F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("contents"))


@query("chat")
def biggest_half(chats):
    """The larger half of the records, cut by counts of sizes."""
    return chat.biggest_records(chats, chats.count() // 2, few=0).select("rec_id", "total_chars")


@query("chat")
def first_n(chats):
    return chat.first_n(chats, 10).select("rec_id", F.size("messages").alias("n_messages"))


@query("chat")
def chat_render(chats):
    return chats.select("rec_id", chat.render(F.col("messages")).alias("text"))


@query("chat")
def prompt_tail_budget(chats):
    first = chats.select(
        "rec_id",
        tx.or_empty(chat.first_of_role(F.col("messages"), "system")["content"]).alias("system"),
        tx.or_empty(chat.first_of_role(F.col("messages"), "user")["content"]).alias("user_text"),
    )
    return first.select(
        "rec_id", chat.keep_tail(F.col("system"), F.col("user_text"), 600).alias("user_text")
    )


@query("alpaca")
def alpaca_audit(rows):
    return alpaca.audit(rows)


@query("alpaca")
def alpaca_render(rows):
    complete = rows.where(F.col("instruction").isNotNull() & F.col("output").isNotNull())
    return complete.select("rec_id", chat.render_alpaca().alias("text"))


@query("alpaca")
def split_exact(rows):
    return combine.split_exact(rows.select("rec_id")).select("rec_id", "split")


@query("alpaca")
def alpaca_prep(rows):
    return alpaca.prepare_alpaca(rows).data


@query("documents")
def eval_preview(docs):
    return docs.select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("backtest")
def backtest_load(cases):
    return tables.tidy_cases(cases).select(
        "case_pos", "name", F.length("input").alias("input_len"), "asserts", "output"
    )


# -- clean -----------------------------------------------------------------------------


@query("sft_raw")
def clean_prefix(rows):
    got = clean.classify(rows, PREFIX)
    return got.where("prefix_stripped").select("rec_id", "user")


@query("sft_raw")
def clean_char_cap(rows):
    got = clean.classify(rows, PREFIX, 4000)
    return got.where(F.col("drop_reason") == "oversize").select(
        "rec_id", F.length("user").alias("user_len")
    )


@query("sft_raw")
def clean_fence(rows):
    present = rows.where(F.col("assistant_text").isNotNull())
    return present.select("rec_id", tx.unfence(F.col("assistant_text")).alias("answer"))


@query("sft_raw")
def clean_json_gate(rows):
    present = rows.where(F.col("assistant_text").isNotNull())
    return present.select("rec_id", json_ok(tx.unfence(F.col("assistant_text"))).alias("ok"))


@query("sft_raw")
def clean_canonical(rows):
    kept = clean.clean(rows, SYSTEM, PREFIX).data
    parts = chat.positional(F.col("messages"))
    return kept.select("rec_id", F.size("messages").alias("n_messages"),
                       *[c.alias(n) for n, c in parts.items()])


@query("sft_raw")
def clean_summary(rows):
    return clean.clean(rows, SYSTEM, PREFIX, 4000).summary


@query("sft_raw")
def clean_reasons(rows):
    return clean.reason_counts(clean.classify(rows, PREFIX, 4000))


# -- answers ---------------------------------------------------------------------------


@query("predictions")
def answer_extract(preds):
    return preds.select(
        "case_id", read_answer(F.col("raw_output"), [], "raw", keep_json=True)["json"].alias("json")
    )


@query("predictions")
def answer_extract_clean(preds):
    return preds.select(
        "case_id", read_answer(F.col("raw_output"), [], "clean", keep_json=True)["json"].alias("json")
    )


@query("sft")
def answer_class(rows):
    return rows.select("rec_id", scoring.answer_class(F.col("answer")).alias("cls"))


@query("backtest")
def asserts_long(cases):
    return cases.select("case_pos", F.inline(parse_asserts(F.col("asserts"))))


# -- augment ---------------------------------------------------------------------------


@query("sft")
def augment_fanout(rows):
    classed = augment.with_class(rows.select("rec_id", "answer"))
    return augment.fan_out(classed, augment.variant_count(F.col("cls"))).select(
        "rec_id", "cls", "variant"
    )


@query("sft")
def augment_substitute(rows):
    classed = augment.with_class(rows.select("rec_id", "user_text", "answer"))
    return augment.fill_variants(classed, augment.variant_count(F.col("cls")), SEED).select(
        "rec_id", "variant", "user_text", "answer"
    )


def _three() -> list:
    return [F.col("messages")[i]["content"].alias(n) for i, n in enumerate(("system", "user_text", "answer"))]


@query("sft")
def augment_noise(rows):
    classed = augment.with_class(rows.select("rec_id", "user_text", "answer"))
    fanned = augment.fan_out(classed, augment.variant_count(F.col("cls")))
    return fanned.select("rec_id", "variant", augment.noisy_user(0.003, SEED).alias("user_text"))


@query("sft_raw")
def augment_valid(rows):
    records = rows.where("user_text IS NOT NULL AND assistant_text IS NOT NULL").select(
        "rec_id", "user_text", F.col("assistant_text").alias("answer")
    )
    classed = augment.with_class(records)
    made = augment.variants(classed, augment.variant_count(F.col("cls")), SEED, noise=0.0)
    return made.select("rec_id", "cls", "variant")


@query("sft")
def augment_by_class(rows):
    return augment.augment(rows).by_class


@query("sft")
def augment_dataset(rows):
    """The full job, substitution and noise included."""
    return augment.augment(rows).data.select("rec_id", "variant", "cls", *_three())


# -- mix -------------------------------------------------------------------------------


def _sources(real, synth_rows):
    return {"real": real, "synth": synth_rows}


@query("sft_real", "sft_synth")
def mix_upsample(real, synth_rows):
    both = combine.union_sources(
        {"real": combine.upsample(real, 3), "synth": combine.upsample(synth_rows, 1)}
    )
    return both.select("source_name", "rec_id", "copy")


@query("sft_real", "sft_synth")
def mix_union(real, synth_rows):
    return combine.union_sources(_sources(real, synth_rows)).select(
        "source_name", "rec_id", "cls", "user_text", "answer"
    )


@query("sft_real", "sft_synth")
def mix_shuffle(real, synth_rows):
    both = combine.union_sources(
        {
            "real": combine.upsample(real.select("rec_id"), 3),
            "synth": combine.upsample(synth_rows.select("rec_id"), 1),
        }
    )
    return combine.shuffle_rank(both, SEED).select("source_name", "rec_id", "copy", "rank")


@query("sft_real", "sft_synth")
def mix_counts(real, synth_rows):
    return combine.combine(
        _sources(real, synth_rows), max_user_chars=4000, longest=F.length("user_text")
    ).counts


@query("sft_real", "sft_synth")
def mix_combine(real, synth_rows):
    mixed = combine.combine(
        _sources(real, synth_rows), max_user_chars=4000, longest=F.length("user_text")
    ).data
    return mixed.select("source_name", "rec_id", "copy", "user_text", "answer")


# -- tokens ----------------------------------------------------------------------------


@query("chat")
def token_cap(chats):
    counted = token_filter.with_tokens(chats)
    return token_filter.within(counted, 800).select("rec_id", "n_tokens")


@query("chat")
def token_report(chats):
    return token_filter.token_filter(chats, 800, report_only=True).report


@query("chat")
def token_dropped_top(chats):
    return token_filter.token_filter(chats, 800, report_only=True).dropped_top


@query("chat")
def prepare_training(chats):
    return token_filter.prepare(chats, 800, limit=5, biggest=True)


# -- evaluation ------------------------------------------------------------------------


@query("eval_gold", "predictions")
def eval_join(gold, preds):
    return scoring.score_fields(gold, preds).select(
        "case_id", "outcome", F.coalesce("pred_ok", F.lit(False)).alias("pred_ok"), "raw_len"
    )


@query("eval_gold", "predictions")
def eval_score_long(gold, preds):
    return scoring.long_scores(scoring.score_fields(gold, preds))


@query("eval_gold", "predictions")
def eval_field_accuracy(gold, preds):
    return scoring.field_accuracy(scoring.score_fields(gold, preds))


@query("eval_gold", "predictions")
def eval_summary(gold, preds):
    scored = scoring.score_fields(gold, preds)
    return scoring.pass_summary(scored, F.col("outcome") == "passed")


@query("eval_gold", "predictions")
def eval_failure_samples(gold, preds):
    return scoring.failure_samples(scoring.score_fields(gold, preds))


@query("eval_gold", "predictions")
def eval_unreadable(gold, preds):
    return evaluate.eval_report(gold, preds).unreadable


@query("backtest")
def backtest_score(cases):
    return scoring.score_asserts(cases).select(
        "case_pos", "gold_class", "pred_ok", "passed",
        F.size("checks").alias("n_checks"),
        F.size(F.filter("checks", lambda c: c["match"])).alias("n_match"),
    )


@query("backtest")
def backtest_summary(cases):
    return scoring.pass_summary(scoring.score_asserts(cases), F.col("passed"))


@query("backtest")
def backtest_outcomes(cases):
    return scoring.outcome_counts(scoring.score_asserts(cases))


@query("backtest")
def assert_field_accuracy(cases):
    return scoring.leaf_accuracy(scoring.score_asserts(cases))


@query("backtest")
def confusion_long(cases):
    return scoring.class_pairs(scoring.score_asserts(cases))


@query("backtest")
def confusion_dense(cases):
    """The grid over the classes of the data set."""
    return scoring.confusion_grid(scoring.class_pairs(scoring.score_asserts(cases)), list(focus.CLASS_DEFAULTS))


@query("backtest")
def backtest_running(cases):
    scored = materialise(scoring.score_asserts(cases).select("case_pos", "passed"))
    return evaluate.running_pass_rate(scored)


@query("retest")
def retest_score(rows):
    cases = rows.withColumn(
        "expected",
        F.create_map(
            F.lit("document_classification"), F.col("exp_document_classification"),
            F.lit("case_type_pre_service"), F.col("exp_case_type_pre_service"),
        ),
    )
    return scoring.score_retest(cases).select("case_id", "outcome")


# -- focus -----------------------------------------------------------------------------


@query("backtest")
def focus_categories(cases):
    return focus.categorise(cases).select("case_pos", "gold_class", "category")


@query("backtest")
def focus_anchors(cases):
    return focus.anchors(cases)


@query("backtest")
def focus_donor(cases):
    scored = focus.categorise(cases, keep_json=True).where(
        F.col("gold_class").isNotNull() & ~F.col("pred_ok")
    )
    return focus.with_base(scored, focus.donors(focus.anchor_cases(cases, 1))).select("case_pos", "gold_class", "base")


@query("backtest")
def focus_corrected(cases):
    donors = focus.donors(focus.anchor_cases(cases, 1))
    return focus.corrected(focus.failures(cases), donors).select("case_pos", "gold_class", "corrected")


@query("backtest")
def focus_dataset(cases):
    """The full job, substitution and noise included."""
    return focus.focus(cases, SYSTEM).data.select("rec_id", "kind", "cls", "variant", *_three())


@query("backtest")
def focus_summary(cases):
    return focus.focus(cases, SYSTEM).summary


# -- synth -----------------------------------------------------------------------------


@query("documents", "markers")
def marker_semi(docs, marks):
    narrow = docs.select(F.col("doc_id").alias("rec_id"), "text")
    return markers.containing(narrow, F.col("text"), markers.clean_markers(marks)).select("rec_id")


@query("documents", "markers")
def marker_sharded(docs, marks):
    """As ``marker_semi``, with the list filed in shards as one of any length is."""
    narrow = docs.select(F.col("doc_id").alias("rec_id"), "text")
    return markers.containing(narrow, F.col("text"), markers.clean_markers(marks), listed_bytes=0).select("rec_id")


@query("sft", "markers")
def synth_work(seeds, marks):
    return synth.work_list(seeds, markers.clean_markers(marks))


@query("variants", "sft")
def synth_drift(variants, seeds):
    return synth.gate(variants, seeds).where(F.col("outcome") == "kept").select(
        "seed_id", "variant", "variant_class"
    )


@query("variants", "sft")
def synth_summary(variants, seeds):
    return synth.outcome_counts(synth.gate(variants, seeds))


@query("variants", "sft")
def synth_dataset(variants, seeds):
    data = synth.synth_gate(variants, seeds).data
    parts = chat.positional(F.col("messages"))
    return data.select("seed_id", "variant", parts["system"].alias("system"),
                       parts["user_text"].alias("user_text"))


# -- OCR and detection -----------------------------------------------------------------


@query("ocr_pages")
def ocr_clean(pages):
    return pages.select("doc_id", "page_no", tx.clean_transcription(F.col("text")).alias("text"))


@query("ocr_pages")
def ocr_page_cap(pages):
    kept = ocr.capped_pages(pages.select("doc_id", "page_no"))
    return kept.join(ocr.page_counts(pages), "doc_id")


@query("ocr_pages")
def ocr_assemble(pages):
    return ocr.requests(pages)


@query("ocr_pages")
def ocr_corpus(pages):
    return ocr.corpus(pages)


@query("detections")
def det_geometry(dets):
    shaped = detect.geometry(dets)
    point = F.transform("polygon", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))
    return shaped.select(
        "det_id", "score",
        *[F.col("bbox")[i].alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))],
        F.array_join(point, " ").alias("polygon"),
    )


@query("detections")
def det_per_image(dets):
    return detect.per_image(dets)


# -- routing ---------------------------------------------------------------------------


@query("requests", "routes", "path_routes")
def route_requests(reqs, routes, paths):
    return routing.route(reqs, routes, paths).select(
        "req_id", "requested_model", "status", "error", "backend", "forwarded_model"
    )


@query("requests", "routes", "path_routes")
def route_forward(reqs, routes, paths):
    return routing.route(reqs, routes, paths, forward=True).where(F.col("status") == 200).select(
        "req_id", "backend", "forwarded_body"
    )


@query("requests", "routes", "path_routes")
def route_report(reqs, routes, paths):
    return routing.status_counts(routing.route(reqs, routes, paths))


@query("requests", "routes", "path_routes")
def route_unknown_models(reqs, routes, paths):
    return routing.unknown_models(routing.route(reqs, routes, paths))


@query("requests", "routes_broken", "path_routes_broken")
def route_audit(reqs, routes, paths):
    """Configuration problems, each with the logged requests it touches."""
    problems = routing.audit(routes, paths)
    by_path = reqs.groupBy(F.col("path").alias("subject")).agg(F.count(F.lit(1)).alias("requests"))
    named = F.get_json_object("body", "$.model")
    by_model = (
        reqs.where(F.col("content_type").startswith("application/json"))
        .groupBy(named.alias("subject"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where("subject IS NOT NULL")
    )
    return problems.join(by_path.unionByName(by_model), "subject", "left").select(
        "problem", "subject", F.coalesce("requests", F.lit(0)).cast("long").alias("requests")
    )


# -- inventory -------------------------------------------------------------------------


@query("files")
def inventory_sizes(files):
    return inventory.sizes(files)


@query("files")
def inventory_rollup(files):
    return inventory.totals(files)


@query("registry")
def registry_dedup(registry):
    return inventory.latest_definitions(registry)


@query("registry", "files")
def registry_status(registry, files):
    return inventory.status(registry, files)


@query("registry", "files")
def registry_extra(registry, files):
    return inventory.unregistered(registry, files)


@query("registry", "files")
def inventory_reconcile(registry, files):
    return inventory.reconcile(registry, files)


# -- runs ------------------------------------------------------------------------------


def _metadata(meta):
    return meta.select("dir"), meta.where(F.col("created_at").isNotNull())


@query("run_meta")
def run_catalog(meta):
    return runs.run_catalog(*_metadata(meta))


@query("run_log")
def runlog_status(lines):
    return runs.log_status(lines)


@query("run_meta", "run_log")
def run_report(meta, lines):
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    return runs.run_report(runs.run_catalog(*_metadata(meta)), lines, now)


@query("bench_requests")
def bench_compare(reqs):
    return runs.benchmark(reqs).withColumn("mean_tpot_ms", F.round("mean_tpot_ms", 6))


@query("bench_requests")
def bench_table(reqs):
    return runs.compare_results(runs.benchmark(reqs))


@query("alpaca")
def rank_records(rows):
    keyed = rows.select("rec_id", combine.shuffle_key(SEED, "rec_id").alias("shuffle_key"))
    return ranking.rank_by_digest(keyed, "shuffle_key").select("rec_id", "rank")


# -- streams: the input table is written as files, a stream reads them to the end -------


def _segments(df: DataFrame) -> str:
    path = _scratch(df)
    df.write.json(path)
    return path


@query("run_log")
def stream_runlog_status(lines):
    spark = lines.sparkSession
    out, check = _scratch(lines), _scratch(lines)
    status = jobs.follow_logs(spark, _segments(lines))
    jobs.publish_status(status, out, check, once=True).awaitTermination()
    published = spark.read.parquet(out)
    last = published.select(F.max("batch")).scalar()
    return published.where(F.col("batch") == last).drop("batch")


@query("run_log")
def stream_run_errors(lines):
    """Status with recent errors, followed over two starts of one query."""
    spark = lines.sparkSession
    folder, out, check = _scratch(lines), _scratch(lines), _scratch(lines)
    for part in (0, 1):
        lines.where(F.col("line_no") % 2 == part).write.mode("append").json(folder)
        jobs.publish_changes(jobs.follow_errors(spark, folder), out, check, once=True).awaitTermination()
    return jobs.current_status(spark, out)


@query("requests", "routes", "path_routes")
def stream_route(reqs, routes, paths):
    spark = reqs.sparkSession
    out, check = _scratch(reqs), _scratch(reqs)
    routed = jobs.route_stream(spark, _segments(reqs), routes, paths)
    jobs.persist(routed, out, check, once=True).awaitTermination()
    return spark.read.parquet(out).select(
        "req_id", "requested_model", "status", "error", "backend", "forwarded_model"
    )


@query("backtest")
def stream_score(cases):
    spark = cases.sparkSession
    out, check = _scratch(cases), _scratch(cases)
    scored = jobs.score_stream(spark, _segments(cases))
    jobs.persist(scored, out, check, once=True).awaitTermination()
    return spark.read.parquet(out).select("case_pos", "gold_class", "passed", "outcome")


@query("backtest")
def stream_score_resume(cases):
    """Every case scored once, though a third of them arrives twice and the job starts anew without its checkpoint."""
    spark = cases.sparkSession
    folder, out = _scratch(cases), _scratch(cases)
    cases.where("case_pos % 3 <> 0").write.json(folder)
    jobs.score_once(jobs.case_stream(spark, folder), out, _scratch(cases), once=True).awaitTermination()
    cases.where("case_pos % 3 <> 1").write.mode("append").json(folder)
    jobs.score_once(jobs.case_stream(spark, folder), out, _scratch(cases), once=True).awaitTermination()
    return spark.read.parquet(out).select("case_pos", "gold_class", "passed", "outcome")
