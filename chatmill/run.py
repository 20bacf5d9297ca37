"""Run a job from files to files: ``python -m chatmill.run JOB --help``.

Each command reads, calls one job and writes; reports go to standard output as
JSON lines and are a handful of rows.  Under ``spark-submit`` the session's own
master and settings are used.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from chatmill.functions import tokens
from chatmill.operators import chat, scoring
from chatmill.operators.markers import clean_markers
from chatmill.plans import (
    alpaca, augment, clean, combine, detect, evaluate, focus, inventory, ocr, routing, runs, synth, token_filter,
)
from chatmill.session import configure, materialise
from chatmill.sources import listing, records, tables
from chatmill.streaming import jobs

COUNTERS = {"words": tokens.count_words, "quarter": tokens.count_quarter}


def show(title: str, rows: DataFrame | dict) -> None:
    """Print a report row by row; a DataFrame is fetched one partition at a time."""
    for row in [rows] if isinstance(rows, dict) else map(Row.asDict, rows.toLocalIterator()):
        print(json.dumps({"report": title, **row}, ensure_ascii=False, default=str))


def text_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def run_clean(spark: SparkSession, a: argparse.Namespace) -> None:
    # One pass: both counts are taken while the data is written.  Rejects with their
    # line numbers are a second one, for those who ask for them.
    read, decided = Observation("read"), Observation("decided")
    lines = records.read_jsonl(spark, a.input, counted=read)
    prefix = text_file(spark, a.strip_prefix_file) if a.strip_prefix_file else None
    classified = clean.classify(clean.from_chats(lines.records), prefix, a.max_user_chars).observe(
        decided, *clean.counters()
    )
    records.write_jsonl(clean.kept(classified, text_file(spark, a.system)), a.output)
    found = decided.get
    found["dropped_invalid"] += read.get["malformed"]
    if a.rejects:
        bad = clean.classify(clean.from_chats(lines.records), prefix, a.max_user_chars).where("drop_reason IS NOT NULL")
        bad = lines.numbered(bad.select("src_file", "src_block", "src_row", "drop_reason"))
        malformed = lines.rejects.select("src_file", "line_no", F.lit("malformed").alias("drop_reason"))
        bad.select("src_file", "line_no", "drop_reason").unionByName(malformed).write.json(a.rejects)
    show("clean", found)


def run_augment(spark: SparkSession, a: argparse.Namespace) -> None:
    # Read and parsed once; data and report go on from the table of classed records.
    seeds = materialise(augment.with_class(chat.triples(records.read_jsonl_strict(spark, a.input))))
    made = augment.from_classed(seeds, a.pass_variants, a.fail_variants, a.ocr_noise_rate, a.seed)
    records.write_records(made.data, a.output)
    show("class", made.by_class)


def run_combine(spark: SparkSession, a: argparse.Namespace) -> None:
    read = {n: records.read_jsonl(spark, p) for n, p in (("real", a.real), ("synth", a.synth))}
    sources = {n: lines.records for n, lines in read.items()}
    times = {"real": a.real_multiplier, "synth": a.synth_multiplier}
    mixed = combine.combine(sources, times, a.max_user_chars, shuffle=not a.no_shuffle, seed=a.seed)
    records.write_raw(mixed.data, a.output)  # as read, with any further keys
    show("source", mixed.counts)
    if a.rejects:
        every = [x.rejects.select(F.lit(n).alias("source_name"), "src_file", "line_no") for n, x in read.items()]
        every[0].unionByName(every[1]).write.json(a.rejects)


def run_token_filter(spark: SparkSession, a: argparse.Namespace) -> None:
    counted = token_filter.with_tokens(records.read_jsonl_strict(spark, a.input), COUNTERS[a.counter])
    # Read and counted once; a report needs no texts.
    counted = materialise(counted.select(*records.PLACE, "n_tokens", *([] if a.report_only else ["raw"])))
    result = token_filter.filtered(counted, a.max_tokens, a.report_only)
    top = materialise(result.dropped_top)
    if not top.isEmpty():  # line numbers of the records that are named
        top = records.line_numbers(records.placed_lines(spark, a.input), top)
        show("longest dropped", top.select("rec_id", "n_tokens", "src_file", "line_no").orderBy(F.desc("n_tokens"), "rec_id"))
    show("dropped", result.dropped)
    show("kept", result.report)
    if result.data is not None:
        records.write_raw(result.data, a.output)


def run_synth_plan(spark: SparkSession, a: argparse.Namespace) -> None:
    seeds = chat.triples(records.read_jsonl_strict(spark, a.input))
    if a.max_cases:
        seeds = chat.first_n(seeds, a.max_cases)
    markers = (
        tables.read_markers(spark, a.failure_cases)
        if a.failure_cases
        else clean_markers(spark.createDataFrame([], "marker string"))
    )
    plan = synth.work_list(synth.valid_seeds(seeds), markers, a.pass_variants, a.fail_variants)
    plan.write.parquet(a.output)


def run_synth_gate(spark: SparkSession, a: argparse.Namespace) -> None:
    seeds = chat.triples(records.read_jsonl_strict(spark, a.input))
    variants = spark.read.schema(
        "seed_id long, variant int, variant_text string, label_text string"
    ).format(a.format).load(a.variants)
    gated = synth.synth_gate(variants, seeds)
    records.write_records(gated.data, a.output)
    show("outcome", gated.summary)


def run_focus(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = tables.read_cases(spark, a.backtest, a.format)
    built = focus.focus(
        cases, text_file(spark, a.short_prompt), a.failure_class, a.variants_per_failure,
        a.variants_per_anchor, a.anchors_per_class, a.ocr_noise_rate, a.seed,
    )
    records.write_jsonl(built.data, a.output)
    show("class", built.summary)


def run_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    chats = records.read_jsonl_strict(spark, a.input)
    if a.limit:
        chats = chat.first_n(chats, a.limit)
    gold = records.indexed(chat.triples(chats).select("rec_id", F.col("answer").alias("gold")))
    gold = gold.select(F.col("index").alias("case_id"), "gold")
    predictions = spark.read.schema("case_id long, raw_output string").format(a.format).load(a.predictions)
    report = evaluate.eval_report(gold, predictions)
    report.cases.write.parquet(a.output)
    for title in ("summary", "fields", "samples"):
        show(title, getattr(report, title))


def run_backtest(spark: SparkSession, a: argparse.Namespace) -> None:
    report = evaluate.backtest_report(tables.read_cases(spark, a.input, a.format, a.limit))
    report.cases.join(report.running, "case_pos").write.parquet(a.output)
    for title in ("summary", "outcomes"):
        show(title, getattr(report, title))
    for title in ("fields", "confusion"):  # grouped by free text: written, not printed
        getattr(report, title).write.json(f"{a.output}-{title}")


def run_prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    chats = records.read_jsonl_strict(spark, a.input)
    token_filter.prepare(chats, a.max_tokens, a.limit, a.biggest, COUNTERS[a.counter]).write.parquet(a.output)


def run_alpaca(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_jsonl_strict(spark, a.input, records.ALPACA_SCHEMA)
    done = alpaca.prepare_alpaca(rows, seed=a.seed)
    done.data.write.partitionBy("split").parquet(a.output)
    if a.rejects:
        done.rejects.write.json(a.rejects)
    show("field", done.audit)


def run_ocr(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = spark.read.schema("doc_id long, page_no int, text string").format(a.format).load(a.input)
    ocr.corpus(pages, a.page_cap).write.parquet(a.output)


def run_detections(spark: SparkSession, a: argparse.Namespace) -> None:
    schema = "det_id long, image_id long, score double, box string"
    detect.per_image(spark.read.schema(schema).format(a.format).load(a.input), a.threshold).write.parquet(a.output)


def run_route(spark: SparkSession, a: argparse.Namespace) -> None:
    requests = spark.read.schema(jobs.REQUEST_SCHEMA).format(a.format).load(a.input)
    routes = spark.read.schema("backend string, url string, served_model string, model string").json(a.routes)
    paths = spark.read.schema("path string, backend string").json(a.path_routes)
    report = routing.routing_report(requests, routes, paths)
    report.routed.write.parquet(a.output)
    routed = spark.read.parquet(a.output)  # the reports read what was written, the requests are routed once
    routing.unknown_models(routed).write.json(f"{a.output}-unknown-models")
    show("problem", report.audit)
    show("status", routing.status_counts(routed))


def run_inventory(spark: SparkSession, a: argparse.Namespace) -> None:
    registry = spark.read.schema("alias string, hf_id string, serve_backend string, line_no long").json(a.registry)
    files = listing.scan_files(spark, a.root)
    inventory.reconcile(registry, files).write.json(a.output)
    inventory.totals(files).write.json(f"{a.output}-totals")


def run_runs(spark: SparkSession, a: argparse.Namespace) -> None:
    read = tables.read_metadata(spark, a.metadata)
    meta = read.data
    if a.rejects:
        read.rejects.write.json(a.rejects)
    catalog = runs.run_catalog(meta.select("dir"), meta)
    runs.run_report(catalog, tables.read_log(spark, a.logs)).write.json(a.output)


def run_bench(spark: SparkSession, a: argparse.Namespace) -> None:
    read = tables.read_results(spark, a.results)
    runs.compare_results(read.data).write.json(a.output)
    if a.rejects:
        read.rejects.write.json(a.rejects)


def run_retest(spark: SparkSession, a: argparse.Namespace) -> None:
    outputs = spark.read.schema("case_name string, raw_output string").format(a.format).load(a.outputs)
    cases = tables.read_retest(spark, a.cases).join(outputs, "case_name", "left")
    scored = scoring.score_retest(cases)
    scored.select("case_id", "case_name", "outcome").write.json(a.output)
    show("outcome", evaluate.retest_report(cases))


def run_follow(spark: SparkSession, a: argparse.Namespace) -> None:
    status = jobs.follow_errors(spark, a.input, forget=not a.once)
    jobs.publish_changes(status, a.output, a.checkpoint, a.once).awaitTermination()


def run_route_stream(spark: SparkSession, a: argparse.Namespace) -> None:
    routes = spark.read.schema("backend string, url string, served_model string, model string").json(a.routes)
    paths = spark.read.schema("path string, backend string").json(a.path_routes)
    routed = jobs.route_stream(spark, a.input, routes, paths)
    jobs.persist(routed, a.output, a.checkpoint, a.once).awaitTermination()


def run_score_stream(spark: SparkSession, a: argparse.Namespace) -> None:
    jobs.score_once(jobs.case_stream(spark, a.input), a.output, a.checkpoint, a.once).awaitTermination()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chatmill", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name, fn, *required):
        sub = commands.add_parser(name)
        sub.set_defaults(fn=fn)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    c = command("clean", run_clean, "input", "output", "system")
    c.add_argument("--strip-prefix-file")
    c.add_argument("--rejects")
    c.add_argument("--max-user-chars", type=int, default=clean.MAX_USER_CHARS)

    c = command("augment", run_augment, "input", "output")
    c.add_argument("--pass-variants", type=int, default=4)
    c.add_argument("--fail-variants", type=int, default=12)
    c.add_argument("--ocr-noise-rate", type=float, default=0.003)
    c.add_argument("--seed", type=int, default=42)

    c = command("combine", run_combine, "real", "synth", "output")
    c.add_argument("--real-multiplier", type=int, default=3)
    c.add_argument("--synth-multiplier", type=int, default=1)
    c.add_argument("--max-user-chars", type=int)
    c.add_argument("--no-shuffle", action="store_true")
    c.add_argument("--rejects")
    c.add_argument("--seed", type=int, default=42)

    c = command("token-filter", run_token_filter, "input", "output")
    c.add_argument("--max-tokens", type=int, required=True)
    c.add_argument("--counter", choices=COUNTERS, default="words")
    c.add_argument("--report-only", action="store_true")

    c = command("synth-plan", run_synth_plan, "input", "output")
    c.add_argument("--pass-variants", type=int, default=4)
    c.add_argument("--fail-variants", type=int, default=12)
    c.add_argument("--failure-cases")
    c.add_argument("--max-cases", type=int)

    c = command("synth-gate", run_synth_gate, "input", "variants", "output")
    c.add_argument("--format", default="json")

    c = command("focus", run_focus, "backtest", "short-prompt", "output")
    c.add_argument("--format", default="parquet")
    c.add_argument("--failure-class", default=focus.FAILURE_CLASS)
    c.add_argument("--variants-per-failure", type=int, default=40)
    c.add_argument("--variants-per-anchor", type=int, default=15)
    c.add_argument("--anchors-per-class", type=int, default=6)
    c.add_argument("--ocr-noise-rate", type=float, default=0.003)
    c.add_argument("--seed", type=int, default=42)

    c = command("eval", run_eval, "input", "predictions", "output")
    c.add_argument("--format", default="json")
    c.add_argument("--limit", type=int)

    c = command("backtest", run_backtest, "input", "output")
    c.add_argument("--format", default="parquet")
    c.add_argument("--limit", type=int)

    c = command("prepare", run_prepare, "input", "output")
    c.add_argument("--max-tokens", type=int, required=True)
    c.add_argument("--counter", choices=COUNTERS, default="words")
    c.add_argument("--limit", type=int)
    c.add_argument("--biggest", action="store_true")

    c = command("alpaca", run_alpaca, "input", "output")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--rejects")

    c = command("ocr", run_ocr, "input", "output")
    c.add_argument("--format", default="json")
    c.add_argument("--page-cap", type=int, default=ocr.PAGE_CAP)

    c = command("detections", run_detections, "input", "output")
    c.add_argument("--format", default="json")
    c.add_argument("--threshold", type=float, default=detect.BOX_THRESHOLD)

    c = command("route", run_route, "input", "routes", "path-routes", "output")
    c.add_argument("--format", default="json")

    command("inventory", run_inventory, "registry", "root", "output")
    command("runs", run_runs, "metadata", "logs", "output").add_argument("--rejects")
    command("bench", run_bench, "results", "output").add_argument("--rejects")

    c = command("retest", run_retest, "cases", "outputs", "output")
    c.add_argument("--format", default="json")

    for name, fn, more in (("follow-logs", run_follow, ()), ("route-stream", run_route_stream, ("routes", "path-routes")),
                           ("score-stream", run_score_stream, ())):
        c = command(name, fn, "input", "output", "checkpoint", *more)
        c.add_argument("--once", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.fn(configure(SparkSession.builder.appName("chatmill").getOrCreate()), args)


if __name__ == "__main__":
    main(sys.argv[1:])
