"""Training runs: log status, run catalog and benchmark comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.numbers import fixed
from chatmill.operators.ranking import exact_percentiles, top_per_group

# What a log line must hold to count.
STEP = "'loss':"
LOSS = r"'loss': ([0-9.]+)"
EPOCH = r"'epoch': ([0-9.]+)"
RATE = r"'learning_rate': ([0-9.eE+-]+)"
DONE = "Adapter saved to"
FINAL = r"final_loss\D*([0-9.]+)"
ERRORS = r"(?i)error|traceback|exception"


def _number(line: Column, pattern: str) -> Column:
    return F.regexp_extract(line, pattern, 1).try_cast("double")


def parse_lines(lines: DataFrame, *more: Column) -> DataFrame:
    """Numbers and flags of each log line, and whatever columns are asked for besides."""
    value = F.col("value")
    is_step = value.contains(STEP)
    return lines.select(
        "run",
        "line_no",
        is_step.alias("is_step"),
        F.when(is_step, _number(value, LOSS)).alias("loss"),
        F.when(is_step, _number(value, EPOCH)).alias("epoch"),
        F.when(is_step, _number(value, RATE)).alias("learning_rate"),
        value.contains(DONE).alias("is_done"),
        F.when(value.contains("final_loss"), _number(value, FINAL)).alias("final_loss"),
        *more,
    )


def latest(parsed: DataFrame) -> DataFrame:
    """Latest step and completion per run.

    Three scalar ``max_by`` over fixed-width values, which aggregate by hash map
    side; also usable on a stream.
    """
    at_step = F.when(F.col("is_step"), F.col("line_no"))
    return parsed.groupBy("run").agg(
        F.max_by("loss", at_step).alias("loss"),
        F.max_by("epoch", at_step).alias("epoch"),
        F.max_by("learning_rate", at_step).alias("learning_rate"),
        F.bool_or("is_done").alias("completed"),
        F.max_by("final_loss", F.when(F.col("final_loss").isNotNull(), F.col("line_no"))).alias(
            "final_loss"
        ),
    )


def recent_errors(lines: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` error lines of each run, oldest first, joined by newlines."""
    bad = lines.where(F.col("value").rlike(ERRORS)).select("run", "line_no", "value")
    last = top_per_group(bad, ["run"], [F.desc("line_no")], n)
    return last.groupBy("run").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda e: e["value"]
            ),
            "\n",
        ).alias("recent_errors")
    )


def log_status(lines: DataFrame) -> DataFrame:
    """Latest step, completion and recent errors of every run."""
    return latest(parse_lines(lines)).join(recent_errors(lines), "run", "left")


def elapsed(started: Column, now: Column) -> Column:
    """``1h 2m 3s`` between two timestamps."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(started)
    return F.when(
        F.unix_timestamp(started) > 0,
        F.format_string(
            "%dh %dm %ds",
            F.floor(seconds / 3600).cast("long"),
            F.floor(seconds % 3600 / 60).cast("long"),
            (seconds % 60).cast("long"),
        ),
    )


def run_catalog(dirs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every run directory with its metadata; without one, ``created_at`` is ``unknown``."""
    return dirs.join(metadata, "dir", "left").withColumn(
        "created_at", F.coalesce("created_at", F.lit("unknown"))
    )


def run_report(catalog: DataFrame, lines: DataFrame, now: Column | None = None) -> DataFrame:
    """The whole job: catalog joined to log status, with elapsed time."""
    started = F.col("created_at").try_cast("timestamp")
    joined = catalog.join(log_status(lines).withColumnRenamed("run", "dir"), "dir", "left")
    return joined.withColumn("elapsed", elapsed(started, now if now is not None else F.current_timestamp()))


# -- benchmark -------------------------------------------------------------------------

# The columns of the comparison, in report order.
SHOWN = (
    "request_throughput", "output_throughput", "p50_ttft_ms", "p99_ttft_ms", "mean_tpot_ms",
    "p99_e2el_ms",
)


PERCENTILES = (50, 90, 95, 99)


def compare_results(results: DataFrame) -> DataFrame:
    """Comparison rows from result files: two decimals, a dash for a missing number."""

    def shown(name: str) -> Column:
        if name not in results.columns:
            return F.lit("-").alias(name)
        return F.coalesce(fixed(F.col(name).cast("double"), 2), F.lit("-")).alias(name)

    failed = F.coalesce("failed", F.lit(0)) if "failed" in results.columns else F.lit(0)
    concurrency = F.coalesce(F.col("max_concurrency").cast("string"), F.lit("-"))
    return results.select(
        concurrency.alias("max_concurrency"), *[shown(n) for n in SHOWN], failed.alias("failed")
    )


def benchmark(requests: DataFrame) -> DataFrame:
    """Result rows per concurrency from single requests, with exact percentiles.

    Failed requests count only as failed.  Time per output token spreads what is
    left after the first token over the other tokens.
    """
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp")))
            - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    tpot = F.try_divide(F.col("e2e_ms") - F.col("ttft_ms"), F.col("output_tokens") - 1)
    ok = F.col("failed") == 0
    measured = {f"_{n}": F.when(ok, F.col(c)) for n, c in (("ttft", "ttft_ms"), ("e2e", "e2e_ms"))}
    exact = exact_percentiles(requests, ["concurrency"], measured, [q / 100 for q in PERCENTILES])
    totals = requests.groupBy(F.col("concurrency").alias("max_concurrency")).agg(
        F.count_if(ok).alias("completed"),
        F.sum(F.when(ok, F.col("output_tokens"))).alias("_tokens"),
        F.sum("failed").cast("long").alias("failed"),
        F.avg(F.when(ok, tpot)).alias("mean_tpot_ms"),
        span.alias("_span"),
    )
    return (
        totals.join(exact, F.col("max_concurrency").eqNullSafe(F.col("concurrency")), "left").drop("concurrency").select("*", *[F.col("_ttft")[i].alias(f"p{q}_ttft_ms") for i, q in enumerate(PERCENTILES)],
                      *[F.col("_e2e")[i].alias(f"p{q}_e2el_ms") for i, q in enumerate(PERCENTILES)])
        .withColumn("request_throughput", F.try_divide("completed", "_span"))
        .withColumn("output_throughput", F.try_divide("_tokens", "_span"))
        .drop("_tokens", "_span", "_ttft", "_e2e")
    )
