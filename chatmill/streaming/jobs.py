"""The streaming forms of log following, request routing and incremental scoring.

Each reuses the column logic of its batch job, so stream and batch agree.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatmill.plans import evaluate, routing, runs
from chatmill.sources.tables import CASE_SCHEMA

# Ship the state function with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUEST_SCHEMA = "req_id long, path string, content_type string, body string, model_header string"


def follow_logs(spark: SparkSession, path: str) -> DataFrame:
    """Latest step and completion per run while log segments arrive.

    The file source sees new files, not appended bytes: writers roll segments of
    ``(run, line_no, value)`` JSON lines.  State is one fixed-width row per run.
    Run it in update or complete mode.
    """
    lines = spark.readStream.schema("run string, line_no long, value string").json(path)
    return runs.latest(runs.parse_lines(lines))


#: What is known of a run: its latest step, its end, and its last error lines as JSON ``[[line_no, text], ...]``.
RUN_STATE = "step_at long, loss double, epoch double, learning_rate double, completed boolean, final_at long, final_loss double, errors string"
RUN_STATUS = "run string, loss double, epoch double, learning_rate double, completed boolean, final_loss double, recent_errors string"
KEPT_ERRORS = 3
_NEVER = -(1 << 63)


def _value(x):
    return None if x is None or x != x else x


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, forget: bool = False) -> Iterator[pd.DataFrame]:
    """Fold the new lines of one run into its state; the state has one row and at most three lines of text."""
    if state.hasTimedOut:  # a finished run that has been silent
        state.remove()
        return
    step_at, loss, epoch, rate, completed, final_at, final, errors = (
        state.get if state.exists else (_NEVER, None, None, None, False, _NEVER, None, "[]")
    )
    errors = json.loads(errors)
    for frame in frames:
        steps = frame[frame["is_step"]]
        if len(steps) and steps["line_no"].max() > step_at:
            row = steps.loc[steps["line_no"].idxmax()]
            step_at, loss, epoch, rate = int(row["line_no"]), *(_value(row[c]) for c in ("loss", "epoch", "learning_rate"))
        finals = frame[frame["final_loss"].notna()]
        if len(finals) and finals["line_no"].max() > final_at:
            row = finals.loc[finals["line_no"].idxmax()]
            final_at, final = int(row["line_no"]), float(row["final_loss"])
        completed = completed or bool(frame["is_done"].any())
        bad = frame[frame["error"].notna()]
        errors += [[int(n), text] for n, text in zip(bad["line_no"], bad["error"])]
        errors = sorted(errors)[-KEPT_ERRORS:]
    state.update((step_at, loss, epoch, rate, completed, final_at, final, json.dumps(errors)))
    if completed and forget:
        state.setTimeoutDuration(FORGOTTEN_MS)
    told = "\n".join(text for _, text in errors) if errors else None
    yield pd.DataFrame(
        [(key[0], loss, epoch, rate, completed, final, told)], columns=[f.split()[0] for f in RUN_STATUS.split(", ")]
    ).astype({"loss": "float64", "epoch": "float64", "learning_rate": "float64", "final_loss": "float64"})


#: Completed runs that stay silent for so long are forgotten; their last status stays published.
FORGOTTEN_MS = 7 * 24 * 3600 * 1000


def follow_errors(spark: SparkSession, path: str, forget: bool = False) -> DataFrame:
    """As ``follow_logs``, with the last error lines of each run: rows of the runs that have new lines.

    Only error lines carry their text to the state.  Run it in update mode with ``publish_changes``.
    ``forget`` removes the state of completed runs that stay silent; a query that is to end when
    all files are read must do without, as timers keep it going.
    """
    lines = spark.readStream.schema("run string, line_no long, value string").json(path)
    error = F.when(F.col("value").rlike(runs.ERRORS), F.col("value")).alias("error")
    told = runs.parse_lines(lines, error)
    return told.groupBy("run").applyInPandasWithState(
        lambda key, frames, state: _follow(key, frames, state, forget), RUN_STATUS, RUN_STATE, "update",
        GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout,
    )


def route_stream(
    spark: SparkSession, path: str, routes: DataFrame, path_routes: DataFrame, fmt: str = "json"
) -> DataFrame:
    """Routed requests as they arrive; stateless, append mode."""
    incoming = spark.readStream.schema(REQUEST_SCHEMA).format(fmt).load(path)
    return routing.route(incoming, routes, path_routes)


def case_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Named cases as their outputs arrive."""
    return spark.readStream.schema(CASE_SCHEMA).format(fmt).load(path).where(F.col("name").isNotNull())


def score_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Cases scored as their outputs arrive; stateless, append mode, every arrival is scored."""
    return evaluate.narrow_scores(case_stream(spark, path, fmt))


def _writer(stream: DataFrame, checkpoint: str, once: bool) -> DataStreamWriter:
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer


def persist(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to parquet exactly once: a restarted query goes on after the last commit."""
    return _writer(stream, checkpoint, once).format("parquet").outputMode("append").start(out)


def publish_status(
    status: DataFrame, out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write the full status table of every trigger to its own ``batch=N`` folder.

    Writing a batch again after a failure replaces its folder.
    """

    def write(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _writer(status, checkpoint, once).outputMode("complete").foreachBatch(write).start()


def publish_changes(status: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the rows of every trigger to their own ``batch=N`` folder; ``current_status`` reads the table."""

    def write(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return _writer(status, checkpoint, once).outputMode("update").foreachBatch(write).start()


def _latest(rows: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in RUN_STATUS.split(", ")]
    newest = rows.groupBy("run").agg(F.max_by(F.struct(*names[1:]), "batch").alias("row"), F.max("batch").alias("batch"))
    return newest.select("run", "row.*", "batch")


def current_status(spark: SparkSession, out: str) -> DataFrame:
    """The last published row of every run."""
    return _latest(spark.read.schema(f"{RUN_STATUS}, batch long").parquet(out)).drop("batch")


def compact_status(spark: SparkSession, out: str, to: str) -> None:
    """Write one row a run to the new table ``to``, to which further triggers may be published."""
    latest = _latest(spark.read.schema(f"{RUN_STATUS}, batch long").parquet(out))
    latest.write.partitionBy("batch").parquet(to)


def score_once(cases: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score every case once, however often it arrives and however often the job is started anew.

    A trigger leaves out the cases that are in the table already, whichever run
    has scored them; of repeated arrivals in one trigger one row remains (the
    least).  A trigger that is repeated after a failure replaces its own folder.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    keys = "case_pos long, run string, batch long"

    def write(arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        folder = f"{out}/run={run}/batch={batch}"
        own = (F.col("run") == run) & (F.col("batch") == batch)
        # The table may not exist before the first trigger; an empty folder of this run makes it one.
        blank = evaluate.narrow_scores(arrived.limit(0))
        blank.write.mode("append").parquet(folder)
        done = spark.read.schema(keys).parquet(out).where(~own).select("case_pos").distinct()
        scored = evaluate.narrow_scores(arrived.join(done, "case_pos", "left_anti"))
        rest = [c for c in scored.columns if c != "case_pos"]
        each = scored.groupBy("case_pos").agg(F.min(F.struct(*rest)).alias("row")).select("case_pos", "row.*")
        each.select(*scored.columns).write.mode("overwrite").parquet(folder)

    return _writer(cases, checkpoint, once).foreachBatch(write).start()
