import json

import pytest

from chatmill.plans import evaluate, routing, runs
from chatmill.sources.tables import CASE_SCHEMA
from chatmill.streaming import jobs

PATHS = [("/v1/detect", "det")]
ROUTES = [("big", "http://b", "org/Big", "m0"), ("det", "http://d", "det-1", "det-1")]


def write(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def log_lines(start, n):
    out = []
    for i in range(start, start + n):
        text = f"{{'loss': {i}.5, 'learning_rate': 1e-4, 'epoch': {i}}}" if i % 3 == 0 else f"info {i}"
        out.append({"run": f"r{i % 4}", "line_no": i, "value": "Adapter saved to x" if i == 37 else text})
    return out


def test_followed_logs_equal_batch(spark, tmp_path):
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    write(folder, "0.json", log_lines(0, 25))
    for segment in (None, log_lines(25, 30)):
        if segment:
            write(folder, "1.json", segment)
        jobs.publish_status(jobs.follow_logs(spark, str(folder)), out, check, once=True).awaitTermination()
    latest = spark.read.parquet(out)
    last = latest.agg({"batch": "max"}).first()[0]
    streamed = latest.where(f"batch = {last}").drop("batch")
    lines = spark.read.schema("run string, line_no long, value string").json(str(folder))
    batch = runs.latest(runs.parse_lines(lines))
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_routed_stream_equals_batch(spark, rows, tmp_path):
    folder = tmp_path / "in"
    requests = [
        {"req_id": i, "path": "/v1/detect" if i % 3 else "/v1/chat", "content_type": "application/json",
         "body": json.dumps({"model": f"m{i % 2}"}) if i % 4 else "{bad", "model_header": None}
        for i in range(40)
    ]
    write(folder, "0.json", requests[:20])
    write(folder, "1.json", requests[20:])
    routes = rows(ROUTES, "backend string, url string, served_model string, model string")
    paths = rows(PATHS, "path string, backend string")
    stream = jobs.route_stream(spark, str(folder), routes, paths)
    jobs.persist(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = routing.route(spark.read.schema(jobs.REQUEST_SCHEMA).json(str(folder)), routes, paths)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_scoring_resumes_without_loss_or_duplicates(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    assertion = 'c | j @$.a | expected="1"'

    def cases(start, n):
        return [
            {"case_pos": i, "name": f"n{i}", "input": "", "asserts": assertion, "output": json.dumps({"a": i % 3})}
            for i in range(start, start + n)
        ]

    write(folder, "0.json", cases(0, 10))
    for name, start in ((None, 0), ("1.json", 10), ("2.json", 20)):  # three runs of the same query
        if name:
            write(folder, name, cases(start, 10))
        jobs.persist(jobs.score_stream(spark, str(folder)), out, check, once=True).awaitTermination()
    scored = spark.read.parquet(out)
    assert sorted(r.case_pos for r in scored.collect()) == list(range(30))
    batch = evaluate.narrow_scores(spark.read.schema(CASE_SCHEMA).json(str(folder)))
    assert sorted(map(str, scored.collect())) == sorted(map(str, batch.collect()))


def noisy(start, n):
    """Log lines with errors; every seventh line is older than the ones before it."""
    out = []
    for i in range(start, start + n):
        text = "ERROR at %d\nsecond line" % i if i % 4 == 1 else f"{{'loss': {i}.5, 'epoch': {i}}}" if i % 3 == 0 else "info"
        text = f"final_loss: {i}.25" if i % 23 == 5 else text
        out.append({"run": f"r{i % 3}", "line_no": i - 50 if i % 7 == 0 else i, "value": "Adapter saved to x" if i == 40 else text})
    return out + [{"run": f"quiet{start}", "line_no": 1, "value": "nothing yet"}]


def test_followed_errors_equal_batch_and_survive_restarts(spark, tmp_path):
    """Three runs of the query over one checkpoint; each publishes only the runs that have new lines."""
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    for name, segment in (("0.json", noisy(0, 45)), ("1.json", noisy(45, 40)), ("2.json", [{"run": "r1", "line_no": 999, "value": "Exception last"}])):
        write(folder, name, segment)
        jobs.publish_changes(jobs.follow_errors(spark, str(folder)), out, check, once=True).awaitTermination()
        lines = spark.read.schema("run string, line_no long, value string").json(str(folder))
        batch = runs.log_status(lines)
        got = jobs.current_status(spark, out).select(batch.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert spark.read.parquet(f"{out}/batch=2").count() == 1
    jobs.compact_status(spark, out, str(tmp_path / "compact"))
    small = jobs.current_status(spark, str(tmp_path / "compact")).select(batch.columns)
    assert sorted(map(str, small.collect())) == sorted(map(str, batch.collect()))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == batch.count()


def test_state_keeps_three_lines_a_run():
    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, _):
            self.timer = True

    import pandas as pd

    state = State()
    for start in range(0, 3000, 100):
        n = range(start, start + 100)
        frame = pd.DataFrame({"line_no": n, "is_step": False, "loss": None, "epoch": None, "learning_rate": None, "is_done": start == 2900,
                              "final_loss": None, "error": [f"error {i}" for i in n]})
        (row,) = jobs._follow(("r",), iter([frame]), state, forget=True)
    assert json.loads(state.get[-1]) == [[i, f"error {i}"] for i in (2997, 2998, 2999)] and state.timer
    assert row["recent_errors"][0] == "error 2997\nerror 2998\nerror 2999"


@pytest.mark.parametrize("anew", [False, True])
def test_cases_that_arrive_twice_are_scored_once(spark, tmp_path, anew):
    """Repeats within a segment, across segments and, with a new checkpoint, of everything."""
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def cases(numbers, answer=lambda i: i % 3):
        return [
            {"case_pos": i, "name": f"n{i}", "input": "", "asserts": 'c | j @$.a | expected="1"', "output": json.dumps({"a": answer(i)})}
            for i in numbers
        ]

    for turn, numbers in enumerate(([*range(10), 3, 3], range(5, 20), [*range(15, 25), 0])):
        write(folder, f"{turn}.json", cases(numbers))
        check = str(tmp_path / (f"check{turn}" if anew else "check"))
        jobs.score_once(jobs.case_stream(spark, str(folder)), out, check, once=True).awaitTermination()
    scored = spark.read.parquet(out).drop("run", "batch")
    assert sorted(r.case_pos for r in scored.collect()) == list(range(25))
    batch = evaluate.narrow_scores(spark.read.schema(CASE_SCHEMA).json(str(folder))).distinct()
    assert sorted(map(str, scored.collect())) == sorted(map(str, batch.collect()))
