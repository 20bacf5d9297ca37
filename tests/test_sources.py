import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from chatmill.plans import inventory, runs
from chatmill.sources import listing, records, tables


def chat_line(i, **extra):
    return json.dumps({"messages": [{"role": "user", "content": f"é{i}\n"}], **extra}, ensure_ascii=False)


@pytest.fixture()
def jsonl(tmp_path):
    (tmp_path / "a.jsonl").write_text(
        "\n".join([chat_line(0), "", "{bad", chat_line(1, tag="x") + " trailing", "  ", chat_line(2, tag="y")]) + "\n"
    )
    (tmp_path / "b.jsonl").write_text(chat_line(3))
    return str(tmp_path)


def scans(df):
    """Leaves of the physical plan that read text files."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan text"), "Window" in plan


def test_lenient_read_places_lines_and_keeps_rejects(spark, jsonl):
    lines = records.read_jsonl(spark, jsonl)
    got = lines.records.orderBy("rec_id").collect()
    assert [r.messages[0].content for r in got] == ["é0\n", "é2\n", "é3\n"]
    numbered = lines.numbered(lines.records.select("src_file", "src_block", "src_row", "rec_id")).orderBy("rec_id").collect()
    assert [(r.src_file[-7:], r.line_no) for r in numbered] == [("a.jsonl", 1), ("a.jsonl", 6), ("b.jsonl", 1)]
    assert sorted((r.line_no, r.raw[:4]) for r in lines.rejects.collect()) == [(3, "{bad"), (4, '{"me')]


def test_records_take_one_scan_and_change_no_setting(spark, jsonl):
    before = spark.conf.getAll
    lines = records.read_jsonl(spark, jsonl)
    assert scans(lines.records) == (1, False)
    assert scans(records.read_jsonl_strict(spark, f"{jsonl}/b.jsonl")) == (1, False)
    assert lines.records.count() == 3 and spark.conf.getAll == before
    assert lines.records.sparkSession is spark or lines.records.sparkSession.sparkContext is spark.sparkContext


def test_one_pass_read_counts_on_the_way(spark, jsonl):
    counted = Observation("lines")
    lines = records.read_jsonl(spark, jsonl, counted=counted)
    got = lines.records.collect()
    assert len({r.rec_id for r in got}) == len(got) == 3
    assert counted.get == {"records": 3, "malformed": 2}
    assert [r["index"] for r in records.indexed(lines.records.drop("raw")).orderBy("index").collect()] == [0, 1, 2]


def test_places_over_many_splits_and_files(spark, tmp_path):
    """Full and short splits of long files, packed short files, a compressed one and a name with a space."""
    sizes = {"a big.jsonl": 30_000, "b.jsonl": 5, "c.jsonl": 700, "d.jsonl": 1, "e.jsonl": 12_000}
    sizes |= {f"s{i:03d}.jsonl": i % 4 for i in range(60)}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f'{{"messages": [], "n": {i}}}\n' if i % 50 else "\n" for i in range(n)))
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as out:
        out.write("".join(f'{{"messages": [], "n": {i}}}\n' for i in range(40_000)))
    lines = records.placed_lines(spark, str(tmp_path), split=40_000)
    assert lines.rdd.getNumPartitions() > 20
    got = records.line_numbers(lines, lines).withColumn("n", F.get_json_object("raw", "$.n").cast("long"))
    assert got.count() == sum(sizes.values()) + 40_000 == lines.select("rec_id").distinct().count()
    assert got.where("n IS NOT NULL AND n + 1 <> line_no").count() == 0
    order = got.select("src_file", "line_no", F.row_number().over(Window.orderBy("rec_id")).alias("at"))
    by_name = got.select("src_file", "line_no", F.row_number().over(Window.orderBy("src_file", "line_no")).alias("want"))
    assert order.join(by_name, ["src_file", "line_no"]).where("at <> want").count() == 0
    some = got.where("n % 1000 = 7").select("src_file", "src_block", "src_row", "n", "rec_id")
    assert records.line_numbers(lines, some).where("n + 1 <> line_no").count() == 0
    index = records.indexed(lines.drop("raw"))
    assert index.agg(F.min("index"), F.max("index"), F.countDistinct("index")).first()[:] == (0, lines.count() - 1, lines.count())


def test_ids_do_not_depend_on_cores_or_split_settings(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"messages": [], "n": {i}}}\n' for i in range(5000)))
    (tmp_path / "y.jsonl").write_text('{"messages": []}\n')
    read = lambda: sorted(map(tuple, records.placed_lines(spark, str(tmp_path), 30_000).select("rec_id", "raw").collect()))
    first = read()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.minPartitionNum", "77")
    try:
        assert read() == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_strict_read_aborts(spark, jsonl, tmp_path):
    with pytest.raises(PySparkException, match="malformed JSON"):
        records.read_jsonl_strict(spark, jsonl).collect()
    assert records.read_jsonl_strict(spark, jsonl + "/b.jsonl").count() == 1


def test_sink_round_trip(spark, jsonl, tmp_path):
    got = records.read_jsonl(spark, jsonl).records
    records.write_jsonl(got, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "é0" in text and "\\u00e9" not in text
    back = records.read_jsonl_strict(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.select("messages").collect())) == sorted(map(str, got.select("messages").collect()))
    records.write_raw(got, str(tmp_path / "raw"))
    raw = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "raw")).collect()]
    assert sorted(r.get("tag", "") for r in raw) == ["", "", "y"]


def test_dataset_by_key(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"instruction": "i", "output": "o"}\n{"instruction": "j"}\n')
    registry = {"k": {"path": "d.jsonl", "format": "alpaca", "split": [0.9, 0.05, 0.05]}, "z": {"path": "/x", "format": "q"}}
    got = records.read_dataset(spark, registry, "k", str(tmp_path)).orderBy("rec_id").collect()
    assert [(r.instruction, r.input, r.output) for r in got] == [("i", None, "o"), ("j", None, None)]
    assert records.resolve(registry, "z", "/root") == "/x"
    with pytest.raises(ValueError):
        records.read_dataset(spark, registry, "z")
    with pytest.raises(KeyError):
        records.read_dataset(spark, registry, "none")


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_case_table(spark, rows, tmp_path, fmt):
    data = [(0, None, "x", "a", "o"), (1, "n1", None, None, 'say "hi",\nbye'), (2, "n2", "i", "a", "o")]
    cases = rows(data, tables.CASE_SCHEMA)
    assert tables.tidy_cases(cases, 2).collect() == [(1, "n1", "", "", 'say "hi",\nbye')]
    named = tables.tidy_cases(cases)
    tables.write_cases(named, str(tmp_path / "c"), fmt)
    assert sorted(tables.read_cases(spark, str(tmp_path / "c"), fmt).collect()) == sorted(named.collect())


def test_markers_retest_results_metadata_logs_and_listing(spark, tmp_path):
    (tmp_path / "m.txt").write_text("  one \n\none\n two\t\n")
    assert sorted(r[0] for r in tables.read_markers(spark, str(tmp_path / "m.txt")).collect()) == ["one", "two"]

    (tmp_path / "r.jsonl").write_text(
        '{"case_name": "a", "input_text": "t", "expected_failures": {"f": "v"}}\n'
        '{"case_name": "b", "input_text": "u", "expected_failures": [["g", "w"], ["h", "x"]]}\n'
    )
    got = tables.read_retest(spark, str(tmp_path / "r.jsonl")).orderBy("case_id").collect()
    assert [(r.case_name, r.expected) for r in got] == [("a", {"f": "v"}), ("b", {"g": "w", "h": "x"})]

    res = tmp_path / "res"
    res.mkdir()
    (res / "1.json").write_text('{\n "max_concurrency": 1, "request_throughput": 1.005, "p50_ttft_ms": 12.5, "failed": 2}')
    (res / "2.json").write_text('{"max_concurrency": 2}')
    shown = runs.compare_results(tables.read_results(spark, str(res)).data).orderBy("max_concurrency").collect()
    assert [(r.p50_ttft_ms, r.p99_ttft_ms, r.failed) for r in shown] == [("12.50", "-", 2), ("-", "-", 0)]

    for name, text in {"run-b": '{"adapter_name": "b", "created_at": "2024-01-01T00:00:00Z", "rank": 8}', "run-a": None}.items():
        d = tmp_path / "adapters" / name
        d.mkdir(parents=True)
        if text:
            (d / "metadata.json").write_text(text)
    meta = tables.read_metadata(spark, str(tmp_path / "adapters")).data
    dirs = spark.createDataFrame([("run-a",), ("run-b",)], "dir string")
    catalog = {r.dir: (r.created_at, r["rank"]) for r in runs.run_catalog(dirs, meta).collect()}
    assert catalog == {"run-a": ("unknown", None), "run-b": ("2024-01-01T00:00:00Z", 8)}

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "run-b.log").write_text(
        "{'loss': 2.0, 'learning_rate': 1e-4, 'epoch': 0.5}\nERROR one\n{'loss': 1.5, 'epoch': 1.0}\n"
        "Exception two\nerror three\ntraceback four\nfinal_loss: 1.25\nAdapter saved to x\n"
    )
    status = runs.log_status(tables.read_log(spark, str(logs))).first()
    assert status.asDict() == {
        "run": "run-b", "loss": 1.5, "epoch": 1.0, "learning_rate": None, "completed": True,
        "final_loss": 1.25, "recent_errors": "Exception two\nerror three\ntraceback four",
    }

    hub = tmp_path / "hub" / "models--org--my--model" / "blobs"
    hub.mkdir(parents=True)
    (hub / "x").write_bytes(b"12345")
    files = listing.scan_files(spark, str(tmp_path / "hub"))
    assert sorted((r.dir, r.length) for r in files.collect()) == [("models--org--my--model", 0), ("models--org--my--model", 5)]


def test_listing_of_trees_links_and_missing_roots(spark, tmp_path):
    hub = tmp_path / "hub"
    want = {}
    for m in range(3):
        for depth in range(4):
            folder = hub.joinpath(f"models--o--m{m}", *[f"d{k}" for k in range(depth)])
            folder.mkdir(parents=True, exist_ok=True)
            for k in range(5):
                (folder / f".f {k}%é").write_bytes(b"x" * (k + depth))
                want[str(folder / f".f {k}%é")] = (f"models--o--m{m}", k + depth)
    (hub / "models--o--empty").mkdir()
    (hub / "models--o--m0" / "again").symlink_to(hub / "models--o--m0" / "d0")
    (hub / "models--o--m0" / "loop").symlink_to(hub)
    (hub / "models--o--m0" / "broken").symlink_to(hub / "nothing")
    (hub / "models--o--m1" / "link").symlink_to(hub / "models--o--m2" / ".f 4%é")
    want[str(hub / "models--o--m1" / "link")] = ("models--o--m1", 4)
    (hub / "models--file").write_text("abc")
    want[str(hub / "models--file")] = (None, 3)
    want |= {str(hub / d): (d, 0) for d in ("models--o--empty", "models--o--m0", "models--o--m1", "models--o--m2")}
    for root in (str(hub), f"{hub}/", f"file://{hub}"):
        got = {r.path.removeprefix("file://"): (r.dir, r.length) for r in listing.scan_files(spark, root).collect()}
        assert got == want
    sizes = {r.hf_id: r.size_bytes for r in inventory.sizes(listing.scan_files(spark, str(hub))).collect()}
    assert sizes == {"o/empty": 0, "o/m0": 70, "o/m1": 74, "o/m2": 70}
    assert listing.scan_files(spark, str(tmp_path / "no")).collect() == []


def test_a_wide_directory_is_listed_in_batches(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "f").write_bytes(b"x" * k)
    monkeypatch.setattr(listing, "BATCH", 7)
    got = listing.scan_files(spark, str(tmp_path))
    assert got.where("path LIKE '%/f'").selectExpr("count(*)", "sum(length)").first() == (300, 300 * 299 // 2)


def test_a_malformed_retest_line_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"case_name": "a", "input_text": "t", "expected_failures": {}}\nnot json\n')
    with pytest.raises(Exception, match="malformed JSON"):
        tables.read_retest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_bad_result_and_metadata_files_are_rejects(spark, tmp_path):
    res = tmp_path / "res"
    res.mkdir()
    for name, text in {"1": '{"max_concurrency": 1, "failed": "x"}', "2": '{"max_concurrency": 2', "3": "[1]", "4": "", "5": ' \n{"failed": 3}\n'}.items():
        (res / f"{name}.json").write_text(text)
    found = tables.read_results(spark, str(res))
    assert sorted((r.src_file[-6:], r.max_concurrency, r.failed) for r in found.data.collect()) == [("1.json", 1, None), ("5.json", None, 3)]
    assert sorted((r.src_file[-6:], r.raw) for r in found.rejects.collect()) == [("2.json", '{"max_concurrency": 2'), ("3.json", "[1]"), ("4.json", "")]
    for name, text in {"a": '{"created_at": "2024-01-01T00:00:00Z"}', "b": '{"created_at": '}.items():
        (tmp_path / "meta" / name).mkdir(parents=True)
        (tmp_path / "meta" / name / "metadata.json").write_text(text)
    found = tables.read_metadata(spark, str(tmp_path / "meta"))
    assert [(r.dir, r.created_at) for r in found.data.collect()] == [("a", "2024-01-01T00:00:00Z")]
    assert [r.src_file.split("/")[-2] for r in found.rejects.collect()] == ["b"]
