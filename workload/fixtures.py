"""Input tables of the jobs, derived from the driver tables.

Each statement runs unchanged in Spark SQL and in the checking engine, so a
query and its oracle start from the same rows and grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("documents", "labels", "conversations", "events", "embeddings", "benchmark")

#: The driver's tables of long texts are one row group each, which is one task.  They are
#: always dealt out by key first, whatever their size; the jobs themselves do not depend on it.
DEALT_BY = {"documents": "doc_id", "conversations": "conv_id"}

STATEMENTS: dict[str, str] = {}
USES: dict[str, tuple[str, ...]] = {"chat": ("conversations",)}


def _define(name: str, uses: tuple[str, ...], statement: str) -> None:
    STATEMENTS[name] = statement
    USES[name] = uses


_define("sft", ('documents', 'labels'), """
    SELECT d.doc_id AS rec_id, d.source,
      CASE d.doc_id % 6 WHEN 0 THEN 'Pre-Service Appeal' WHEN 1 THEN 'Post-Service Appeal' WHEN 2 THEN 'Grievance'
           WHEN 3 THEN 'Provider Dispute' WHEN 4 THEN 'Inquiry' END AS cls,
      'You classify cases.' AS system,
      'From: [PRIVATE_PERSON] on [PRIVATE_DATE], tel [PRIVATE_PHONE], [PRIVATE_EMAIL], [PRIVATE_ADDRESS], acct [ACCOUNT_NUMBER]. ' || d.text || ' -- [PRIVATE_PERSON]' AS user_text,
      '{"extracted_data": {' || CASE d.doc_id % 6 WHEN 5 THEN '' ELSE '"document_classification": "' ||
         CASE d.doc_id % 6 WHEN 0 THEN 'Pre-Service Appeal' WHEN 1 THEN 'Post-Service Appeal' WHEN 2 THEN 'Grievance' WHEN 3 THEN 'Provider Dispute' ELSE 'Inquiry' END || '", ' END ||
         '"service_type": "' || CASE d.doc_id % 6 WHEN 0 THEN 'Pre-Service' WHEN 1 THEN 'Post-Service' ELSE '' END || '", "manual_review": ' ||
         CASE WHEN coalesce(l.toxic,0) = 1 THEN 'true' ELSE 'false' END ||
         ', "member": "[PRIVATE_PERSON]", "case_specific_fields": {"case_type_pre_service": "' || d.lang || '", "case_type_post_service": null}}}' AS answer
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")

_define("sft_raw", ('sft',), """
    SELECT rec_id,
      CASE WHEN rec_id % 17 = 0 THEN user_text WHEN rec_id % 19 = 0 THEN NULL ELSE 'PROMPT>>' || chr(10) || user_text END AS user_text,
      CASE WHEN rec_id % 23 = 0 THEN NULL WHEN rec_id % 10 = 0 THEN chr(96)||chr(96)||chr(96) || 'json' || chr(10) || answer || chr(10) || chr(96)||chr(96)||chr(96)
           WHEN rec_id % 10 = 1 THEN substr(answer, 1, length(answer) - 1) WHEN rec_id % 10 = 2 THEN '  ' || answer || chr(10) ELSE answer END AS assistant_text
    FROM sft
""")

_define("predictions", ('sft',), """
    SELECT rec_id AS case_id,
      CASE WHEN rec_id % 13 = 0 THEN 'ERROR: TimeoutError: timed out'
           WHEN rec_id % 11 = 0 THEN '<think>maybe {"extracted_data": {"service_type": "x"}} but'
           WHEN rec_id % 7 = 0 THEN substr(answer, 1, length(answer) - 2)
           WHEN rec_id % 5 = 0 THEN '<think>draft {"a": 1}</think>' || chr(10) || chr(96)||chr(96)||chr(96) || 'json' || chr(10) || replace(answer, '"manual_review": false', '"manual_review": true') || chr(10) || chr(96)||chr(96)||chr(96)
           WHEN rec_id % 4 = 0 THEN 'Answer: ' || replace(answer, 'Grievance', 'Inquiry') || ' done.'
           ELSE answer END AS raw_output
    FROM sft
""")

_define("backtest", ('sft', 'predictions'), """
    SELECT s.rec_id AS case_pos, 'case-' || CAST(s.rec_id AS STRING) AS name, s.user_text AS input,
      CASE WHEN s.rec_id % 6 = 5 THEN 'short | x' ELSE
       'cls = "' || s.cls || '" | json_path_exact @$.extracted_data.document_classification | expected="' || s.cls || '" ; lang = v | json_path_exact @ $.extracted_data.case_specific_fields.case_type_pre_service | expected=en ; post | json_path_exact @$.extracted_data.case_specific_fields.case_type_post_service | expected=' END AS asserts,
      p.raw_output AS output
    FROM sft s JOIN predictions p ON s.rec_id = p.case_id
""")

_define("variants", ('sft',), """
    SELECT rec_id AS seed_id, v.variant, CASE WHEN (rec_id + v.variant) % 9 = 0 THEN NULL ELSE 'v' || CAST(v.variant AS STRING) || ' ' || user_text END AS variant_text,
      CASE WHEN (rec_id + v.variant) % 9 = 0 THEN NULL WHEN (rec_id + v.variant) % 8 = 0 THEN 'not json' WHEN (rec_id + v.variant) % 5 = 0 THEN replace(answer, 'Grievance', 'Inquiry') ELSE answer END AS label_text
    FROM sft CROSS JOIN (SELECT 1 AS variant UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) v
""")

_define("run_log", ('events',), """
    SELECT 'run-' || CAST(user_id % 8 AS STRING) AS run, event_id AS line_no,
      CASE event_type WHEN 'purchase' THEN '{''loss'': ' || CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) || ', ''grad_norm'': 0.5, ''learning_rate'': 2e-04, ''epoch'': ' || CAST(event_id AS STRING) || '}'
       WHEN 'error' THEN 'Traceback (most recent call last): ' || CAST(event_id AS STRING)
       WHEN 'signup' THEN CASE WHEN event_id % 50 = 0 THEN 'Adapter saved to data/adapters/x' ELSE 'INFO step' END
       ELSE 'INFO ' || props END AS value
    FROM events
""")

_define("requests", ('events',), """
    SELECT event_id AS req_id,
      CASE WHEN event_type = 'view' THEN '/v1/text/detections' ELSE '/v1/chat/completions' END AS path,
      CASE WHEN event_type = 'view' THEN 'image/png' ELSE 'application/json' END AS content_type,
      CASE event_type WHEN 'view' THEN 'png' WHEN 'error' THEN '{bad' WHEN 'signup' THEN '{"messages": []}'
        ELSE '{"model": "m' || CAST(user_id % 6 AS STRING) || '", "k": ' || CAST(event_id AS STRING) || '}' END AS body,
      CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'm' || CAST(event_id % 6 AS STRING) END AS model_header
    FROM events
""")

_define("ocr_pages", ('documents',), """
    SELECT doc_id - doc_id % 25 AS doc_id, doc_id % 25 AS page_no,
      '<|ref|># Page ' || CAST(doc_id % 25 AS STRING) || '<|/ref|>' || chr(10) || '<|det|>text [0,0,1,1]<|/det|>  ' || chr(10) || chr(10) || chr(10) || text AS text
    FROM documents
""")

_define("files", ('documents',), """
    SELECT 'hub/models--org--' || source || '/blobs/' || CAST(doc_id AS STRING) AS path, 'models--org--' || source AS dir, n_chars AS length FROM documents
""")

_define("eval_gold", ('sft',), """
    SELECT rec_id AS case_id, answer AS gold FROM sft
""")

_define("sft_real", ('sft',), """
    SELECT * FROM sft WHERE rec_id % 4 = 0
""")

_define("sft_synth", ('sft',), """
    SELECT * FROM sft WHERE rec_id % 4 <> 0
""")

_define("markers", ('documents', 'benchmark'), """
    SELECT text AS marker FROM benchmark UNION SELECT ' ' || source AS marker FROM documents
""")

_define("alpaca", ('documents',), """
    SELECT doc_id AS rec_id, substr(text, 1, 60) AS instruction,
      CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE substr(text, 61, 100) END AS input,
      CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 3 = 2 THEN substr(text, 161) ELSE substr(text, 61) END AS output
    FROM documents
""")

_define("retest", ('sft', 'predictions'), """
    SELECT s.rec_id AS case_id, 'case-' || CAST(s.rec_id AS STRING) AS case_name, p.raw_output,
      CASE WHEN s.rec_id % 2 = 1 THEN upper(coalesce(s.cls, '')) ELSE coalesce(s.cls, '') END AS exp_document_classification,
      ' en ' AS exp_case_type_pre_service
    FROM sft s JOIN predictions p ON s.rec_id = p.case_id
""")

_define("run_meta", ('events',), """
    SELECT DISTINCT 'run-' || CAST(user_id % 10 AS STRING) AS dir,
      CASE WHEN user_id % 10 IN (3, 8) THEN NULL ELSE '2024-01-01T0' || CAST(user_id % 10 AS STRING) || ':00:00Z' END AS created_at,
      CASE WHEN user_id % 10 IN (3, 8) THEN NULL ELSE 'org/src' || CAST(user_id % 10 AS STRING) END AS base_model
    FROM events
""")

_define("registry", ('documents', 'conversations'), """
    SELECT 'm-' || lang AS alias, 'org/' || source AS hf_id,
      CASE WHEN min(doc_id) % 4 = 0 THEN 'docker' END AS serve_backend, min(doc_id) * 2 AS line_no
    FROM documents GROUP BY lang, source
    UNION ALL SELECT 'm-' || role AS alias, 'org/' || role AS hf_id, 'vision' AS serve_backend, min(conv_id) * 2 + 1 AS line_no
    FROM conversations GROUP BY role
""")

# A backend serves the models that users of one group of four ask for; m4 and m5 have none.
_define("routes", ('events',), """
    SELECT DISTINCT 'b' || CAST(user_id % 4 - user_id % 2 AS STRING) AS backend,
      'http://b' || CAST(user_id % 4 - user_id % 2 AS STRING) AS url,
      'big-' || CAST(user_id % 4 - user_id % 2 AS STRING) AS served_model, 'm' || CAST(user_id % 4 AS STRING) AS model
    FROM events
    UNION ALL SELECT DISTINCT event_type AS backend, 'http://' || event_type AS url, event_type AS served_model, event_type AS model
    FROM events WHERE event_type = 'view'
""")

_define("path_routes", ('events',), """
    SELECT DISTINCT '/v1/text/detections' AS path, event_type AS backend FROM events WHERE event_type = 'view'
""")

_define("routes_broken", ('events',), """
    SELECT DISTINCT event_type AS backend, CASE WHEN event_type = 'error' THEN NULL ELSE 'http://' || event_type END AS url,
      CASE WHEN event_type = 'signup' THEN NULL ELSE 'm' || CAST(user_id % 6 AS STRING) END AS model
    FROM events
""")

_define("path_routes_broken", ('events',), """
    SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'v1/' ELSE '/v1/' END || event_type AS path,
      CASE WHEN event_type = 'click' THEN 'nowhere' ELSE event_type END AS backend
    FROM events
""")

_define("detections", ('embeddings',), """
    SELECT vec_id AS det_id, label AS image_id, CAST(e[0] % 100 AS DOUBLE) / 100 AS score,
      CASE WHEN vec_id % 2 = 0 THEN '[' || CAST(e[1] AS STRING) || ',' || CAST(e[2] AS STRING) || ',' || CAST(e[1] + e[3] + 1 AS STRING) || ',' || CAST(e[2] + e[4] + 1 AS STRING) || ']'
        ELSE '[[' || CAST(e[5] AS STRING) || ',5],[60,' || CAST(e[6] AS STRING) || '],[' || CAST(e[7] AS STRING) || ',30],[3,' || CAST(e[8] AS STRING) || ']]' END AS box
    FROM (SELECT vec_id, label, transform(sequence(0, 8), k -> aggregate(transform(filter(embedding, (x, i) -> i % 9 = k), x -> CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT)), CAST(0 AS BIGINT), (a, x) -> a + x)) AS e FROM embeddings)
""")

_define("bench_requests", ('events',), """
    SELECT event_id AS req_id, user_id % 2 + 1 AS concurrency, ts, value AS ttft_ms, value * 3 AS e2e_ms,
      CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, 128 AS output_tokens FROM events
""")


#: Tables the two engines spell differently.  Conversations become one row per chat;
#: the four variants of a seed are exploded in Spark instead of cross joined.
STATEMENTS["chat"] = """
    SELECT conv_id AS rec_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
    FROM conversations GROUP BY conv_id
"""
_CROSS = "FROM sft CROSS JOIN (SELECT 1 AS variant UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) v"
IN_SPARK = {
    "chat": """
    SELECT conv_id AS rec_id, transform(array_sort(collect_list(struct(turn, role, text))),
           x -> struct(x.role AS role, x.text AS content)) AS messages
    FROM conversations GROUP BY conv_id
""",
    "detections": STATEMENTS["detections"],
    "variants": STATEMENTS["variants"].replace(
        _CROSS, "FROM sft LATERAL VIEW explode(sequence(1, 4)) v AS variant"
    ),
}
assert IN_SPARK["variants"] != STATEMENTS["variants"]
for _i in range(9):  # the other engine counts list positions from one
    STATEMENTS["detections"] = STATEMENTS["detections"].replace(f"e[{8 - _i}]", f"e[{9 - _i}]")
STATEMENTS["detections"] = STATEMENTS["detections"].replace(
    "transform(sequence(0, 8), k -> aggregate(transform(filter(embedding, (x, i) -> i % 9 = k), x -> CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT)), CAST(0 AS BIGINT), (a, x) -> a + x))",
    "list_transform(range(0, 9), lambda k: CAST(list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 9 = k), lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT))) AS BIGINT))",
)
assert "list_filter" in STATEMENTS["detections"]


def _needed(name: str, order: list[str]) -> list[str]:
    for used in USES.get(name, ()):
        if used not in order:
            _needed(used, order)
    if name not in order:
        order.append(name)
    return order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table over the parquet files of ``sf_dir``."""
    for step in _needed(name, []):
        if step in BASE:
            df = spark.read.parquet(f"{sf_dir}/{step}.parquet")
            df = df.repartition(DEALT_BY[step]) if step in DEALT_BY else df
        else:
            df = spark.sql(IN_SPARK.get(step, STATEMENTS[step]))
        df.createOrReplaceTempView(step)
    return df


def prefix(*names: str) -> str:
    """The ``WITH`` clause that defines ``names`` (and what they use) for an oracle."""
    order: list[str] = []
    for name in names:
        _needed(name, order)
    parts = [f"{n} AS ({STATEMENTS[n]})" for n in order if n not in BASE]
    return "WITH " + ",\n".join(parts)
