"""Plain-SQL statements of the registered queries' results, over the same tables."""

from __future__ import annotations

from workload.fixtures import prefix

ORACLES: dict[str, str] = {}

# Fixed values, written out here independently of the code under test.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ROLE_MARKERS = {
    "system": ("<|system|>\n", "<|end|>\n"),
    "user": ("<|user|>\n", "<|end|>\n"),
    "assistant": ("<|assistant|>\n", "<|end|>\n"),
    "*": ("<|other|>\n", "<|end|>\n"),
}
CORE_PATHS = [
    "$.extracted_data.document_classification",
    "$.extracted_data.service_type",
    "$.extracted_data.case_specific_fields.case_type_pre_service",
    "$.extracted_data.case_specific_fields.case_type_post_service",
    "$.extracted_data.case_specific_fields.case_type_grievance",
    "$.extracted_data.case_specific_fields.type_of_issue",
    "$.extracted_data.manual_review",
]
WS = f"'{WHITESPACE}'"
FENCE = "chr(96)||chr(96)||chr(96)"


def oracle(name: str, inputs: tuple[str, ...], body: str, **parts: str) -> None:
    """Add a statement; ``body`` starts with SELECT or with further named parts."""
    extra = "".join(f",\n{n} AS ({sql})" for n, sql in parts.items())
    head = prefix(*inputs)
    if head == "WITH ":
        head, extra = ("WITH " + extra[2:], "") if extra else ("", "")
    ORACLES[name] = f"{head}{extra}\n{body}"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


# -- sources ---------------------------------------------------------------------------

oracle("src_jsonl_lenient", ("conversations",), """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS total_chars
FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id""")
# Line numbers: a file holds the conversations of one remainder in order; two blank lines follow every fifth id.
PLACED = """SELECT conv_id, conv_id % 64 AS file_no, CAST(sum(1 + CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 0 END)
  OVER (PARTITION BY conv_id % 64 ORDER BY conv_id) - CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS line_no
  FROM (SELECT DISTINCT conv_id FROM conversations)"""
oracle("src_jsonl_rejects", ("conversations",), """
SELECT conv_id, file_no, line_no FROM placed WHERE conv_id % 7 = 0""", placed=PLACED)
oracle("src_strict", ("conversations",), """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS total_chars, conv_id % 64 AS file_no,
  row_number() OVER (ORDER BY CAST(conv_id % 64 AS VARCHAR), conv_id) - 1 AS index
FROM conversations GROUP BY conv_id""")

oracle("src_sink", ("conversations",), """
SELECT conv_id AS rec_id, string_agg(concat_ws('=', role, text), '|' ORDER BY turn) AS said FROM conversations GROUP BY conv_id""")
oracle("src_dataset", ("alpaca",), "SELECT rec_id, instruction, input, output FROM alpaca")
oracle("src_markers", ("benchmark", "events"), """
SELECT DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS marker FROM benchmark WHERE trim(text) <> ''
UNION SELECT event_type FROM events""")
oracle("src_retest", ("retest",), """
SELECT case_name, raw_output AS input_text, exp_document_classification AS class, exp_case_type_pre_service AS pre_service FROM retest""")
RESULT_FILES = """SELECT part, CASE WHEN part % 8 = 3 THEN substr(body, 1, length(body) - 1) WHEN part = 5 THEN '[1, 2]' ELSE body END AS body, n, failed FROM (
  SELECT user_id % 64 AS part, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed,
    '{' || chr(10) || ' "max_concurrency": ' || (user_id % 64) || ',' || chr(10) || ' "request_throughput": ' || count(*) || ',' || chr(10)
      || ' "failed": ' || count(*) FILTER (WHERE event_type = 'error') || chr(10) || '}' AS body FROM events GROUP BY user_id % 64)"""
oracle("src_results", ("events",), """
SELECT part AS max_concurrency, CAST(n AS DOUBLE) AS request_throughput, failed FROM result_files WHERE part % 8 <> 3 AND part <> 5""",
    result_files=RESULT_FILES)
oracle("src_results_rejects", ("events",), """
SELECT part, CAST(length(body) + 1 AS INTEGER) AS chars FROM result_files WHERE part % 8 = 3 OR part = 5""", result_files=RESULT_FILES)
oracle("src_file_listing", ("events",), """
SELECT 'org/u' || (user_id % 16) AS hf_id, count(DISTINCT user_id % 64) AS n_files,
       CAST(sum(strlen(coalesce(event_type, '')) + 1) AS BIGINT) AS size_bytes
FROM events GROUP BY ALL""")

# -- records ---------------------------------------------------------------------------

ROLES = """SELECT rec_id, messages,
  list_filter(messages, lambda m: m.role = 'user') AS u,
  list_filter(messages, lambda m: m.role = 'assistant') AS a,
  list_filter(messages, lambda m: m.role = 'system') AS s FROM chat"""

oracle("chat_first_roles", ("chat",), """
SELECT rec_id, coalesce(u[1].content, '') AS user_text, coalesce(a[1].content, '') AS assistant_text
FROM roles WHERE len(u) > 0 AND len(a) > 0""", roles=ROLES)

oracle("mix_longest_user_cap", ("conversations",), """
SELECT conv_id AS rec_id, CAST(coalesce(max(length(text)) FILTER (WHERE role = 'user'), 0) AS INTEGER) AS longest_user
FROM conversations GROUP BY conv_id
HAVING coalesce(max(length(text)) FILTER (WHERE role = 'user'), 0) <= 4000""")

oracle("biggest_first", ("conversations",), """
SELECT conv_id AS rec_id, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM conversations
GROUP BY conv_id ORDER BY total_chars DESC, rec_id LIMIT 5""")
oracle("biggest_records", ("conversations",), """
SELECT conv_id AS rec_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg(text, '|' ORDER BY turn) AS contents FROM conversations
GROUP BY conv_id ORDER BY total_chars DESC, rec_id LIMIT 5""")

oracle("biggest_half", ("conversations",), """
SELECT conv_id AS rec_id, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM conversations
GROUP BY conv_id ORDER BY total_chars DESC, rec_id LIMIT (SELECT count(DISTINCT conv_id) // 2 FROM conversations)""")
oracle("first_n", ("conversations",), """
SELECT conv_id AS rec_id, CAST(count(*) AS INTEGER) AS n_messages FROM conversations
GROUP BY conv_id ORDER BY rec_id LIMIT 10""")


def _marker(i: int) -> str:
    cases = " ".join(
        f"WHEN '{r}' THEN '{m[i]}'" for r, m in ROLE_MARKERS.items() if r != "*"
    )
    return f"CASE m.role {cases} ELSE '{ROLE_MARKERS['*'][i]}' END"


RENDERED = f"""SELECT rec_id, messages, array_to_string(list_transform(messages,
  lambda m: {_marker(0)} || coalesce(m.content, '') || {_marker(1)}), '') AS text FROM chat"""
COUNTED = r"SELECT *, CAST(len(regexp_extract_all(text, '\w+|[^\w\s]')) AS BIGINT) AS n_tokens FROM rendered"

oracle("chat_render", ("chat",), "SELECT rec_id, text FROM rendered", rendered=RENDERED)

oracle("prompt_tail_budget", ("chat",), """
SELECT rec_id, CASE WHEN len(t) + sys_len > 600 AND len(t) > budget
  THEN array_to_string(t[len(t) - budget + 1:], '') ELSE user_text END AS user_text
FROM (SELECT *, greatest(512, 600 - sys_len - 64) AS budget FROM pieces)""",
    roles=ROLES,
    pieces=r"""SELECT rec_id, coalesce(u[1].content, '') AS user_text,
  regexp_extract_all(coalesce(u[1].content, ''), '\s*(?:\w+|[^\w\s])') AS t,
  len(regexp_extract_all(coalesce(s[1].content, ''), '\s*(?:\w+|[^\w\s])')) AS sys_len FROM roles""")

oracle("alpaca_audit", ("alpaca",), """
SELECT 'alpaca' AS format, (SELECT count(*) FROM alpaca) AS "rows", 'instruction' AS field,
  count(*) AS missing, min(rec_id) AS first_rec_id FROM alpaca WHERE instruction IS NULL
UNION ALL
SELECT 'alpaca', (SELECT count(*) FROM alpaca), 'output', count(*), min(rec_id) FROM alpaca WHERE output IS NULL""")

ALPACA_TEXT = r"""'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) ||
  CASE WHEN coalesce(input, '') <> '' THEN '### Input:' || chr(10) || input || chr(10) || chr(10) ELSE '' END ||
  '### Response:' || chr(10) || output || '</s>'"""
oracle("alpaca_render", ("alpaca",), f"""
SELECT rec_id, {ALPACA_TEXT} AS text FROM alpaca WHERE instruction IS NOT NULL AND output IS NOT NULL""")

SPLIT = """CASE WHEN rn < floor(n * CAST(0.9 AS DOUBLE)) THEN 'train'
  WHEN rn < floor(n * (CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split"""
oracle("split_exact", ("alpaca",), f"""
SELECT rec_id, {SPLIT} FROM (SELECT rec_id, row_number() OVER (ORDER BY md5('42:' || rec_id)) - 1 AS rn,
  count(*) OVER () AS n FROM alpaca)""")
oracle("alpaca_prep", ("alpaca",), f"""
SELECT rec_id, {SPLIT}, {ALPACA_TEXT} AS text FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || rec_id)) - 1 AS rn, count(*) OVER () AS n
  FROM alpaca WHERE instruction IS NOT NULL AND output IS NOT NULL)""")


def preview(x: str) -> str:
    return f"""CASE WHEN length({x}) <= 4000 THEN {x} ELSE substr({x}, 1, 2000) || chr(10) || '...[truncated '
  || CAST(length({x}) - 4000 AS VARCHAR) || ' chars]...' || chr(10) || right({x}, 2000) END"""


oracle("eval_preview", ("documents",), f"SELECT doc_id, {preview('text')} AS preview FROM documents")

oracle("backtest_load", ("backtest",), """
SELECT case_pos, name, CAST(length(input) AS INTEGER) AS input_len, asserts, output FROM backtest""")

# -- clean -----------------------------------------------------------------------------

FENCED = f"""SELECT *, {strip('assistant_text')} AS t FROM sft_raw"""
ANSWER = r"""CASE WHEN regexp_matches(t, '(?s)^```(?:json|JSON)?\s*\n?(.*?)\n?```$')
  THEN """ + strip(r"regexp_extract(t, '(?s)^```(?:json|JSON)?\s*\n?(.*?)\n?```$', 1)") + " ELSE t END"
CLEAN = f"""SELECT rec_id, user_text, assistant_text,
  CASE WHEN starts_with(user_text, 'PROMPT>>') THEN ltrim(substr(user_text, 9), {WS}) ELSE user_text END AS "user",
  {ANSWER} AS answer FROM fenced"""
CLEANED = """SELECT *, CASE WHEN user_text IS NULL OR assistant_text IS NULL THEN 'missing_role'
  WHEN NOT starts_with(user_text, 'PROMPT>>') THEN 'no_prefix'
  WHEN length("user") > CAP THEN 'oversize'
  WHEN NOT json_valid(answer) THEN 'bad_json' END AS reason FROM base"""


def cleaned(cap: int) -> dict[str, str]:
    return {"fenced": FENCED, "base": CLEAN, "cleaned": CLEANED.replace("CAP", str(cap))}


oracle("clean_prefix", ("sft_raw",), """
SELECT rec_id, "user" FROM base WHERE starts_with(user_text, 'PROMPT>>') AND assistant_text IS NOT NULL""",
    fenced=FENCED, base=CLEAN)
oracle("clean_char_cap", ("sft_raw",), """
SELECT rec_id, CAST(length("user") AS INTEGER) AS user_len FROM cleaned WHERE reason = 'oversize'""",
    **cleaned(4000))
oracle("clean_fence", ("sft_raw",), """
SELECT rec_id, answer FROM base WHERE assistant_text IS NOT NULL""", fenced=FENCED, base=CLEAN)
oracle("clean_json_gate", ("sft_raw",), """
SELECT rec_id, json_valid(answer) AS ok FROM base WHERE assistant_text IS NOT NULL""", fenced=FENCED, base=CLEAN)
oracle("clean_canonical", ("sft_raw",), """
SELECT rec_id, 3 AS n_messages, 'You classify cases.' AS system, "user" AS user_text, answer
FROM cleaned WHERE reason IS NULL""", **cleaned(160000))
oracle("clean_summary", ("sft_raw",), """
SELECT count(*) FILTER (WHERE reason IS NULL) AS kept,
  count(*) FILTER (WHERE reason = 'oversize') AS dropped_oversize,
  count(*) FILTER (WHERE reason IN ('missing_role', 'bad_json')) AS dropped_invalid,
  count(*) FILTER (WHERE reason = 'no_prefix') AS dropped_no_prefix,
  count(*) FILTER (WHERE assistant_text IS NOT NULL AND starts_with(user_text, 'PROMPT>>')) AS prefixes_stripped,
  count(*) FILTER (WHERE (reason IS NULL OR reason = 'bad_json') AND answer <> assistant_text) AS fences_stripped
FROM cleaned""", **cleaned(4000))
oracle("clean_reasons", ("sft_raw",), """
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM cleaned GROUP BY 1""", **cleaned(4000))

# -- answers ---------------------------------------------------------------------------

#: What the fixture puts into each prediction, as (raw reading, clean reading).
TRUTH = """SELECT rec_id AS case_id, cls, answer,
  CASE WHEN rec_id % 13 = 0 THEN NULL WHEN rec_id % 11 = 0 THEN '{"extracted_data": {"service_type": "x"}}'
    WHEN rec_id % 7 = 0 THEN NULL
    WHEN rec_id % 5 = 0 THEN replace(answer, '"manual_review": false', '"manual_review": true')
    WHEN rec_id % 4 = 0 THEN replace(answer, 'Grievance', 'Inquiry') ELSE answer END AS raw_json,
  CASE WHEN rec_id % 13 = 0 OR rec_id % 11 = 0 OR rec_id % 7 = 0 THEN NULL
    WHEN rec_id % 5 = 0 THEN replace(answer, '"manual_review": false', '"manual_review": true')
    WHEN rec_id % 4 = 0 THEN replace(answer, 'Grievance', 'Inquiry') ELSE answer END AS clean_json
  FROM sft"""
oracle("answer_extract", ("sft",), "SELECT case_id, raw_json AS json FROM truth", truth=TRUTH)
oracle("answer_extract_clean", ("sft",), "SELECT case_id, clean_json AS json FROM truth", truth=TRUTH)
oracle("answer_class", ("sft",), """
SELECT rec_id, json_extract_string(answer, '$.extracted_data.document_classification') AS cls FROM sft""")

ASSERTS = r"""SELECT case_pos, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(p[2], '@\s*(\S+)', 1) AS path,
  trim(trim(trim(regexp_extract(trim(p[3]), 'expected\s*=\s*(.*)$', 1)), '"'), '''') AS expected
FROM (SELECT case_pos, i, string_split(l[i], '|') AS p FROM (
  SELECT case_pos, l, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT case_pos, string_split(asserts, ' ; ') AS l FROM backtest)))
WHERE len(p) >= 3"""
oracle("asserts_long", ("backtest",), "SELECT * FROM asserts_long", asserts_long=ASSERTS)

# -- augment ---------------------------------------------------------------------------

FANNED = """SELECT rec_id, coalesce(cls, '(unknown)') AS cls, user_text, answer, CAST(v AS INTEGER) AS variant
  FROM (SELECT *, unnest(range(0, CASE WHEN cls IN ('Pre-Service Appeal', 'Provider Dispute') THEN 13 ELSE 5 END)) AS v FROM sft)"""
oracle("augment_fanout", ("sft",), "SELECT rec_id, cls, variant FROM fanned", fanned=FANNED)
oracle("augment_by_class", ("sft",), """
SELECT cls, count(*) FILTER (WHERE variant = 0) AS originals, count(*) FILTER (WHERE variant > 0) AS variants,
  count(*) AS total, cls IN ('Pre-Service Appeal', 'Provider Dispute') AS priority FROM fanned GROUP BY cls""",
    fanned=FANNED)


def _draw(kind: str, slot: int) -> str:
    return f"CAST('0x' || substr(d_{kind}, {1 + 8 * slot}, 8) AS BIGINT)"


def _between(kind: str, slot: int, low: int, high: int) -> str:
    return f"({_draw(kind, slot)} % {high - low + 1} + {low})"


def _pick(kind: str, slot: int, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{_draw(kind, slot)} % {len(values)} + 1]"


def _composed(kind: str, slot: int, starts: str, ends: str) -> str:
    """A beginning and an ending by one draw."""
    n, m = len(starts.split()), len(ends.split())
    first = f"(string_split('{starts}', ' '))[{_draw(kind, slot)} % {n * m} // {m} + 1]"
    return f"{first} || (string_split('{ends}', ' '))[{_draw(kind, slot)} % {n * m} % {m} + 1]"


def _text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# Fixed values, written out here independently of the code under test.
TOKENS = {
    "person": "[PRIVATE_PERSON]", "date": "[PRIVATE_DATE]", "phone": "[PRIVATE_PHONE]",
    "email": "[PRIVATE_EMAIL]", "address": "[PRIVATE_ADDRESS]", "account": "[ACCOUNT_NUMBER]",
}
FIRST = ("Al Ber Cor Dar El Fen Gar Hal Is Jor Kel Lor", "a an da en ia in is na on ric")
LAST = ("Ash Brack Cal Dun Elder Farrow Grey Hart Ingle Kings Mill Oak Raven", "bourne by combe field ford ham more worth")
STREETS = [
    "Juniper Way", "Quarry Road", "Mill Lane", "Harbour Street", "Orchard Close", "Station Road",
    "Foundry Court", "Meadow Drive", "Chapel Hill", "Lantern Row", "Ferry Walk", "Linden Avenue",
    "Tannery Yard", "Willow Bank", "Cooper Terrace",
]
CITIES = [
    "Ashport, OR 97301", "Bellmere, OH 43011", "Cedar Falls, IA 50613", "Dunhaven, ME 04019", "Eastwick, CT 06103",
    "Fairmoor, KS 66007", "Glenrock, WY 82637", "Highgate, VT 05459", "Ironbridge, PA 15022", "Kingsmead, NY 12401",
    "Larkfield, CA 95403", "Millbrook, AL 36054", "Northcott, TX 75001", "Oakhanger, GA 30002", "Pinehurst, NC 28374",
]
MAIL = ["example.com", "mail.com", "inbox.org", "fastmail.net"]


REPLACED = {
    "person": f"{_composed('person', 0, *FIRST)} || ' ' || {_composed('person', 1, *LAST)}",
    "date": f"lpad({_text(_between('date', 0, 1, 12))}, 2, '0') || '-' || "
            f"lpad({_text(_between('date', 1, 1, 28))}, 2, '0') || '-' || {_text(_between('date', 2, 2024, 2025))}",
    "phone": f"'(' || {_between('phone', 0, 200, 999)} || ') ' || {_between('phone', 1, 200, 999)} || '-' || "
             f"{_between('phone', 2, 1000, 9999)}",
    "email": f"lower({_composed('email', 0, *FIRST)} || '.' || {_composed('email', 1, *LAST)}) || '@' || "
             f"{_pick('email', 2, MAIL)}",
    "address": f"{_between('address', 0, 100, 9999)} || ' ' || {_pick('address', 1, STREETS)} || ', ' || "
               f"{_pick('address', 2, CITIES)}",
    "account": f"left(lpad({_text(_between('account', 0, 0, 999999))}, 6, '0') || "
               f"lpad({_text(_between('account', 1, 0, 999999))}, 6, '0'), {_between('account', 2, 8, 12)})",
}


def _substituted(column: str) -> str:
    result = column
    for kind, token in TOKENS.items():
        result = f"replace({result}, '{token}', r_{kind})"
    return f"CASE WHEN variant = 0 THEN {column} ELSE {result} END"


oracle("augment_substitute", ("sft",), f"""
SELECT rec_id, variant, {_substituted('user_text')} AS user_text, {_substituted('answer')} AS answer FROM drawn""",
    fanned=FANNED,
    keyed="SELECT *, " + ", ".join(
        f"md5('42:' || rec_id || ':' || variant || ':{k}') AS d_{k}" for k in TOKENS) + " FROM fanned",
    drawn="SELECT *, " + ", ".join(f"{sql} AS r_{k}" for k, sql in REPLACED.items()) + " FROM keyed")

# Look-alikes.
ALIKE = {"0": "O", "O": "0", "1": "l", "l": "1", "I": "1", "5": "S", "S": "5", "8": "B", "B": "8", "G": "6", "m": "rn"}


def noisy(source: str) -> dict[str, str]:
    """``noisy`` (rec_id, variant, user_text) from ``source``: draws by digest, places by running sums, texts from their pieces."""
    alike = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIKE.items())
    return {
        "words": f"""SELECT rec_id, variant, n, k, md5(md5('42:' || rec_id || ':' || variant) || ':' || k) AS d FROM (
    SELECT rec_id, variant, length(user_text) AS n, unnest(range(0, CAST(length(user_text) * 0.006 + 40 AS BIGINT))) AS k
    FROM {source} WHERE variant > 0)""",
        "places": """SELECT rec_id, variant, n, k, CAST('0x' || substr(d, 14, 13) AS BIGINT) / 4503599627370496::DOUBLE AS c,
    CAST(sum(floor(ln(1 - CAST('0x' || substr(d, 1, 13) AS BIGINT) / 4503599627370496::DOUBLE) / ln(1 - 0.003::DOUBLE)) + 1)
      OVER (PARTITION BY rec_id, variant ORDER BY k) - 1 AS BIGINT) AS place FROM words""",
        "hit": """SELECT *, lag(place, 1, -1) OVER (PARTITION BY rec_id, variant ORDER BY k) AS before FROM places WHERE place < n""",
        "pieces": f"""SELECT rec_id, variant, max(place) AS last, string_agg(substr(user_text, before + 2, place - before - 1) ||
    CASE WHEN NOT regexp_matches(ch, '[\\p{{L}}\\p{{N}}]') THEN ch WHEN c >= 2::DOUBLE / 3 THEN ch || ch
      WHEN c >= 1::DOUBLE / 3 THEN CASE ch {alike} ELSE ch END ELSE '' END, '' ORDER BY k) AS head
    FROM (SELECT h.*, s.user_text, substr(s.user_text, place + 1, 1) AS ch FROM hit h JOIN {source} s USING (rec_id, variant))
    GROUP BY rec_id, variant""",
        "noisy": f"""SELECT s.rec_id, s.variant, coalesce(p.head || substr(s.user_text, last + 2), s.user_text) AS user_text
    FROM {source} s LEFT JOIN pieces p USING (rec_id, variant)""",
    }


oracle("augment_noise", ("sft",), "SELECT rec_id, variant, user_text FROM noisy", fanned=FANNED, **noisy("fanned"))
DRAWN = {
    "keyed": "SELECT *, " + ", ".join(f"md5('42:' || rec_id || ':' || variant || ':{k}') AS d_{k}" for k in TOKENS) + " FROM fanned",
    "drawn": "SELECT *, " + ", ".join(f"{sql} AS r_{k}" for k, sql in REPLACED.items()) + " FROM keyed",
    "filled": f"SELECT * EXCLUDE (user_text, answer), {_substituted('user_text')} AS user_text, {_substituted('answer')} AS answer FROM drawn",
}
oracle("augment_dataset", ("sft",), """
SELECT rec_id, variant, f.cls, 'You classify cases.' AS system, n.user_text, f.answer
FROM filled f JOIN noisy n USING (rec_id, variant)""", fanned=FANNED, **DRAWN, **noisy("filled"))

oracle("augment_valid", ("sft_raw",), """
SELECT rec_id, cls, CAST(v AS INTEGER) AS variant FROM (
  SELECT *, unnest(range(0, CASE WHEN NOT ok THEN 1 WHEN cls IN ('Pre-Service Appeal', 'Provider Dispute') THEN 13 ELSE 5 END)) AS v
  FROM (SELECT rec_id, json_valid(assistant_text) AS ok, coalesce(CASE WHEN json_valid(assistant_text) THEN
    json_extract_string(assistant_text, '$.extracted_data.document_classification') END, '(unknown)') AS cls
    FROM sft_raw WHERE user_text IS NOT NULL AND assistant_text IS NOT NULL))""")

# -- mix -------------------------------------------------------------------------------

MIXED = """SELECT 'real' AS source_name, rec_id, c AS copy FROM sft_real, (VALUES (0), (1), (2)) AS k(c)
  UNION ALL SELECT 'synth', rec_id, 0 FROM sft_synth"""
oracle("mix_upsample", ("sft_real", "sft_synth"), "SELECT source_name, rec_id, copy FROM mixed", mixed=MIXED)
oracle("mix_union", ("sft_real", "sft_synth"), """
SELECT 'real' AS source_name, rec_id, cls, user_text, answer FROM sft_real
UNION ALL SELECT 'synth', rec_id, cls, user_text, answer FROM sft_synth""")
oracle("mix_shuffle", ("sft_real", "sft_synth"), """
SELECT source_name, rec_id, copy,
  row_number() OVER (ORDER BY md5('42:' || source_name || ':' || rec_id || ':' || copy)) AS rank FROM mixed""",
    mixed=MIXED)
oracle("mix_counts", ("sft_real", "sft_synth"), """
SELECT source_name, count(*) AS loaded, count(*) FILTER (WHERE fits) AS kept, count(*) FILTER (WHERE NOT fits) AS dropped,
  count(*) FILTER (WHERE fits) * CASE source_name WHEN 'real' THEN 3 ELSE 1 END AS combined
FROM (SELECT 'real' AS source_name, length(user_text) <= 4000 AS fits FROM sft_real
  UNION ALL SELECT 'synth', length(user_text) <= 4000 FROM sft_synth) GROUP BY source_name""")
oracle("mix_combine", ("sft_real", "sft_synth", "sft"), """
SELECT source_name, rec_id, copy, user_text, answer FROM mixed JOIN sft USING (rec_id)
WHERE length(user_text) <= 4000""", mixed=MIXED)
oracle("rank_records", ("alpaca",), """
SELECT rec_id, row_number() OVER (ORDER BY md5('42:' || rec_id)) AS rank FROM alpaca""")

# -- tokens ----------------------------------------------------------------------------

oracle("token_cap", ("chat",), "SELECT rec_id, n_tokens FROM counted WHERE n_tokens <= 800",
       rendered=RENDERED, counted=COUNTED)
oracle("token_report", ("chat",), """
SELECT n, s[CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1] AS p50,
  s[CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1] AS p90,
  s[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95,
  s[CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1] AS p99, s[n] AS max
FROM (SELECT count(*) AS n, list(n_tokens ORDER BY n_tokens) AS s FROM counted WHERE n_tokens <= 800)""",
       rendered=RENDERED, counted=COUNTED)
oracle("token_dropped_top", ("chat",), """
SELECT rec_id, n_tokens FROM counted WHERE n_tokens > 800 ORDER BY n_tokens DESC, rec_id LIMIT 20""",
       rendered=RENDERED, counted=COUNTED)
oracle("prepare_training", ("chat",), """
SELECT rec_id, n_tokens, CAST(list_sum(list_transform(messages, lambda m: length(m.content))) AS BIGINT) AS total_chars, text
FROM counted WHERE n_tokens <= 800 ORDER BY total_chars DESC, rec_id LIMIT 5""",
       rendered=RENDERED, counted=COUNTED)

# -- evaluation ------------------------------------------------------------------------

#: Text of a JSON value the way the jobs compare it.
def _value(json: str, path: str) -> str:
    got = f"json_extract_string({json}, '{path}')"
    return f"coalesce(CASE {got} WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE {got} END, '')"


PATHS = "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in CORE_PATHS) + ") AS t(path)"
LONG = " UNION ALL ".join(
    f"SELECT case_id, '{p}' AS path, {_value('answer', p)} AS gold, {_value('clean_json', p)} AS pred "
    "FROM truth WHERE clean_json IS NOT NULL" for p in CORE_PATHS)
LONG_MATCH = "SELECT *, gold = pred AS match FROM long_base"
CASES = """SELECT t.case_id, CASE WHEN t.case_id % 13 = 0 THEN 'error' WHEN clean_json IS NULL THEN 'no_json'
  WHEN (SELECT bool_and(match) FROM scored s WHERE s.case_id = t.case_id) THEN 'passed' ELSE 'failed' END AS outcome,
  clean_json IS NOT NULL AS pred_ok FROM truth t"""
EVAL = {"truth": TRUTH, "long_base": LONG, "scored": LONG_MATCH}
oracle("eval_score_long", ("sft",), "SELECT case_id, path, gold, pred, match FROM scored", **EVAL)
oracle("eval_join", ("predictions",), """
SELECT c.case_id, outcome, pred_ok, CAST(length(raw_output) AS INTEGER) AS raw_len
FROM cases c JOIN predictions p ON c.case_id = p.case_id""", **EVAL, cases=CASES)
oracle("eval_field_accuracy", ("sft",), """
SELECT path, count(*) FILTER (WHERE match) AS correct, count(*) AS total,
  count(*) FILTER (WHERE match) * CAST(100 AS DOUBLE) / count(*) AS pct FROM scored GROUP BY path""", **EVAL)
oracle("eval_summary", ("sft",), """
SELECT count(*) AS cases, count(*) FILTER (WHERE outcome = 'passed') AS passed,
  count(*) FILTER (WHERE outcome <> 'passed') AS failed,
  count(*) FILTER (WHERE outcome = 'passed') * CAST(100 AS DOUBLE) / count(*) AS pct FROM cases""", **EVAL, cases=CASES)
oracle("eval_failure_samples", ("sft",), """
SELECT case_id, path, gold, pred FROM scored WHERE NOT match AND case_id IN (
  SELECT case_id FROM cases WHERE outcome = 'failed' ORDER BY case_id LIMIT 5)""", **EVAL, cases=CASES)
oracle("eval_unreadable", ("predictions",), f"""
SELECT t.case_id, CAST(length(raw_output) AS INTEGER) AS raw_len, {preview('raw_output')} AS raw_preview
FROM truth t JOIN predictions p ON t.case_id = p.case_id WHERE clean_json IS NULL AND t.case_id % 13 <> 0""",
    truth=TRUTH)

CHECKED = f"""SELECT a.case_pos, a.pos, a.path, a.expected, regexp_extract(a.path, '[^.]*$') AS field,
  CASE a.pos WHEN 0 THEN {_value('raw_json', '$.extracted_data.document_classification')}
    WHEN 1 THEN {_value('raw_json', '$.extracted_data.case_specific_fields.case_type_pre_service')}
    ELSE {_value('raw_json', '$.extracted_data.case_specific_fields.case_type_post_service')} END AS actual
  FROM asserts_long a JOIN truth t ON a.case_pos = t.case_id"""
BACK = {
    "truth": TRUTH,
    "asserts_long": ASSERTS,
    "checks": CHECKED,
    "per_case": """SELECT case_pos, count(*) AS n_checks, count(*) FILTER (WHERE trim(actual) = trim(expected)) AS n_match
  FROM checks GROUP BY case_pos""",
    "scored": """SELECT b.case_pos, t.cls AS gold_class, t.raw_json IS NOT NULL AS pred_ok, t.raw_json,
  coalesce(n_checks, 0) AS n_checks, coalesce(n_match, 0) AS n_match, b.output,
  t.raw_json IS NOT NULL AND coalesce(n_checks, 0) = coalesce(n_match, 0) AS passed
  FROM backtest b JOIN truth t ON b.case_pos = t.case_id LEFT JOIN per_case c ON b.case_pos = c.case_pos""",
}
oracle("backtest_score", ("backtest",), """
SELECT case_pos, gold_class, pred_ok, passed, CAST(n_checks AS INTEGER) AS n_checks, CAST(n_match AS INTEGER) AS n_match
FROM scored""", **BACK)
oracle("backtest_summary", ("backtest",), """
SELECT count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
  count(*) FILTER (WHERE passed) * CAST(100 AS DOUBLE) / count(*) AS pct FROM scored""", **BACK)
oracle("backtest_outcomes", ("backtest",), """
SELECT outcome, count(*) AS cases, CASE outcome WHEN 'passed' THEN '✓' WHEN 'failed' THEN '✗' ELSE '?' END AS mark
FROM (SELECT CASE WHEN starts_with(output, 'ERROR:') THEN 'inference_error' WHEN NOT pred_ok THEN 'unparseable'
  WHEN passed THEN 'passed' ELSE 'failed' END AS outcome FROM scored) GROUP BY outcome""", **BACK)
oracle("assert_field_accuracy", ("backtest",), """
SELECT field, count(*) FILTER (WHERE trim(actual) = trim(expected)) AS correct, count(*) AS total,
  count(*) FILTER (WHERE trim(actual) = trim(expected)) * CAST(100 AS DOUBLE) / count(*) AS pct
FROM checks GROUP BY field""", **BACK)
PAIRS = "SELECT expected AS gold, actual AS pred FROM checks WHERE contains(path, 'document_classification')"
oracle("confusion_long", ("backtest",), """
SELECT gold, pred, count(*) AS n FROM pairs GROUP BY gold, pred""", **BACK, pairs=PAIRS)
oracle("confusion_dense", ("backtest",), """
SELECT g.label AS gold, p.label AS pred, (SELECT count(*) FROM pairs WHERE gold = g.label AND pred = p.label) AS n
FROM labels g, labels p""", **BACK, pairs=PAIRS,
    labels="SELECT unnest(['Pre-Service Appeal', 'Post-Service Appeal', 'Grievance', 'Provider Dispute', 'Inquiry']) AS label")
oracle("backtest_running", ("backtest",), """
SELECT case_pos, count(*) OVER w AS done, CAST(sum(CAST(passed AS INTEGER)) OVER w AS BIGINT) AS passed_so_far,
  CAST(sum(CAST(passed AS INTEGER)) OVER w AS BIGINT) * CAST(100 AS DOUBLE) / count(*) OVER w AS running_pct
FROM scored WINDOW w AS (ORDER BY case_pos ROWS UNBOUNDED PRECEDING)""", **BACK)
oracle("retest_score", ("retest", "sft"), f"""
SELECT r.case_id, CASE WHEN r.case_id % 13 = 0 OR r.case_id % 11 = 0 OR r.case_id % 7 = 0 OR r.case_id % 5 = 0
    OR r.case_id % 4 = 0 THEN 'ERROR'
  WHEN lower(trim({_value('answer', '$.extracted_data.document_classification')})) = lower(trim(exp_document_classification))
    AND lower(trim({_value('answer', '$.extracted_data.case_specific_fields.case_type_pre_service')})) = lower(trim(exp_case_type_pre_service))
  THEN 'PASS' ELSE 'FAIL' END AS outcome FROM retest r JOIN sft s ON r.case_id = s.rec_id""")

# -- focus -----------------------------------------------------------------------------

CATEGORY = """SELECT case_pos, gold_class, raw_json, pred_ok, CASE WHEN gold_class IS NULL THEN 'ignored' WHEN passed THEN 'anchor'
  WHEN gold_class = 'Pre-Service Appeal' THEN 'failure' ELSE 'discarded' END AS category FROM scored"""
ANCHORS = """SELECT * FROM (SELECT gold_class, case_pos, raw_json, CAST(row_number() OVER (PARTITION BY gold_class ORDER BY case_pos) AS INTEGER) AS row_no
  FROM cats WHERE category = 'anchor') WHERE row_no <= 6"""
FOCUS = {**BACK, "cats": CATEGORY, "anchors": ANCHORS}
oracle("focus_categories", ("backtest",), "SELECT case_pos, gold_class, category FROM cats", **FOCUS)
oracle("focus_anchors", ("backtest",), "SELECT gold_class, case_pos, row_no FROM anchors", **FOCUS)
oracle("focus_donor", ("backtest",), """
SELECT c.case_pos, c.gold_class, coalesce(a.raw_json, '{"extracted_data": {}}') AS base
FROM cats c LEFT JOIN anchors a ON c.gold_class = a.gold_class AND a.row_no = 1
WHERE c.gold_class IS NOT NULL AND NOT c.pred_ok""", **FOCUS)
_OPEN = '{"extracted_data": {'
oracle("focus_corrected", ("backtest",), f"""
SELECT c.case_pos, c.gold_class, CASE WHEN base = '{_OPEN}"service_type": "x"}}}}' THEN
  '{_OPEN}"service_type": "Pre-Service", "case_specific_fields": {{"case_type_post_service": "", '
  || '"case_type_grievance": "", "type_of_issue": "", "case_type_pre_service": "en"}}, '
  || '"document_classification": "Pre-Service Appeal"}}}}'
ELSE '{_OPEN}"document_classification": "Pre-Service Appeal", "service_type": "Pre-Service", "manual_review": '
  || json_extract_string(base, '$.extracted_data.manual_review')
  || ', "member": "[PRIVATE_PERSON]", "case_specific_fields": {{"case_type_pre_service": "en", '
  || '"case_type_post_service": "", "case_type_grievance": "", "type_of_issue": ""}}}}}}' END AS corrected
FROM (SELECT c.case_pos, c.gold_class, coalesce(c.raw_json, a.raw_json) AS base FROM cats c
  LEFT JOIN anchors a ON a.gold_class = c.gold_class AND a.row_no = 1 WHERE c.category = 'failure') c""", **FOCUS)
FIXED = ORACLES["focus_corrected"].rpartition("AS corrected")[0].rpartition("SELECT c.case_pos, c.gold_class, ")[2]
oracle("focus_dataset", ("backtest",), """
SELECT rec_id, kind, f.cls, variant, 'You classify cases.' AS system, n.user_text, f.answer
FROM filled f JOIN noisy n USING (rec_id, variant)""", **FOCUS,
    fixed=f"""SELECT c.case_pos, 'failure' AS kind, c.gold_class AS cls, {FIXED} AS answer
    FROM (SELECT c.case_pos, c.gold_class, coalesce(c.raw_json, a.raw_json) AS base FROM cats c
      LEFT JOIN anchors a ON a.gold_class = c.gold_class AND a.row_no = 1 WHERE c.category = 'failure') c
    UNION ALL SELECT case_pos, 'anchor', gold_class, raw_json FROM anchors""",
    fanned="""SELECT rec_id, kind, cls, user_text, answer, CAST(v AS INTEGER) AS variant FROM (
    SELECT f.case_pos AS rec_id, f.kind, f.cls, coalesce(b.input, '') AS user_text, f.answer,
      unnest(range(0, CASE kind WHEN 'failure' THEN 41 ELSE 16 END)) AS v FROM fixed f JOIN backtest b ON b.case_pos = f.case_pos)""",
    **DRAWN, **noisy("filled"))
oracle("focus_summary", ("backtest",), """
SELECT cls, CAST(sum(CASE kind WHEN 'failure' THEN 41 ELSE 16 END) AS BIGINT) AS records,
  count(*) FILTER (WHERE kind = 'failure') AS failure_seeds, count(*) FILTER (WHERE kind = 'anchor') AS anchor_seeds
FROM (SELECT gold_class AS cls, 'failure' AS kind FROM cats WHERE category = 'failure'
  UNION ALL SELECT gold_class, 'anchor' FROM anchors) GROUP BY cls""", **FOCUS)

# -- synth -----------------------------------------------------------------------------

MARKS = f"SELECT DISTINCT {strip('marker')} AS marker FROM markers WHERE {strip('marker')} <> ''"
oracle("marker_semi", ("documents", "markers"), """
SELECT doc_id AS rec_id FROM documents d WHERE EXISTS (SELECT 1 FROM marks m WHERE contains(d.text, m.marker))""",
    marks=MARKS)
oracle("marker_sharded", ("documents", "markers"), """
SELECT doc_id AS rec_id FROM documents d WHERE EXISTS (SELECT 1 FROM marks m WHERE contains(d.text, m.marker))""",
    marks=MARKS)
oracle("synth_work", ("sft", "markers"), """
SELECT rec_id, hit AS is_failure, CASE WHEN hit THEN 12 ELSE 4 END AS n_variants FROM (
  SELECT rec_id, EXISTS (SELECT 1 FROM marks m WHERE contains(s.system, m.marker) OR contains(s.user_text, m.marker)
    OR contains(s.answer, m.marker)) AS hit FROM sft s)""", marks=MARKS)
GATED = """SELECT v.seed_id, CAST(v.variant AS INTEGER) AS variant, v.variant_text, c.cls AS variant_class,
  CASE WHEN coalesce(v.variant_text, '') = '' THEN 'paraphrase_failed'
    WHEN NOT coalesce(json_valid(v.label_text), false) THEN 'label_failed'
    WHEN c.cls IS DISTINCT FROM s.cls THEN 'drift' ELSE 'kept' END AS outcome, s.system
  FROM variants v JOIN sft s ON v.seed_id = s.rec_id
  LEFT JOIN (SELECT seed_id, variant, CASE WHEN json_valid(label_text) THEN
    json_extract_string(label_text, '$.extracted_data.document_classification') END AS cls FROM variants) c
  ON c.seed_id = v.seed_id AND c.variant = v.variant"""
oracle("synth_drift", ("variants",), "SELECT seed_id, variant, variant_class FROM gated WHERE outcome = 'kept'", gated=GATED)
oracle("synth_summary", ("variants",), "SELECT outcome, count(*) AS n FROM gated GROUP BY outcome", gated=GATED)
oracle("synth_dataset", ("variants",), """
SELECT rec_id AS seed_id, 0 AS variant, system, user_text FROM sft
UNION ALL SELECT seed_id, variant, system, variant_text FROM gated WHERE outcome = 'kept'""", gated=GATED)

# -- OCR and detection -----------------------------------------------------------------


def _tidy(x: str) -> str:
    x = rf"regexp_replace({x}, '<\|ref\|>(.*?)<\|/ref\|>', '\1', 'gs')"
    x = rf"regexp_replace({x}, '<\|det\|>.*?<\|/det\|>', '', 'gs')"
    x = rf"regexp_replace({x}, '[ \t]+\n', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"{strip(x)} || chr(10)"


KEPT = """SELECT *, count(*) OVER (PARTITION BY doc_id) AS pages,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS row_no FROM ocr_pages"""
JOINED = """SELECT doc_id, any_value(pages) AS pages, count(*) AS kept_pages, string_agg(text, chr(10) ORDER BY page_no) AS raw_text
  FROM kept WHERE row_no <= 20 GROUP BY doc_id"""
PROMPT = "CASE WHEN least(pages, 20) = 1 THEN '<image>document parsing.' ELSE '<image>Multi page parsing.' END"
WINDOW = "CASE WHEN least(pages, 20) = 1 THEN 128 ELSE 1024 END AS ngram_window"
oracle("ocr_clean", ("ocr_pages",), f"SELECT doc_id, page_no, {_tidy('text')} AS text FROM ocr_pages")
oracle("ocr_page_cap", ("ocr_pages",), f"""
SELECT doc_id, page_no, row_no, pages, least(pages, 20) AS kept_pages, {PROMPT} AS prompt, {WINDOW}
FROM kept WHERE row_no <= 20""", kept=KEPT)
oracle("ocr_assemble", ("ocr_pages",), f"""
SELECT doc_id, CAST(kept_pages AS INTEGER) AS kept_pages, {WINDOW}, {PROMPT} || chr(10) || raw_text AS content
FROM joined""", kept=KEPT, joined=JOINED)
oracle("ocr_corpus", ("ocr_pages",), """
SELECT doc_id, pages, CAST(kept_pages AS INTEGER) AS kept_pages, pages - kept_pages AS dropped_pages,
  CAST(length(raw_text) - length(text) AS INTEGER) AS removed_chars, text FROM tidy""",
    kept=KEPT, joined=JOINED, tidy=f"SELECT *, {_tidy('raw_text')} AS text FROM joined")

SHAPED = """SELECT det_id, image_id, score,
  CASE WHEN pts IS NULL THEN b[1] ELSE list_min(list_transform(pts, lambda p: p[1])) END AS xmin,
  CASE WHEN pts IS NULL THEN b[2] ELSE list_min(list_transform(pts, lambda p: p[2])) END AS ymin,
  CASE WHEN pts IS NULL THEN b[3] ELSE list_max(list_transform(pts, lambda p: p[1])) END AS xmax,
  CASE WHEN pts IS NULL THEN b[4] ELSE list_max(list_transform(pts, lambda p: p[2])) END AS ymax,
  coalesce(pts, [[b[1], b[2]], [b[1], b[4]], [b[3], b[4]], [b[3], b[2]]]) AS poly
  FROM (SELECT *, CASE WHEN starts_with(box, '[[') THEN CAST(CAST(box AS JSON) AS DOUBLE[][]) END AS pts,
    CASE WHEN NOT starts_with(box, '[[') THEN CAST(CAST(box AS JSON) AS DOUBLE[]) END AS b FROM detections)"""
oracle("det_geometry", ("detections",), """
SELECT det_id, score, xmin, ymin, xmax, ymax, array_to_string(list_transform(poly,
  lambda p: CAST(p[1] AS VARCHAR) || ',' || CAST(p[2] AS VARCHAR)), ' ') AS polygon FROM shaped""", shaped=SHAPED)
oracle("det_per_image", ("detections",), """
SELECT image_id, count(*) AS detections, max(score) AS max_score, min(xmin) AS xmin, min(ymin) AS ymin,
  max(xmax) AS xmax, max(ymax) AS ymax
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM shaped WHERE score >= 0.45)
WHERE rn <= 3000 GROUP BY image_id""", shaped=SHAPED)

# -- routing ---------------------------------------------------------------------------

ROUTED = {
    "named": """SELECT *, CASE WHEN content_type = 'application/json' AND json_valid(body)
    THEN json_extract_string(body, '$.model') END AS body_model FROM requests""",
    "wanted": "SELECT *, coalesce(model_header, body_model) AS requested_model FROM named",
    "found": """SELECT w.*, m.backend AS m_backend, m.served_model AS m_served, p.backend AS p_backend
    FROM wanted w LEFT JOIN routes m ON w.requested_model = m.model LEFT JOIN path_routes p ON w.path = p.path""",
    "routed": """SELECT *, CASE WHEN content_type = 'application/json' AND NOT json_valid(body) THEN 'Request body is not valid JSON'
    WHEN model_header <> body_model THEN 'X-Model and JSON model fields disagree'
    WHEN requested_model IS NOT NULL AND m_backend IS NULL THEN 'Unknown model: ' || requested_model
    WHEN requested_model IS NULL AND p_backend IS NULL
      THEN 'Request must include a configured JSON model field or X-Model header' END AS error FROM found""",
    "answered": """SELECT *, CASE WHEN error IS NULL THEN 200 WHEN starts_with(error, 'Unknown') THEN 404 ELSE 400 END AS status,
    CASE WHEN error IS NULL THEN coalesce(m_backend, p_backend) END AS backend,
    CASE WHEN error IS NULL AND content_type = 'application/json' THEN m_served END AS forwarded_model FROM routed""",
}
R = ("requests", "routes", "path_routes")
oracle("route_requests", R, """
SELECT req_id, requested_model, status, error, backend, forwarded_model FROM answered""", **ROUTED)
oracle("route_forward", R, """
SELECT req_id, backend, CASE WHEN forwarded_model IS NULL THEN body
  ELSE '{"model":"' || forwarded_model || '","k":' || req_id || '}' END AS forwarded_body FROM answered WHERE status = 200""", **ROUTED)
oracle("route_report", R, "SELECT backend, status, count(*) AS requests FROM answered GROUP BY backend, status", **ROUTED)
oracle("route_unknown_models", R, """
SELECT requested_model, count(*) AS requests FROM answered WHERE status = 404 GROUP BY requested_model""", **ROUTED)
oracle("route_audit", ("requests", "routes_broken", "path_routes_broken"), """
SELECT problem, subject, (SELECT count(*) FROM requests r WHERE r.path = subject) + (SELECT count(*) FROM requests r
  WHERE content_type = 'application/json' AND CASE WHEN json_valid(body) THEN json_extract_string(body, '$.model') END = subject) AS requests
FROM problems""", problems="""
  SELECT 'no url' AS problem, backend AS subject FROM routes_broken GROUP BY backend HAVING max(url) IS NULL
  UNION ALL SELECT 'no models', backend FROM routes_broken GROUP BY backend HAVING count(model) = 0
  UNION ALL SELECT 'model configured twice', model FROM routes_broken GROUP BY model HAVING count(DISTINCT backend) > 1
  UNION ALL SELECT 'path must start with /', path FROM path_routes_broken WHERE NOT starts_with(path, '/')
  UNION ALL SELECT 'path to unknown backend', path FROM path_routes_broken
    WHERE backend NOT IN (SELECT backend FROM routes_broken)""")

# -- inventory -------------------------------------------------------------------------


def _human(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    steps = " ".join(
        f"WHEN {x} / {1024**p} < 1024 THEN format('{{:.1f}} {u}', {x} / {1024**p})"
        for p, u in enumerate(("B", "KB", "MB", "GB", "TB")))
    return f"CASE WHEN {x} IS NULL THEN NULL {steps} ELSE format('{{:.1f}} PB', {x} / {1024**5}) END"


SIZES = """SELECT replace(substr(dir, 9), '--', '/') AS hf_id, CAST(sum(length) AS BIGINT) AS size_bytes
  FROM files WHERE starts_with(dir, 'models--') GROUP BY 1"""
LATEST = """SELECT alias, hf_id, serve_backend, line_no FROM (
  SELECT *, row_number() OVER (PARTITION BY alias ORDER BY line_no DESC) AS rn FROM registry) WHERE rn = 1"""
oracle("inventory_sizes", ("files",), "SELECT hf_id, size_bytes FROM sizes", sizes=SIZES)
oracle("inventory_rollup", ("files",), f"""
SELECT hf_id, size_bytes, {_human('size_bytes')} AS size FROM (SELECT * FROM sizes
UNION ALL SELECT 'TOTAL', CAST(sum(size_bytes) AS BIGINT) FROM sizes)""", sizes=SIZES)
oracle("registry_dedup", ("registry",), "SELECT alias, hf_id, serve_backend, line_no FROM latest", latest=LATEST)
STATUS = f"""SELECT alias, l.hf_id, size_bytes IS NOT NULL AS downloaded, coalesce({_human('size_bytes')}, '—') AS size,
  coalesce(serve_backend, 'vllm') AS backend FROM latest l LEFT JOIN sizes s ON l.hf_id = s.hf_id"""
EXTRA = f"""SELECT hf_id, size_bytes, {_human('size_bytes')} AS size FROM sizes
  WHERE hf_id NOT IN (SELECT hf_id FROM latest)"""
INV = {"sizes": SIZES, "latest": LATEST, "status": STATUS, "extra": EXTRA}
oracle("registry_status", ("registry", "files"), "SELECT * FROM status", **INV)
oracle("registry_extra", ("registry", "files"), "SELECT * FROM extra", **INV)
oracle("inventory_reconcile", ("registry", "files"), """
SELECT alias, hf_id, downloaded, size, backend FROM status
UNION ALL SELECT NULL, hf_id, true, size, NULL FROM extra""", **INV)

# -- runs ------------------------------------------------------------------------------

CATALOG = "SELECT dir, coalesce(created_at, 'unknown') AS created_at, base_model FROM run_meta"
oracle("run_catalog", ("run_meta",), CATALOG)
LOG = {
    "steps": r"""SELECT run, line_no, value, contains(value, '''loss'':') AS is_step,
    TRY_CAST(nullif(regexp_extract(value, '''loss'': ([0-9.]+)', 1), '') AS DOUBLE) AS loss,
    TRY_CAST(nullif(regexp_extract(value, '''epoch'': ([0-9.]+)', 1), '') AS DOUBLE) AS epoch,
    TRY_CAST(nullif(regexp_extract(value, '''learning_rate'': ([0-9.eE+-]+)', 1), '') AS DOUBLE) AS lr FROM run_log""",
    "errs": r"""SELECT run, string_agg(value, chr(10) ORDER BY line_no) AS recent_errors FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY line_no DESC) AS rn FROM run_log
    WHERE regexp_matches(value, '(?i)error|traceback|exception')) WHERE rn <= 3 GROUP BY run""",
    "last": """SELECT run, max(line_no) FILTER (WHERE is_step) AS at, bool_or(contains(value, 'Adapter saved to')) AS completed
    FROM steps GROUP BY run""",
    "status": """SELECT l.run, s.loss, s.epoch, s.lr AS learning_rate, l.completed, CAST(NULL AS DOUBLE) AS final_loss, e.recent_errors
    FROM last l LEFT JOIN steps s ON l.run = s.run AND l.at = s.line_no LEFT JOIN errs e ON l.run = e.run""",
}
oracle("runlog_status", ("run_log",), "SELECT * FROM status", **LOG)
oracle("src_log", ("run_log",), "SELECT * FROM status", **LOG)
oracle("run_report", ("run_meta", "run_log"), """
SELECT c.dir, c.created_at, c.base_model, loss, epoch, learning_rate, completed, final_loss, recent_errors,
  CASE WHEN c.created_at <> 'unknown' THEN CAST(sec // 3600 AS VARCHAR) || 'h ' || CAST(sec % 3600 // 60 AS VARCHAR) || 'm '
    || CAST(sec % 60 AS VARCHAR) || 's' END AS elapsed
FROM (SELECT *, CAST(epoch(TIMESTAMP '2024-01-02 03:04:05') - epoch(CAST(TRY_CAST(replace(created_at, 'Z', '') AS TIMESTAMP) AS TIMESTAMP)) AS BIGINT) AS sec
  FROM catalog) c LEFT JOIN status s ON c.dir = s.run""", **LOG, catalog=CATALOG)

oracle("stream_runlog_status", ("run_log",), """
SELECT run, loss, epoch, learning_rate, completed, final_loss FROM status""", **LOG)
oracle("stream_run_errors", ("run_log",), "SELECT * FROM status", **LOG)
oracle("stream_route", R, """
SELECT req_id, requested_model, status, error, backend, forwarded_model FROM answered""", **ROUTED)
oracle("stream_score", ("backtest",), """
SELECT case_pos, gold_class, passed, CASE WHEN starts_with(output, 'ERROR:') THEN 'inference_error'
  WHEN NOT pred_ok THEN 'unparseable' WHEN passed THEN 'passed' ELSE 'failed' END AS outcome FROM scored""", **BACK)

oracle("stream_score_resume", ("backtest",), """
SELECT case_pos, gold_class, passed, CASE WHEN starts_with(output, 'ERROR:') THEN 'inference_error'
  WHEN NOT pred_ok THEN 'unparseable' WHEN passed THEN 'passed' ELSE 'failed' END AS outcome FROM scored""", **BACK)

QUANTILES = ",\n  ".join(
    f"quantile_cont({src}, {q / 100}) FILTER (WHERE failed = 0) AS p{q}_{out}"
    for src, out in (("ttft_ms", "ttft_ms"), ("e2e_ms", "e2el_ms")) for q in (50, 90, 95, 99))
BENCH = f"""SELECT concurrency AS max_concurrency, count(*) FILTER (WHERE failed = 0) AS completed,
  CAST(sum(failed) AS BIGINT) AS failed, avg((e2e_ms - ttft_ms) / (output_tokens - 1)) FILTER (WHERE failed = 0) AS mean_tpot_ms,
  {QUANTILES},
  count(*) FILTER (WHERE failed = 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS request_throughput,
  sum(output_tokens) FILTER (WHERE failed = 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS output_throughput
  FROM bench_requests GROUP BY concurrency"""
oracle("bench_compare", ("bench_requests",), """
SELECT max_concurrency, completed, failed, round(mean_tpot_ms, 6) AS mean_tpot_ms, p50_ttft_ms, p90_ttft_ms, p95_ttft_ms,
  p99_ttft_ms, p50_e2el_ms, p90_e2el_ms, p95_e2el_ms, p99_e2el_ms, request_throughput, output_throughput FROM bench""", bench=BENCH)
oracle("bench_table", ("bench_requests",), """
SELECT CAST(max_concurrency AS VARCHAR) AS max_concurrency, format('{:.2f}', request_throughput) AS request_throughput,
  format('{:.2f}', output_throughput) AS output_throughput, format('{:.2f}', p50_ttft_ms) AS p50_ttft_ms,
  format('{:.2f}', p99_ttft_ms) AS p99_ttft_ms, format('{:.2f}', mean_tpot_ms) AS mean_tpot_ms,
  format('{:.2f}', p99_e2el_ms) AS p99_e2el_ms, failed FROM bench""", bench=BENCH)
