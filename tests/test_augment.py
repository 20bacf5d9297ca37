import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatmill.functions import noise
from chatmill.functions import placeholders as ph
from chatmill.plans import augment

TEXT = "Dear [PRIVATE_PERSON], on [PRIVATE_DATE] call [PRIVATE_PHONE] or [PRIVATE_EMAIL]; [PRIVATE_ADDRESS], [ACCOUNT_NUMBER]. [PRIVATE_PERSON] [x] ["
ANSWER = '{"extracted_data": {"document_classification": "%s", "who": "[PRIVATE_PERSON]", "l": [1, 2]}}'


@pytest.fixture(scope="module")
def records(rows):
    data = [
        (1, "sys", TEXT, ANSWER % "Pre-Service Appeal"),
        (2, "sys", "nothing here", ANSWER % "Inquiry"),
        (3, "sys", TEXT, "broken {"),
        (4, "sys", TEXT, '{"extracted_data": {"document_classification": ""}, "n": [ACCOUNT_NUMBER]}'),
        (5, "sys", "", '{"extracted_data": {}}'),
    ]
    return rows(data, "rec_id long, system string, user_text string, answer string")


def variants_of(records, noise=0.0):
    got = augment.augment(records, noise=noise).data.collect()
    return {(r.rec_id, r.variant): [m.content for m in r.messages] for r in got}, got


def test_originals_and_counts(records):
    got, rows_ = variants_of(records)
    source = {r.rec_id: r for r in records.collect()}
    for rec_id, row in source.items():
        assert got[rec_id, 0] == [row.system, row.user_text, row.answer]
    per = {i: sum(k[0] == i for k in got) for i in source}
    assert per[1] == 13 and per[2] == 5 and per[3] == 1 and per[5] == 5
    # A bare account placeholder turns into a number: valid unless it starts with 0.
    assert all(json.loads(got[k][2]) for k in got if k[0] == 4 and k[1] > 0)
    by = {r.cls: (r.originals, r.variants, r.total) for r in augment.augment(records).by_class.collect()}
    assert by["Pre-Service Appeal"] == (1, 12, 13)
    assert by["(unknown)"][0] == 3
    assert sum(v[2] for v in by.values()) == len(rows_)


def test_same_value_on_both_sides_and_formats(records):
    got, _ = variants_of(records)
    shape = re.compile(
        r"Dear ([A-Z]\w+ [A-Z]\w+), on (\d\d)-(\d\d)-(2024|2025) call \((\d{3})\) (\d{3})-(\d{4}) or "
        r"([a-z]+\.[a-z]+@[a-z]+\.[a-z]+); (\d{3,4}) [A-Z][\w ]+, [A-Z][\w ]+, [A-Z]{2} \d{5}, (\d{8,12})\. \1 \[x\] \["
    )
    seen = set()
    for v in range(1, 13):
        system, user, answer = got[1, v]
        m = shape.fullmatch(user)
        assert m, user
        assert json.loads(answer)["extracted_data"]["who"] == m[1]
        assert 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 28
        assert 200 <= int(m[5]) <= 999 and 200 <= int(m[6]) <= 999 and 1000 <= int(m[7]) <= 9999
        seen.add(m[1])
    assert len(seen) > 3
    assert got[2, 1][1] == "nothing here"


def test_repeatable_under_repartitioning(records):
    one = variants_of(records.repartition(1), noise=0.05)[0]
    assert one == variants_of(records.repartition(16), noise=0.05)[0]


def test_noise_rates_and_untouched_characters(rows):
    text = ("abcdefghij0O1lI58BGm .,;\n\t" * 400)[:10_000]
    df = rows([(i, text) for i in range(40)], "id long, t string")
    zero = df.select(noise.add_noise(F.col("t"), 0.0, F.col("id"))).distinct().collect()
    assert [r[0] for r in zero] == [text]
    changed = [r[0] for r in df.select(noise.add_noise(F.col("t"), 0.02, F.col("id"))).collect()]
    assert len(set(changed)) == 40
    blanks = re.sub(r"\w", "", text)
    assert all(re.sub(r"\w", "", c) == blanks for c in changed)
    again = df.repartition(7).select("id", noise.add_noise(F.col("t"), 0.02, F.col("id")).alias("n"))
    assert sorted(r.n for r in again.collect()) == sorted(changed)


def test_hits_are_independent_at_the_rate():
    n, rate = 4000, 0.03
    found = [(r, *hit) for r in range(500) for hit in noise.hits(f"key {r}", n, rate)]
    row, place, choice = (np.array(x) for x in zip(*found))
    assert len({(r, p) for r, p in zip(row.tolist(), place.tolist())}) == row.size
    total = n * 500
    sd = (total * rate * (1 - rate)) ** 0.5
    assert abs(row.size - total * rate) < 5 * sd
    # every tenth of the text gets its share, and the three choices are even
    tenths = np.bincount(place * 10 // n, minlength=10)
    assert np.all(np.abs(tenths - total * rate / 10) < 5 * (total * rate / 10) ** 0.5)
    thirds = np.bincount((choice * 3).astype(int), minlength=3)
    assert np.all(np.abs(thirds - row.size / 3) < 5 * (row.size * 2 / 9) ** 0.5)
    # neighbours are hit together as often as independence says
    pairs = sum((r, p + 1) in set(zip(row.tolist()[:2000], place.tolist()[:2000])) for r, p in list(zip(row.tolist(), place.tolist()))[:2000])
    assert pairs < 2000 * rate * 2 + 20


def test_noise_edge_rates(rows):
    assert [p for p, _ in noise.hits("k", 5, 1.0)] == [0, 1, 2, 3, 4] and list(noise.hits("k", 0, 1.0)) == []
    df = rows([(1, None), (2, ""), (3, "   ")], "id long, t string")
    got = df.select("id", noise.add_noise(F.col("t"), 1.0, F.col("id")).alias("n")).orderBy("id").collect()
    assert [r.n for r in got] == [None, "", "   "]
    text = noise.noisy_text("mmmmmmmmmmmmmmm", "k", 1.0)
    assert set(re.findall("rn|mm", text)) <= {"rn", "mm"} and "rn" in text


def test_pieces_rejoin(rows):
    texts = [TEXT, "", "[", "[[PRIVATE_PERSON]]", "line\n[ACCOUNT_NUMBER]\n"]
    df = rows([(t,) for t in texts], "t string")
    got = df.select("t", F.array_join(ph.pieces(F.col("t")), "").alias("j")).collect()
    assert all(r.t == r.j for r in got)


def test_pools_are_large_and_drawn_from_wholly(spark):
    assert len(set(ph.FIRST_NAMES)) >= 116 and len(set(ph.LAST_NAMES)) >= 104
    assert len(set(ph.STREETS)) >= 15 and len(set(ph.CITIES)) >= 15
    records = spark.range(800).selectExpr("id AS rec_id", "'s' AS system", "'[PRIVATE_PERSON]|[PRIVATE_ADDRESS]' AS user_text", "'{}' AS answer")
    made = augment.augment(records, normal=12, noise=0.0).data.where("variant > 0")
    parts = made.select(F.split(F.col("messages")[1]["content"], "[|]").alias("p")).select(F.split(F.col("p")[0], " ").alias("n"), F.col("p")[1].alias("a"))
    got = parts.agg(
        F.countDistinct(F.col("n")[0]), F.countDistinct(F.col("n")[1]), F.countDistinct("n"),
        F.countDistinct(F.regexp_extract("a", r"\d+ ([^,]+),", 1)), F.countDistinct(F.regexp_extract("a", r", (.*)$", 1)),
    ).first()
    assert got[0] == 120 and got[1] == 104 and got[2] > 5000 and got[3] == 15 and got[4] == 15
