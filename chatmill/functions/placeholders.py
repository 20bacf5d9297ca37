"""Placeholder substitution as native, repeatable column expressions.

A draw is 32 bits cut from the MD5 of ``seed:record:variant:kind``; one digest
yields up to four.  The same values come out on any cluster, after any retry and
in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The placeholders, in the order they are replaced.
PLACEHOLDERS = {
    "person": "[PRIVATE_PERSON]",
    "date": "[PRIVATE_DATE]",
    "phone": "[PRIVATE_PHONE]",
    "email": "[PRIVATE_EMAIL]",
    "address": "[PRIVATE_ADDRESS]",
    "account": "[ACCOUNT_NUMBER]",
}

# Names are composed of a beginning and an ending: 120 first and 104 last names.
FIRST_STARTS = ["Al", "Ber", "Cor", "Dar", "El", "Fen", "Gar", "Hal", "Is", "Jor", "Kel", "Lor"]
FIRST_ENDS = ["a", "an", "da", "en", "ia", "in", "is", "na", "on", "ric"]
LAST_STARTS = [
    "Ash", "Brack", "Cal", "Dun", "Elder", "Farrow", "Grey", "Hart", "Ingle", "Kings", "Mill", "Oak", "Raven",
]
LAST_ENDS = ["bourne", "by", "combe", "field", "ford", "ham", "more", "worth"]
FIRST_NAMES = [a + b for a in FIRST_STARTS for b in FIRST_ENDS]
LAST_NAMES = [a + b for a in LAST_STARTS for b in LAST_ENDS]
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
# Mail domains of generated addresses.
MAIL_DOMAINS = ["example.com", "mail.com", "inbox.org", "fastmail.net"]


def _draw(slot: int) -> str:
    return f"cast(conv(substring(d, {1 + 8 * slot}, 8), 16, 10) AS BIGINT)"


def _between(slot: int, low: int, high: int) -> str:
    return f"({_draw(slot)} % {high - low + 1} + {low})"


def _pick(slot: int, values: list[str]) -> str:
    pool = "split('" + "|".join(values) + "', '[|]')"  # folded to a constant array
    return f"element_at({pool}, cast({_draw(slot)} % {len(values)} + 1 AS INT))"


def _padded(number: str, width: int) -> str:
    return f"lpad(cast({number} AS STRING), {width}, '0')"


# Value of each kind as SQL over ``d``, the digest of (seed, record, variant, kind).
_VALUE = {
    "person": f"concat_ws(' ', {_pick(0, FIRST_NAMES)}, {_pick(1, LAST_NAMES)})",
    "date": f"concat_ws('-', {_padded(_between(0, 1, 12), 2)}, {_padded(_between(1, 1, 28), 2)}, "
    f"{_between(2, 2024, 2025)})",
    "phone": f"concat('(', {_between(0, 200, 999)}, ') ', {_between(1, 200, 999)}, '-', "
    f"{_between(2, 1000, 9999)})",
    "email": f"concat_ws('@', lower(concat_ws('.', {_pick(0, FIRST_NAMES)}, {_pick(1, LAST_NAMES)})), "
    f"{_pick(2, MAIL_DOMAINS)})",
    "address": f"concat({_between(0, 100, 9999)}, ' ', {_pick(1, STREETS)}, ', ', {_pick(2, CITIES)})",
    # 8 to 12 digits cut from two zero-padded draws
    "account": f"left(concat({_padded(_between(0, 0, 999_999), 6)}, {_padded(_between(1, 0, 999_999), 6)}), "
    f"cast({_between(2, 8, 12)} AS INT))",
}


def with_values(fanned: DataFrame, seed: int, key: str, variant: str = "variant") -> DataFrame:
    """Add one column per kind: its value for this variant, null where there is no such
    placeholder (``_has_<kind>`` is false) or the row is an original."""
    digests = {
        f"_d_{kind}": F.expr(
            f"CASE WHEN _has_{kind} AND {variant} > 0 "
            f"THEN md5(concat_ws(':', {seed}, {key}, {variant}, '{kind}')) END"
        )
        for kind in PLACEHOLDERS
    }
    values = {
        f"_{kind}": F.expr(sql.replace("substring(d,", f"substring(_d_{kind},"))
        for kind, sql in _VALUE.items()
    }
    # concat_ws skips nulls, hence the guard on the digest.
    guarded = {
        name: F.when(F.col(name.replace("_", "_d_", 1)).isNotNull(), v) for name, v in values.items()
    }
    return fanned.withColumns(digests).withColumns(guarded).drop(*digests)


def presence(*texts: Column) -> dict[str, Column]:
    """Per kind whether any of the texts holds its placeholder."""
    found = {}
    for kind, token in PLACEHOLDERS.items():
        held = F.lit(False)
        for text in texts:
            held = held | F.coalesce(text.contains(token), F.lit(False))
        found[kind] = held
    return found


_TOKENS = "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in PLACEHOLDERS.values())


def pieces(text: Column) -> Column:
    """The text as an array of placeholders and the stretches between them.

    Joined again the pieces give the text.  Done once per record, so that a
    variant only fills and joins.
    """
    return F.regexp_extract_all(text, F.lit(rf"{_TOKENS}|[^\[]+|\["), F.lit(0))


def fill(parts: str) -> Column:
    """Join a column of pieces with each placeholder replaced by the value of its kind."""
    cases = " ".join(f"WHEN '{token}' THEN _{kind}" for kind, token in PLACEHOLDERS.items())
    return F.expr(
        f"array_join(transform({parts}, p -> CASE WHEN startswith(p, '[') "
        f"THEN CASE p {cases} ELSE p END ELSE p END), '')"
    )


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike(_TOKENS), F.lit(False))
