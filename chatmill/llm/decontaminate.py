"""Benchmark decontamination with DataFrame functions only.

Texts and benchmark items are reduced to words (ASCII capitals made small;
letters, digits and every non-ASCII character belong to words).  A window is
``width`` consecutive words of an item, or a shorter item whole.  The windows
form a hash set that is broadcast; documents are scanned once: each window has a
key, its word that is rarest among the windows (the longest of those), which is
looked up in a hash set of such words, and only around those places the window's
words are compared with the document's.

The benchmark is taken in blocks of about ``block`` keys and ``most`` windows (as
many blocks as it needs), so what a task holds is bounded for any benchmark; the
windows of a key that has very many are dealt out to all blocks.  Each block is
one scan of the documents.  A block above ``most_bytes`` (very long words, or
windows that very many items share) is not broadcast but joined by its keys.

Defined cases: null or wordless texts and items have no windows and no hits;
repeated items count under each of their ids; rows with equal id and text get
equal results, one each; a null item id counts as a hit but names no item; empty
tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small(text: Column) -> Column:
    """ASCII capitals made small, all else unchanged."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def words(text: Column) -> Column:
    return F.array_remove(F.split(small(F.coalesce(text, F.lit(""))), GAP), "")


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """``win, items``: distinct windows and the ids of their items."""
    worded = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    win = worded.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, width))).alias("win"))
    return win.groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def keyed(wins: DataFrame) -> DataFrame:
    """``wins`` with ``key``, ``place`` and ``n``: a window's rarest word, its place (from 1), how many windows have that key.

    Rare is what few windows hold, in classes of powers of two; of one class the longest word is taken.
    """
    worded = wins.select("win", F.explode(F.array_distinct("win")).alias("word"))
    # Written, so that a join with a very common word can be split.
    counts = written(worded.groupBy(F.col("word").alias("_word")).agg(F.floor(F.log2(F.count("*"))).alias("often")), "window-words")
    rank = F.struct("often", (-F.length("word")).alias("short"), "word")
    chosen = worded.join(counts, F.col("word") == F.col("_word")).groupBy("win").agg(F.min(rank)["word"].alias("key"))
    chosen = written(wins.join(chosen, "win").withColumn("place", F.array_position("win", F.col("key")).cast("int")), "windows")
    load = written(chosen.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")), "window-keys")
    return chosen.join(load, F.col("key") == F.col("_key")).drop("_key")


def _found(docs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``doc_id, digest, n_words, places``: where words of ``keys`` stand, with the words around."""
    worded = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    listed = ", ".join(f"'{k}'" for k in keys) or "''"  # words hold no quotes and no backslashes
    at = F.expr(f"filter(transform(words, (w, i) -> IF(w IN ({listed}), i + 1, 0)), p -> p > 0)")
    around = lambda p: F.struct(
        p.alias("at"), F.element_at("words", p).alias("key"),
        F.slice("words", F.greatest(p - (width - 1), F.lit(1)), 2 * width - 1).alias("near"),
    )
    return worded.select("doc_id", "digest", "words", at.alias("at")).select(
        "doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.transform("at", around).alias("places")
    )


def blocked(wins: DataFrame, block: int, most: int) -> tuple[DataFrame, int]:
    """``wins`` with ``number``, the block of each, and how many blocks there are."""
    wins = keyed(wins)
    size = wins.agg(F.count("*").alias("windows"), F.sum(F.lit(1) / F.col("n")).alias("keys")).first()
    blocks = max(1, math.ceil(size["windows"] / most), math.ceil(round(size["keys"] or 0) / block))
    dealt = F.when(F.col("n") * 16 > most, F.xxhash64("win")).otherwise(F.xxhash64("key"))
    return written(wins.withColumn("number", F.pmod(dealt, F.lit(blocks))), "window-blocks"), blocks


def hits(
    docs: DataFrame, items: DataFrame, width: int = 10, block: int = 20_000, most: int = 100_000, most_bytes: int = 64 << 20
) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (``doc_id, digest, n_words``) and occurrences of windows
    (``doc_id, digest, start, length, items``)."""
    wins, blocks = blocked(windows(items, width), block, most)
    length = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8)
    sizes = wins.groupBy("number").agg(F.sum(length("win") + length("items") + F.octet_length("key")).alias("bytes"))
    sizes = {r["number"]: r["bytes"] for r in sizes.collect()}  # one row a block
    rows, found = None, []
    for number in range(blocks):
        mine = wins.where(F.col("number") == number).drop("number", "n")
        keys = sorted(r["key"] for r in mine.select("key").distinct().collect())  # about ``block`` words
        scanned = written(_found(docs, keys, width), "key-places")
        rows = scanned.select("doc_id", "digest", "n_words") if rows is None else rows
        place = scanned.select("doc_id", "digest", F.explode("places").alias("p")).select("doc_id", "digest", "p.*")
        mine = mine.withColumnRenamed("key", "_key")
        if sizes.get(number, 0) <= most_bytes:
            mine = F.broadcast(mine)
        start = F.col("at") - F.col("place") + 1
        offset = start - F.greatest(F.col("at") - (width - 1), F.lit(1)) + 1
        same = F.when(start >= 1, F.slice("near", F.greatest(offset, F.lit(1)), F.size("win")) == F.col("win"))
        found.append(
            place.join(mine, (F.col("key") == F.col("_key")) & same)
            .select("doc_id", "digest", start.alias("start"), F.size("win").alias("length"), "items")
        )
    return rows, reduce(DataFrame.unionByName, found)


def report(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_items`` of every document."""
    rows, found = hits(docs, items, width)
    spans = F.collect_set(F.struct("start", "length"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    per_row = (
        found.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("names"))
        .select("_id", "_digest", F.size(covered).cast("long").alias("hit"), "names")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return rows.join(per_row, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), names.alias("hit_items"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns unchanged."""
    _, found = hits(docs, items, width)
    bad = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_digest"])
    return docs.join(bad, same, "left_anti")


def sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same in DuckDB's SQL (windows of ten words)."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = f"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{word}')"
    return f"""
WITH d AS (SELECT doc_id, {listed} AS words FROM {documents}),
i AS (SELECT item_id, {listed} AS words FROM {benchmark}),
p AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM i WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, list_slice(words, s, s + 9) AS win FROM p),
n AS (SELECT DISTINCT len(win) AS n FROM w),
o AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, n WHERE len(words) >= n),
h AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, list_slice(words, s, s + n - 1) AS win FROM o) JOIN w USING (win)),
k AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""
