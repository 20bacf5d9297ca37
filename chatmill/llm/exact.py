"""Exact deduplication with DataFrame functions only.

Texts are equal when they agree byte for byte after every run of ASCII white
space became one space.  Rows are grouped by a 128-bit content hash (the first
half of the SHA-256 of the normalised text); a group's size and smallest id are
combined in the map tasks, and no text is shuffled for it.  Then the bytes are
compared: texts whose hash occurs more than once are grouped by hash *and*
bytes, again combined in the map tasks, so a text with very many copies leaves
each of them once.  Hashes that turn out to hold several texts are taken out
and grouped by their bytes alone.

Which texts are sent to that comparison is decided by a bitmap of ``2**BITS``
bits over the recurring hashes.  It is broadcast and never larger than 8 MB; a
bit that is set by chance only adds a text to the comparison.

Groups that hold more than one row in ``HOT`` are at most ``HOT`` many: they are
broadcast to the rows.  All others join with a shuffle in which no key has more.

Defined cases: a null text is empty, and empty texts are equal; of equal texts
the row with the smallest id stays, null ids after all others; of repeated rows
(equal id and equal text) one stays, whichever; an empty table gives an empty
result; other columns are ignored by ``dedup`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import written

#: White-space runs other than one plain space, which would be replaced by itself.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BITS = 26
HOT = 1024
SALTS = 64


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def _hashed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, norm, sha, hash`` of every row; the hash is the first ``width`` bytes of the SHA-256."""
    norm = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    sha = norm.select("doc_id", "norm", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    return sha.withColumn("hash", F.substring("sha", 1, width))


def _first() -> Column:
    """The row of a group that stays: smallest id (null last), then smallest row number."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))


def _bit() -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(1 << BITS))


def _clashes(docs: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    """``hash`` of those recurring hashes that stand for more than one text."""
    maps = (
        copies.select(_bit().alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    texts = _hashed(docs, width).select("hash", "norm", _bit().alias("bit"))
    placed = texts.select("hash", "norm", F.bitmap_bucket_number("bit").alias("_bucket"), at.alias("place"))
    maybe = (
        placed.join(F.broadcast(maps), F.col("_bucket") == F.col("bucket"))
        .withColumn("byte", byte)
        .where("shiftright(byte, cast(place % 8 as int)) & 1 = 1")
    )
    each = maybe.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash")


def _told(rows: DataFrame, n: Column, first: Column) -> DataFrame:
    stays = F.coalesce(first["row"] == F.col("row"), F.lit(True))
    return rows.select(
        "doc_id", F.when(first.isNull(), F.col("doc_id")).otherwise(first["id"]).alias("keep_id"),
        F.coalesce(n, F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _by_hash(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The result for rows whose hash stands for one text."""
    copies = copies.withColumnRenamed("hash", "_hash")
    hot = copies.where(F.col("n") * HOT >= rows.count())  # at most HOT rows, as the groups add up to all rows
    near = rows.join(F.broadcast(hot), F.col("hash") == F.col("_hash"), "left")
    found = near.where("_hash IS NOT NULL")
    rest = near.where("_hash IS NULL").select(*rows.columns)
    rest = rest.join(copies, F.col("hash") == F.col("_hash"), "left")
    return _told(found, F.col("n"), F.col("first")).unionByName(_told(rest, F.col("n"), F.col("first")))


def _by_bytes(docs: DataFrame, clashes: DataFrame, width: int) -> DataFrame:
    """The result for rows whose hash stands for several texts."""
    every = F.array(*[F.lit(i) for i in range(SALTS)])
    salted = _hashed(docs, width).withColumn("row", F.monotonically_increasing_id())
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    asked = clashes.select(F.col("hash").alias("_hash"), F.explode(every).alias("_salt"))
    mine = written(
        salted.join(asked, (F.col("hash") == F.col("_hash")) & (F.col("salt") == F.col("_salt")), "left_semi"), "clashing"
    )
    groups = mine.groupBy(F.col("norm").alias("_norm")).agg(F.count(F.lit(1)).alias("n"), _first().alias("first"))
    groups = groups.withColumn("_salt", F.explode(every))
    same = (F.col("norm") == F.col("_norm")) & (F.col("salt") == F.col("_salt"))
    return _told(mine.join(groups, same), F.col("n"), F.col("first"))


def dedup(docs: DataFrame, width: int = 16) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs`` (doc_id, text).

    ``width`` is the number of bytes of the content hash.
    """
    rows = _hashed(docs, width).select("doc_id", "sha", "hash", F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "exact-rows")
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), _first().alias("first"))
    copies = written(groups.where("n > 1"), "exact-groups")
    clashes = written(_clashes(docs, copies, width), "exact-clashes")
    if clashes.isEmpty():
        return _by_hash(rows, copies)
    plain = _by_hash(rows.join(clashes, "hash", "left_anti"), copies.join(clashes, "hash", "left_anti"))
    return plain.unionByName(_by_bytes(docs, clashes, width))


def clean(docs: DataFrame, width: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = dedup(docs, width).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    pairs = found.groupBy("_id", "_sha").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_times"))
    pairs = pairs.where("NOT _stays OR _times > 1")
    sha = F.sha2(normal(docs["text"]).cast("binary"), 256)
    marked = docs.join(pairs, docs["doc_id"].eqNullSafe(pairs["_id"]) & (sha == pairs["_sha"]), "left")
    repeated = marked.where("_stays").dropDuplicates(["_id", "_sha"])
    return marked.where("_times IS NULL").select(*docs.columns).unionByName(repeated.select(*docs.columns))


def sql(documents: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM {documents}),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY norm)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)"""
