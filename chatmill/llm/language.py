"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the n-grams of 1 to 3 characters of the lower-cased text, hashed
into ``BUCKETS``; digits and white space count as one space each, and two
spaces stand before the first character.  Tasks count them over a bounded
sample of the labelled rows (``per_language`` rows of each language, chosen by a
hash of the id); the matrix of log probabilities is broadcast, and rows are
scored in numpy by summing the matrix rows of their n-grams, over whole texts.

The score is the posterior of the chosen language (equal priors).

Defined cases: ``und`` with score 0.0 for a null text, a text without any
letter, or when nothing could be learned; null languages are not learned; rows
that share an id are scored one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.llm.store import ship, written
from chatmill.llm.text import chunks, mix

BUCKETS = 1 << 15
UNKNOWN = "und"
LEVEL = 10  # bits of a histogram
_BLANK = np.zeros(0x110000, dtype=bool)
_BLANK[[c for c in range(0x3100) if chr(c).isspace() or chr(c).isdigit()]] = True


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of each order (one per character), and the row offsets."""
    padded = ["  " + t.lower() for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in padded])
    codes = np.where(_BLANK[codes], np.uint32(32), codes).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)
    keep[starts] = keep[starts + 1] = False
    one = codes
    two = codes.copy()
    two[1:] |= codes[:-1] << np.uint64(21)
    three = two.copy()
    three[2:] |= codes[:-2] << np.uint64(42)
    last = np.flatnonzero(keep)  # an n-gram belongs to the row of its last character
    low = np.uint64(BUCKETS - 1)
    ids = [(mix(x[last], 50 + n) & low).astype(np.int32) for n, x in enumerate((one, two, three))]
    offsets = np.concatenate([[0], ends - 2 * np.arange(1, len(ends) + 1)]).astype(np.int64)
    return ids, offsets


@dataclass
class Model:
    names: list[str]
    log_probability: np.ndarray  # orders x buckets x languages

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sure = [t is not None and any(map(str.isalpha, t)) for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names or not any(sure):
            return names, scores
        rows = [k for k, s in enumerate(sure) if s]
        ids, offsets = ngrams([texts[k] for k in rows])
        total = np.zeros((len(rows), len(self.names)))
        for own, matrix in zip(ids, self.log_probability):
            total += np.add.reduceat(matrix[own], offsets[:-1], axis=0)
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, b, p in zip(rows, best.tolist(), posterior.tolist()):
            names[k], scores[k] = self.names[b], p
        return names, scores


def counts(rows: DataFrame) -> DataFrame:
    """``lang, feature, n``: n-grams of the rows (lang, text), added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for chunk in chunks(batches):
            langs = chunk.column("lang").to_pylist()
            ids, offsets = ngrams([t or "" for t in chunk.column("text").to_pylist()])
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))
                into = sums.setdefault(lang, np.zeros(3 * BUCKETS, dtype=np.int64))
                for order, own in enumerate(ids):
                    into[order * BUCKETS : (order + 1) * BUCKETS] += np.bincount(own[mine], minlength=BUCKETS)
        for lang, into in sums.items():
            feature = np.flatnonzero(into)
            yield pa.record_batch(
                [pa.array([lang] * len(feature), pa.string()), pa.array(feature), pa.array(into[feature])],
                ["lang", "feature", "n"],
            )

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, feature long, n long")
    return counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def below(hashed: DataFrame, least: int) -> DataFrame:
    """``lang, upto``: the leading bits of the hash up to which each language has ``least`` rows, or all of them.

    Two histograms of 1,024 cells a language, the second of one cell of the first:
    no task ranks the rows of a language, however many they are.
    """
    def cell(rows: DataFrame, bits: int, want: Column) -> DataFrame:
        sums = rows.groupBy("lang", F.shiftright("hash", 64 - bits).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max(want).alias("want"))
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy("part"))
        reached = sums.withColumn("upto", upto)
        last = F.coalesce(F.min(F.when(F.col("upto") >= F.col("want"), F.col("part"))), F.max("part"))
        before = F.coalesce(F.max(F.when(F.col("upto") < F.col("want"), F.col("upto"))), F.lit(0))
        return reached.groupBy("lang").agg(last.alias("part"), before.alias("before"))

    # Rows of a few languages, written so that the planner sends them to the rows.
    coarse = written(cell(hashed, LEVEL, F.lit(least)).withColumnRenamed("lang", "_coarse"), "language-cells", 1)
    inside = hashed.join(coarse, (F.col("lang") == F.col("_coarse")) & (F.shiftright("hash", 64 - LEVEL) == F.col("part")))
    fine = cell(inside.select("lang", "hash", "before"), 2 * LEVEL, F.lit(least) - F.col("before"))
    return written(fine.select("lang", F.col("part").alias("upto")), "language-cuts", 1)


def train(learn: DataFrame, per_language: int = 1000, smoothing: float = 0.5) -> Model:
    """Learn from the rows of ``learn`` (doc_id, text, lang) with a language."""
    named = learn.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    hashed = named.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    cut = below(hashed, per_language).withColumnRenamed("lang", "_cut")
    few = hashed.join(cut, (F.col("lang") == F.col("_cut")) & (F.shiftright("hash", 64 - 2 * LEVEL) <= F.col("upto")))
    ranked = Window.partitionBy("lang").orderBy("hash", "doc_id")
    some = few.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= per_language)
    some = some.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    rows = named.join(some, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    table = counts(rows).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    code = {name: k for k, name in enumerate(names)}
    seen = np.zeros((3 * BUCKETS, len(names)))
    seen[table.column("feature").to_numpy(), [code[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    seen = seen.reshape(3, BUCKETS, len(names)) + smoothing
    return Model(names, np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, learn: DataFrame, per_language: int = 1000) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``, from its text alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(learn, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            names, scores = shared.value.score(chunk.column("text").to_pylist())
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
