"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of hashed embeddings of the lower-cased word and of
its first 3 to 8 bytes (so that unseen endings of a known stem are
recognised).  Filters of several widths slide over the words of the whole
text, each keeps its maximum, and a logistic layer turns these into a score.
Embeddings start from the smoothed log odds of their feature and are trained
with the filters by Adam in numpy.

Fitting uses a bounded sample of labelled rows (``max_rows`` of either class,
texts up to ``max_bytes``), four fifths of it; scoring reads every row and every
word.  The threshold of a language (guessed from the words themselves) is the one
with the best F1 over *all* labelled rows that were not fitted, long ones
included, at the real share of both classes: histograms of their logits are
counted in Spark.  Scores are shifted so that every threshold lies at
``threshold``.

Defined cases: a null, empty or blank text scores as a text without words;
null labels are not learned from; rows that share a ``doc_id`` are scored one
by one; with no labelled rows, or only one class, every score is that class
share (0.0 without any); an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import ship, written
from chatmill.llm.text import LOWER, Words, chunks, flat, mix

BUCKETS = 1 << 15  # ids fit 16 bits
STEMS = (3, 4, 5, 6, 7, 8)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
LANG_FEATURE = 2  # the four-byte beginning


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids (words x kinds) of a chunk, and the first word of each row."""
    data, offsets = flat(texts)
    words = Words(LOWER[data], offsets)
    rolling = words.byte_hashes()
    ends = [words.end] + [np.minimum(words.start + n, words.end) for n in STEMS]
    ids = [mix(rolling.of(words.start, end), 20 + i) % np.uint64(BUCKETS) for i, end in enumerate(ends)]
    return np.stack([i.astype(np.uint16) for i in ids], axis=1), words.first


@dataclass
class Model:
    embedding: np.ndarray  # buckets + 1 (a zero row that pads) x DIM
    filters: np.ndarray  # sum of widths x DIM x FILTERS
    filter_bias: np.ndarray  # widths x FILTERS
    output: np.ndarray  # widths * FILTERS
    bias: float
    languages: np.ndarray  # buckets x languages: log probabilities
    shifts: np.ndarray  # by language

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximum of every filter over each row, where it is, and the padded word vectors."""
        pad = max(WIDTHS) - 1
        rows, counts = len(first) - 1, np.diff(first)
        begin = first[:-1] + pad * np.arange(rows)
        total = len(ids) + pad * rows
        vectors = np.zeros((total, DIM), dtype=np.float32)
        place = np.arange(len(ids)) + np.repeat(pad * np.arange(rows), counts)
        if len(ids):
            sums = self.embedding[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                sums += self.embedding[ids[:, k]]
            vectors[place] = sums
        valid = np.zeros(total, dtype=bool)
        valid[place] = True
        valid[begin] = True  # an empty row shows its padding
        best = np.empty((rows, len(WIDTHS) * FILTERS), dtype=np.float32)
        where = np.empty(best.shape, dtype=np.int64)
        layer = 0
        for i, width in enumerate(WIDTHS):
            out = vectors @ self.filters[layer]
            for k in range(1, width):
                out[:-k] += vectors[k:] @ self.filters[layer + k]
            out[~valid] = -np.inf
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            best[:, cols] = np.maximum.reduceat(out, begin, axis=0) + self.filter_bias[i]
            if self._positions:
                for r in range(rows):
                    end = begin[r + 1] if r + 1 < rows else total
                    where[r, cols] = begin[r] + out[begin[r] : end].argmax(axis=0)
            layer += width
        return best, where, vectors

    _positions = False

    def language(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(first), self.languages.shape[1]))
        if len(ids):
            each = np.cumsum(self.languages[ids[:, LANG_FEATURE]], axis=0, dtype=np.float64)
            sums = np.vstack([np.zeros((1, each.shape[1])), each])[first]
        return np.diff(sums, axis=0).argmax(axis=1)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        best, _, _ = self.pooled(ids, first)
        return np.maximum(best, 0) @ self.output + self.bias

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        raw = self.logits(ids, first).astype(np.float64) + self.shifts[self.language(ids, first)]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.n = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.n += 1
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.99 * self.v[at] + 0.01 * grad * grad
        scale = np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        self.value[at] -= self.rate * scale * self.m[at] / (np.sqrt(self.v[at]) + 1e-6)


def _log_odds(ids: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a feature being in a toxic row, by bucket and feature kind summed."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    result = np.zeros(BUCKETS + 1)
    counts = np.zeros((2, BUCKETS))
    for k in range(ids.shape[1]):
        pairs = np.unique(rows.astype(np.int64) * BUCKETS + ids[:, k])
        for label in (0, 1):
            counts[label] += np.bincount(pairs[toxic[pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
    n = [max(1, int((toxic == label).sum())) for label in (0, 1)]
    smooth = 2.0
    result[:-1] = np.log((counts[1] + smooth) / (n[1] + 2 * smooth)) - np.log(
        (counts[0] + smooth * n[0] / n[1]) / (n[0] + 2 * smooth * n[0] / n[1])
    )
    return result


def _slice(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows."""
    counts = np.diff(first)[rows]
    new = np.concatenate([[0], np.cumsum(counts)])
    take = np.repeat(first[:-1][rows] - new[:-1], counts) + np.arange(new[-1])
    return ids[take], new


def _fit(ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, epochs: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(_log_odds(ids, first, toxic), -4, 6) / 4
    embedding[-1] = 0
    filters = rng.normal(0, 0.1, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32)
    layer = 0
    for width in WIDTHS:
        filters[layer, 0, :2] = 1.0
        layer += width
    model = Model(
        embedding, filters, np.zeros((len(WIDTHS), FILTERS), dtype=np.float32),
        rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
        np.zeros((BUCKETS + 1, 1), dtype=np.float32), np.zeros(1),
    )
    model._positions = True
    model.output[::FILTERS] = 0.5
    bias = np.zeros(1, dtype=np.float32)
    steps = {
        "e": _Adam(model.embedding, 0.003), "f": _Adam(model.filters, 0.01),
        "fb": _Adam(model.filter_bias, 0.01), "o": _Adam(model.output, 0.02), "b": _Adam(bias, 0.02),
    }
    share = toxic.mean()
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    rows = len(toxic)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for lo in range(0, rows, 32):
            some = order[lo : lo + 32]
            part, begin = _slice(ids, first, some)
            best, where, vectors = model.pooled(part, begin)
            hidden = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.output + bias[0], -30, 30)))
            out = ((p - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            back = np.outer(out, model.output) * (best > 0)
            grad_filters = np.zeros_like(model.filters)
            to_vector = np.zeros_like(vectors)
            layer = 0
            for i, width in enumerate(WIDTHS):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                grad, at = back[:, cols], where[:, cols]
                for k in range(width):
                    spot = np.minimum(at + k, len(vectors) - 1)
                    grad_filters[layer + k] = np.einsum("rfd,rf->df", vectors[spot], grad)
                    np.add.at(to_vector, spot.ravel(), (grad[..., None] * model.filters[layer + k].T).reshape(-1, DIM))
                layer += width
            begin_padded = np.repeat((max(WIDTHS) - 1) * np.arange(len(some)), np.diff(begin))
            moved = to_vector[np.arange(len(part)) + begin_padded]
            hit = np.flatnonzero(np.abs(moved).sum(axis=1) > 0)
            if len(hit):
                flat_ids = part[hit].ravel()
                touched, inverse = np.unique(flat_ids, return_inverse=True)
                grad_e = np.zeros((len(touched), DIM), dtype=np.float32)
                np.add.at(grad_e, inverse, np.repeat(moved[hit], part.shape[1], axis=0))
                steps["e"].step(grad_e, touched)
            steps["o"].step(hidden.T @ out + 1e-4 * model.output)
            steps["b"].step(np.array([out.sum()], dtype=np.float32))
            steps["f"].step(grad_filters + 1e-5 * model.filters)
            steps["fb"].step(back.sum(axis=0).reshape(len(WIDTHS), FILTERS))
    model.bias = float(bias[0])
    model._positions = False
    return model


STEP = 32  # bins of a histogram to one unit of the logit


def _threshold(high: np.ndarray, low: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Middle of the gap at which the F1 of ``logits > t`` is greatest, from bins in falling order:
    their greatest and least logit, toxic and clean weight."""
    hits = np.cumsum(toxic)
    f1 = 2 * hits / (np.cumsum(toxic + clean) + toxic.sum())
    k = int(f1.argmax())
    below = high[k + 1] if k + 1 < len(high) else low[k] - 1
    return float((low[k] + below) / 2)


def train(
    texts: pa.Array, toxic: np.ndarray, langs: list[str | None], *, epochs: int = 6, seed: int = 1
) -> tuple[Model | float, np.ndarray]:
    """Fit on four fifths of the rows, and which these are; a constant if there is one class only."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return (float(toxic.mean()) if len(toxic) else 0.0), np.arange(len(toxic))
    parts, counts = [], []
    for chunk in chunks(iter([pa.record_batch([texts], ["text"])])):
        ids, first = features(chunk.column(0))
        parts.append(ids)
        counts.append(np.diff(first))
    ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    parts.clear()
    rng = np.random.default_rng(seed)
    held = np.zeros(len(toxic), dtype=bool)
    for label in (0, 1):  # a fifth of either class
        of = rng.permutation(np.flatnonzero(toxic == label))
        held[of[: len(of) // 5]] = True
    fit = np.flatnonzero(~held)
    model = _fit(*_slice(ids, first, fit), toxic[fit], epochs, seed)
    names = sorted({x for x in langs if x is not None}) or [""]
    code = np.array([names.index(x) if x is not None else -1 for x in langs])
    rows = np.repeat(np.arange(len(toxic)), np.diff(first))
    model.languages = np.zeros((BUCKETS + 1, len(names)), dtype=np.float32)
    for k in range(len(names)):
        seen = np.bincount(ids[code[rows] == k, LANG_FEATURE], minlength=BUCKETS + 1) + 0.5
        model.languages[:, k] = np.log(seen / seen.sum())
    return model, fit


def histogram(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """``guess, label, bin, fitted, n, high, low``: labelled rows of ``logits`` (doc_id, logit, guess, fitted) by language and bin."""
    # A repeated label counts once; short rows, combined map-side.
    known = labels.where("label IS NOT NULL").select(F.col("doc_id").alias("_id"), "label").distinct()
    rows = logits.join(known, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("guess", "label", F.floor(F.col("logit") * STEP).alias("bin"), "fitted").agg(
        F.count("*").alias("n"), F.max("logit").alias("high"), F.min("logit").alias("low")
    )


def shifts(bins: pa.Table, languages: int, threshold: float, min_positive: int = 20) -> np.ndarray:
    """What is added to the logits of each language so that its best threshold lies at ``threshold``.

    Rows that were not fitted count; those of a class are weighted to the class's
    share among all rows.  Languages with fewer than ``min_positive`` toxic rows
    (or a class of which everything was fitted) use the threshold of all rows.
    """
    target = np.log(threshold / (1 - threshold))
    guess, label, number, fitted, n, high, low = (bins.column(c).to_numpy() for c in bins.column_names)
    fitted = fitted.astype(bool)
    seen = [n[label == c].sum() for c in (0, 1)]
    left = [n[(label == c) & ~fitted].sum() for c in (0, 1)]
    if not min(left):  # nothing left of a class: what was fitted has to do
        fitted, left = np.zeros(len(n), dtype=bool), seen
    if not min(left):
        return np.zeros(languages)
    weight = np.where(label == 1, seen[1] / left[1], seen[0] / left[0]) * n

    def best(rows: np.ndarray) -> float:
        place, own = np.unique(-number[rows], return_inverse=True)  # falling order
        top, bottom = np.full(len(place), -np.inf), np.full(len(place), np.inf)
        np.maximum.at(top, own, high[rows])
        np.minimum.at(bottom, own, low[rows])
        classes = [np.bincount(own, weight[rows] * (label[rows] == c), minlength=len(place)) for c in (0, 1)]
        return _threshold(top, bottom, classes[1], classes[0])

    result = np.full(languages, target - best(np.flatnonzero(~fitted)))
    for k in range(languages):
        rows = np.flatnonzero(~fitted & (guess == k))
        if n[rows][label[rows] == 1].sum() >= min_positive:
            result[k] = target - best(rows)
    return result


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """At most ``max_rows`` labelled rows of either class, in the order of a hash of the id."""
    drawn = None
    for value in (1, 0):
        some = labels.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        drawn = some if drawn is None else drawn.unionByName(some)
    drawn = drawn.select(F.col("doc_id").alias("_id"), "label").distinct()
    text = F.min(F.struct("text", "lang")).alias("row")  # of rows that share an id, one
    return (
        docs.select("doc_id", "text", "lang")
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
        .join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # at most 2 * max_rows ids
        .groupBy("doc_id", "label").agg(text).select("doc_id", "row.text", "row.lang", "label")
    )


def calibrated(
    docs: DataFrame, labels: DataFrame, threshold: float, max_rows: int, max_bytes: int, epochs: int
) -> tuple[Model | float, DataFrame | None]:
    """The model learned from the labelled rows among ``docs``, and ``doc_id, logit, guess, fitted`` of all rows."""
    ship(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL")
    rows = sample(docs, labels, max_rows, max_bytes).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    model, fit = train(
        rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(np.int64),
        rows.column("lang").to_pylist(), epochs=epochs,
    )
    if isinstance(model, float):
        return model, None
    shared = docs.sparkSession.sparkContext.broadcast((model, rows.column("doc_id").take(pa.array(fit)).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fit = shared.value
        for chunk in chunks(batches):
            ids, first = features(chunk.column("text"))
            logits = pa.array(model.logits(ids, first).astype(np.float64))
            guess = pa.array(model.language(ids, first).astype(np.int64))
            fitted = pc.is_in(chunk.column("doc_id"), fit)
            yield pa.record_batch([chunk.column("doc_id"), logits, guess, fitted], ["doc_id", "logit", "guess", "fitted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    logits = written(narrow.mapInArrow(run, "doc_id long, logit double, guess long, fitted boolean"), "logits")
    bins = histogram(logits, labels).toArrow()  # languages x bins of the logit x 4
    model.shifts = shifts(bins, model.languages.shape[1], threshold)
    return model, logits


def scores(model: Model | float, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.scores(*features(texts))


def score(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_rows: int = 2000,
    max_bytes: int = 65_536, epochs: int = 6,
) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs`` (doc_id, text, lang).

    ``labels`` (doc_id, label 0/1) names the rows to learn from.
    """
    model, logits = calibrated(docs, labels, threshold, max_rows, max_bytes, epochs)
    if logits is None:
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model).alias("score"))
    else:
        shift = F.element_at(F.array(*map(F.lit, model.shifts.tolist())), (F.col("guess") + 1).cast("int"))
        raw = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("logit") + shift))
        scored = logits.select("doc_id", (1 / (1 + F.exp(-raw))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_rows: int = 2000,
    max_bytes: int = 65_536, epochs: int = 6,
) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; columns unchanged.

    Scores twice, once for the thresholds: texts need not be shuffled to meet their scores.
    """
    model, _ = calibrated(docs, labels, threshold, max_rows, max_bytes, epochs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield chunk.filter(pa.array(scores(shared.value, chunk.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
