"""Quality classifier: a sparse ensemble of rules over text statistics.

Each text gives a row of statistics (shares of kinds of characters, word
lengths, repetition).  On a bounded sample of labelled rows, small boosted
trees are grown; every path from a root becomes a rule, a conjunction of
comparisons.  A logistic model with an L1 penalty weighs the rules (proximal
gradient steps in numpy) and drops most.  What is left is compiled into one
Spark column expression over the statistics.

Defined cases: null, empty and blank texts have zero statistics and are scored
like any other; null labels are not learned from; rows that share an id are
scored one by one; with no labelled rows, or only one class, the score is that
class share (0.5 without any); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import ship
from chatmill.llm.text import LOWER, Words, chunks, flat, mix

STATISTICS = [
    "n_words", "word_length", "upper", "digit", "space", "exclaim", "bar", "symbol", "point", "non_ascii",
    "repeat_next", "distinct_words", "line_length", "distinct_lines", "longest_repeat", "top_word",
]


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


_KINDS = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _class("0123456789"), "space": _class(" \t\n\r\v\f"),
    "exclaim": _class("!?"), "bar": _class("|<>{}[]\\/_="), "symbol": _class("#$%&*@^~+"), "point": _class(".,;:"),
    "non_ascii": np.arange(256) >= 0x80,
}


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return upto[first[1:]] - upto[first[:-1]]


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each row has, and how often its most frequent one occurs."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    most = np.zeros(rows)
    if len(begin):
        np.maximum.at(most, r[begin], np.diff(np.append(begin, len(h))))
    return np.bincount(r[begin], minlength=rows), most


def statistics(texts: pa.Array) -> np.ndarray:
    """rows x STATISTICS."""
    data, offsets = flat(texts)
    rows, size = len(offsets) - 1, np.diff(offsets)
    per_byte = np.maximum(size, 1)
    words = Words(data, offsets)
    hashes = Words(LOWER[data], offsets).hashes()
    row, n = words.row(), words.count
    per_word = np.maximum(n, 1)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    run_start = np.flatnonzero(~same)
    longest = np.zeros(rows)
    if len(run_start):
        np.maximum.at(longest, row[run_start], np.diff(np.append(run_start, len(same))))
    newline = np.zeros(256, dtype=bool)
    newline[0x0A] = True
    lines = Words(data, offsets, newline)
    per_line = np.maximum(lines.count, 1)
    distinct_lines, _ = _distinct(mix(lines.hashes(), 9), lines.row(), rows)
    distinct_words, top = _distinct(hashes, row, rows)
    columns = {name: _by_row(kind[data], offsets) / per_byte for name, kind in _KINDS.items()}
    columns |= {
        "n_words": n, "word_length": _by_row(words.end - words.start, words.first) / per_word,
        "repeat_next": _by_row(same, words.first) / per_word, "distinct_words": distinct_words / per_word,
        "line_length": size / per_line, "distinct_lines": distinct_lines / per_line,
        "longest_repeat": longest, "top_word": top / per_word,
    }
    return np.stack([columns[name] for name in STATISTICS], axis=1).astype(np.float64)


#: A comparison (statistic, at most?, value); a rule is a tuple of them.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, target: np.ndarray, weight: np.ndarray,
          rows: np.ndarray, path: Rule, depth: int, least: int, out: list[Rule], fitted: np.ndarray) -> None:
    """Split greedily by squared error of the weighted target; record every path."""
    if path:
        out.append(path)
    mean = (target[rows] * weight[rows]).sum() / weight[rows].sum()
    fitted[rows] = mean
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, None, None)
    for f, edges in enumerate(bins):
        if not len(edges):
            continue
        w = np.bincount(binned[rows, f], weight[rows], len(edges) + 1)
        t = np.bincount(binned[rows, f], (weight * target)[rows], len(edges) + 1)
        c = np.bincount(binned[rows, f], minlength=len(edges) + 1)
        wl, tl, cl = (np.cumsum(v)[:-1] for v in (w, t, c))
        wr, tr, cr = w.sum() - wl, t.sum() - tl, c.sum() - cl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = tl * tl / wl + tr * tr / wr - t.sum() ** 2 / w.sum()
        gain[(cl < least) | (cr < least)] = 0
        k = int(np.nan_to_num(gain).argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] is None:
        return
    _, f, k = best
    cut = float(bins[f][k])
    low = binned[rows, f] <= k
    for side, at_most in ((rows[low], True), (rows[~low], False)):
        _grow(x, bins, binned, target, weight, side, (*path, (f, at_most, cut)), depth - 1, least, out, fitted)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 1) -> list[Rule]:
    """Distinct paths of boosted trees grown on halves of the rows."""
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges, x[:, f], "left") for f, edges in enumerate(bins)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    margin, rules = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        some = np.flatnonzero(rng.random(len(y)) < 0.5)
        if len(some) < 4:
            some = np.arange(len(y))
        fitted = np.zeros(len(y))
        _grow(x, bins, binned, y - p, weight, some, (), depth, max(3, len(some) // 200), rules, fitted)
        margin[some] += 1.0 * fitted[some] * 4
    return list(dict.fromkeys(rules))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, [(x[:, f] <= v) if at_most else (x[:, f] > v) for f, at_most, v in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an L1 penalty, by accelerated proximal gradients."""
    n, k = z.shape
    gram = z.T @ z
    rate = 4 * n / (np.linalg.eigvalsh(gram)[-1] + n if k else n)  # bounds the largest curvature
    w, b = np.zeros(k, dtype=z.dtype), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -40, 40)))
        g = ((p - y) / n).astype(z.dtype)
        nw = vw - rate * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, seed: int = 1) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the intercept."""
    if not len(y):
        return [], 0.0
    if y.min() == y.max():
        return [], float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    rules = grow_rules(x, y, seed=seed)
    by_rows = {np.packbits(applies(r, x)).tobytes(): r for r in reversed(rules)}  # rules that agree on every row are one
    rules = list(by_rows.values())[::-1]
    z = np.stack([applies(r, x) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
    w, b = lasso(z.astype(np.float32), y.astype(np.float32), penalty)
    return [(r, float(v)) for r, v in zip(rules, w) if v != 0], float(b)


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The ensemble as a column expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        tests = [F.col(STATISTICS[f]) <= v if at_most else F.col(STATISTICS[f]) > v for f, at_most, v in rule]
        total = total + F.when(reduce(and_, tests), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            x = statistics(chunk.column("text"))
            yield pa.record_batch([chunk.column("doc_id"), *(pa.array(v) for v in x.T)], ["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{name} double" for name in STATISTICS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``; ``labels`` (doc_id, label 0/1) are learned.

    At most ``max_rows`` labelled rows are used, in the order of a hash of the id.
    """
    ship(docs.sparkSession)
    drawn = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    drawn = drawn.select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # max_rows ids
    table = measured(rows.select("doc_id", "text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).toArrow()
    table = table.sort_by([(name, "ascending") for name in ["doc_id", *STATISTICS]])
    x = np.stack([table.column(name).to_numpy() for name in STATISTICS], axis=1)
    rules, intercept = fit(x, table.column("label").to_numpy().astype(np.int64))
    scored = measured(docs).select("doc_id", compiled(rules, intercept).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
