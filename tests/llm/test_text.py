"""Vectorised text helpers against plain Python."""

import random

import numpy as np
import pyarrow as pa

from chatmill.llm import text as tx


def samples():
    rng = random.Random(3)
    pieces = ["a", "bb", "é", "漢字", " ", "\t", "\n", "\x0b", " ", "word", "  "]
    return [None, "", " ", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(60))]


def test_words_are_those_of_split():
    texts = samples()
    data, offsets = tx.flat(pa.array(texts))
    words = tx.Words(data, offsets)
    raw = data.tobytes()
    got = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
    per_row = [got[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    assert per_row == [(t or "").encode().split() for t in texts]


def test_sliced_arrays():
    whole = pa.array(["xx", None, "yy zz", "w"])
    data, offsets = tx.flat(whole.slice(1, 2))
    assert data.tobytes() == b"yy zz" and offsets.tolist() == [0, 0, 5]


def test_equal_stretches_have_equal_hashes():
    values = np.array([3, 1, 4, 1, 5, 3, 1, 4, 2], dtype=np.uint64)
    rolling = tx.word_rolling(values)
    of = lambda a, b: int(rolling.of(np.array([a]), np.array([b]))[0])
    assert of(0, 3) == of(5, 8) and of(0, 4) != of(5, 9) and of(1, 2) == of(3, 4) and of(0, 0) != of(0, 1)


def test_sliding_min():
    rng = np.random.default_rng(1)
    for n in (1, 5, 17):
        x = rng.integers(0, 9, n).astype(np.uint64)
        for width in (1, 2, 5, 20):
            assert tx.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(n - width + 1)]


def test_every_window_has_one_span_and_equal_windows_agree():
    rng = random.Random(4)
    rows = [[rng.randint(0, 2) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    flat = np.array([x for r in rows for x in r], dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    length, found = 7, {}
    spans = tx.Anchors(tx.word_rolling(tx.mix(flat)), starts, length, 3)
    windows = [w for a, c in zip(spans.first.tolist(), spans.count.tolist()) for w in range(a, a + c)]
    assert windows == [w for a, b in zip(starts, starts[1:]) for w in range(a, b - length + 1)]
    for k in range(len(spans.first)):
        for w in range(spans.first[k], spans.first[k] + spans.count[k]):
            same = (int(spans.key[k]), int(spans.at[k] - w))
            assert found.setdefault(tuple(flat[w : w + length].tolist()), same) == same


def test_chunks_hold_all_rows(monkeypatch):
    monkeypatch.setattr(tx, "CHUNK_BYTES", 10)
    batch = pa.record_batch([pa.array(["a" * n if n != 2 else None for n in (0, 2, 4, 30, 1, 9, 1)])], ["text"])
    parts = list(tx.chunks(iter([batch])))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict() and len(parts) > 2
