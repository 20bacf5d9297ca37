"""Substring dedup by repeated-phrase automata.

A window of ``width`` consecutive words whose sequence also starts anywhere
else, in this document or another, is a repeat; every word it covers is removed.

1. *Confirm* recurring passages: anchors (:mod:`chatmill.llm.recur`) leave the
   neighbourhoods of word grams that recur, equal ones counted once; where an
   anchor has different neighbourhoods, their windows are counted by digest.
   One representative of every recurring window is kept, and neighbouring ones
   are joined into passages, all of whose windows recur, of ``PIECE`` windows
   at most.
2. *Compile* the passages into Aho-Corasick automata.  The automata are sharded
   by blocks of documents (a few megabytes of text): a block's automaton holds
   the passages that represent a window of the block, by phrases of ``PHRASE``
   words at such distances that every window of a passage holds a whole phrase.
   A block is sent no passage that merely shares an anchor with it, so what is
   sent grows with the text, however many passages hold a common line.
3. *Stream* the block's documents through its automaton.  Each hit of a phrase
   is stretched to the left and right as far as document and passage agree;
   what reaches ``width`` words is an occurrence.

No group is gathered but a block, whose size is a parameter, with the passages
that occur in it; these go into automata of bounded size, one after the other.

Defined cases: a null text has no words; documents of fewer words than
``width`` keep all; rows with equal id and text get equal results, one each;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatmill.llm import recur
from chatmill.llm.store import files_for, written
from chatmill.llm.text import Rolling, Words, chunks, flat, mix, word_rolling

GRAM = 8
PHRASE = 6
PIECE = 256
PAIRS = 500_000
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20


def _window_digests(touched: DataFrame, mixed: DataFrame, width: int) -> DataFrame:
    """``digest, key, whole, doc, tag, first, n``: the windows of the different spans around mixed anchors."""
    wanted = mixed.groupBy(F.col("doc").alias("_doc"), recur.tag(F.col("spot")).alias("_tag")).agg(
        F.collect_list(F.struct("spot", "key", "whole", "n")).alias("wanted")
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    rows = touched.dropDuplicates(["doc", "tag"]).join(wanted, same).select("doc", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = Words(*flat(chunk.column("text")))
            rolling = word_rolling(words.hashes())
            wanted = chunk.column("wanted")
            ends = wanted.offsets.to_numpy()
            spot, key, whole, n = (wanted.values.field(x).to_numpy()[ends[0] : ends[-1]] for x in ("spot", "key", "whole", "n"))
            row = np.repeat(np.arange(len(chunk)), np.diff(ends))
            counts = (spot >> 18) & 0x3FFF
            own = np.repeat(np.arange(len(spot)), counts)
            first = (spot >> 32)[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = words.first[row[own]] + first
            columns = [rolling.of(start, start + width).view(np.int64), key[own], whole[own],
                       chunk.column("doc").to_numpy()[row[own]], (spot & 0xFFFF)[own], first, n[own]]
            yield pa.record_batch([pa.array(c) for c in columns], ["digest", "key", "whole", "doc", "tag", "first", "n"])

    return rows.mapInArrow(run, "digest long, key long, whole long, doc long, tag long, first long, n long")


def _recurring_windows(windows: DataFrame) -> DataFrame:
    """``key, whole, doc, tag, first, own``: where each recurring window of a span is represented, and if it is there itself."""
    equal = Window.partitionBy("digest", "key")
    counted = windows.withColumn("here", F.struct("doc", "tag", "first")).select(
        "key", "whole", "here", F.sum("n").over(equal).alias("times"), F.min("here").over(equal).alias("at")
    )
    return counted.where("times > 1").select("key", "whole", "at.doc", "at.tag", "at.first", (F.col("here") == F.col("at")).alias("own"))


def _passages(touched: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """``p_doc, p_tag, p_piece, passage``: runs of recurring windows (doc, tag, first, count), cut at every ``PIECE`` windows of a text."""
    lists = windows.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("first", "count")).alias("found")
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    rows = touched.dropDuplicates(["doc", "tag"]).join(lists, same).select("doc", "tag", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out: list[list] = [[], [], [], []]
            for doc, mark, text, found in zip(*(chunk.column(c) for c in ("doc", "tag", "text", "found"))):
                words = text.as_py().encode().split()
                pairs = found.values
                begin, end = _window_runs(pairs.field("first").to_numpy(), pairs.field("count").to_numpy())
                for a, b in zip(begin.tolist(), end.tolist()):
                    for piece in range(a // PIECE, (b - 1) // PIECE + 1):
                        out[0].append(doc.as_py())
                        out[1].append(mark.as_py())
                        out[2].append(piece)
                        out[3].append(b" ".join(words[max(a, piece * PIECE) : min(b, (piece + 1) * PIECE) + width - 1]))
            yield pa.record_batch(
                [*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                ["p_doc", "p_tag", "p_piece", "passage"],
            )

    return rows.mapInArrow(run, "p_doc long, p_tag long, p_piece long, passage binary")


def _window_runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of consecutive windows."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate((first + count)[order])
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > end[:-1]
    begin = np.flatnonzero(new)
    return first[begin], end[np.append(begin[1:] - 1, len(first) - 1)]


class _Slots:
    """Texts (words joined by spaces) one after the other; each takes a slot per word and one for its end."""

    def __init__(self, texts: list[bytes], salt: int):
        self.raw = b"\n".join(b" " + t + b" " if t else b" " for t in texts)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        words = Words(data, np.array([0, len(data)]))
        counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        self.begin = np.cumsum(counts + 1) - counts - 1
        self.size = int((counts + 1).sum())
        self.counts = counts
        self.values = mix(np.arange(self.size, dtype=np.uint64), salt)  # ends: equal to nothing else
        self.word_slots = np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)
        self.values[self.word_slots] = words.hashes()
        self.spaces = np.flatnonzero(data == 0x20)  # one before each word, one before each end


def _automaton(
    passages: list[bytes], phrase: int, step: int
) -> tuple[ahocorasick.Automaton, list[list[tuple[int, int]]], np.ndarray]:
    """Phrases of the passages; for each, the passages that hold it and where (in words), and its length."""
    machine, places, lengths = ahocorasick.Automaton(), [], []
    for number, passage in enumerate(passages):
        words = passage.split(b" ")
        for at in range(0, len(words) - phrase + 1, step):
            text = (b" " + b" ".join(words[at : at + phrase]) + b" ").decode("latin-1")
            known = machine.get(text, None)
            if known is None:
                known = len(places)
                machine.add_word(text, known)
                places.append([])
                lengths.append(len(text))
            places[known].append((number, at))
    machine.make_automaton()
    return machine, places, np.array(lengths, dtype=np.int64)


def _agree(rolling: Rolling, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many units agree from a and b on (or up to them, backwards), ``most`` at most."""
    low, high = np.zeros(len(a), dtype=np.int64), most.copy()
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        middle = (low[todo] + high[todo] + 1) // 2
        x, y = a[todo], b[todo]
        if back:
            same = rolling.of(x - middle, x) == rolling.of(y - middle, y)
        else:
            same = rolling.of(x, x + middle) == rolling.of(y, y + middle)
        low[todo[same]] = middle[same]
        high[todo[~same]] = middle[~same] - 1


def _shards(passages: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Passages in parts of about ``most`` bytes, one automaton each."""
    part: list[bytes] = []
    size = 0
    for passage in passages:
        if part and size + len(passage) > most:
            yield part
            part, size = [], 0
        part.append(passage)
        size += len(passage)
    if part:
        yield part


def locate(texts: list[bytes], passages: list[bytes], width: int, shard: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text (words joined by spaces): which words lie in an occurrence of ``width`` words of a passage.

    The texts are streamed through one automaton after the other, each of about
    ``shard`` bytes of passages.
    """
    here = _Slots(texts, 11)
    covered = np.zeros(here.size, dtype=bool)
    for part in _shards(passages, shard):
        covered |= _covered(here, part, width)
    return [covered[b : b + c] for b, c in zip(here.begin.tolist(), here.counts.tolist())]


def _covered(here: _Slots, passages: list[bytes], width: int) -> np.ndarray:
    """Slots of the texts that lie in an occurrence of ``width`` words of one of the passages."""
    phrase = min(PHRASE, (width + 1) // 2)
    machine, places, lengths = _automaton(passages, phrase, width - phrase + 1)
    there = _Slots(passages, 12)
    ends, which = [], []
    if len(places):
        for end, value in machine.iter(here.raw.decode("latin-1")):
            ends.append(end)
            which.append(value)
    which_at, ends_at = np.array(which, dtype=np.int64), np.array(ends, dtype=np.int64)
    slot = np.searchsorted(here.spaces, ends_at - lengths[which_at] + 1) if len(ends) else ends_at
    many = np.array([len(p) for p in places], dtype=np.int64)
    first = np.cumsum(many) - many
    pairs = np.array([x for p in places for x in p], dtype=np.int64).reshape(-1, 2)
    values = np.concatenate([here.values, there.values])
    rolling = word_rolling(values)
    starts, counts = [], []
    upto = np.concatenate([[0], np.cumsum(many[which_at])]) if len(slot) else np.zeros(1, dtype=np.int64)
    lo = 0
    while lo < len(slot):  # about PAIRS pairs of a hit and a passage at a time
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        some, w = slot[lo:hi], which_at[lo:hi]
        lo = hi
        a = np.repeat(some, many[w])
        pick = np.repeat(first[w] - (np.cumsum(many[w]) - many[w]), many[w]) + np.arange(len(a))
        passage, at = pairs[pick].T
        b = here.size + there.begin[passage] + at
        text = np.searchsorted(here.begin, a, "right") - 1
        right = _agree(rolling, a, b, np.minimum(there.counts[passage] - at, here.begin[text] + here.counts[text] - a), False)
        left = _agree(rolling, a, b, np.minimum(at, a - here.begin[text]), True)
        long = left + right >= width
        starts.append((a - left)[long])
        counts.append((left + right)[long])
    covered = np.zeros(here.size + 1, dtype=np.int32)
    if starts:
        np.add.at(covered, np.concatenate(starts), 1)
        np.add.at(covered, np.concatenate(starts) + np.concatenate(counts), -1)
    return np.cumsum(covered)[: here.size] > 0


def _stream(touched: DataFrame, routed: DataFrame, width: int) -> DataFrame:
    """``doc, tag, removed, sha, kept`` of the documents of each block with passages."""

    def run(docs: pa.Table, routed_here: pa.Table) -> pa.Table:
        passages = sorted(set(routed_here.column("passage").to_pylist()))
        texts = [b" ".join((t or "").encode().split()) for t in docs.column("text").to_pylist()]
        removed, kept = [], []
        if len(docs) and passages:
            for text, gone in zip(texts, locate(texts, passages, width)):
                n = int(gone.sum())
                removed.append(n)
                if n:
                    words = text.split(b" ")
                    text = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                kept.append(text)
        else:
            docs = docs.slice(0, 0)
        return pa.table(
            [docs.column("doc"), docs.column("tag"), pa.array(removed, pa.int64()),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
            ["doc", "tag", "removed", "sha", "kept"],
        )

    one_each = touched.dropDuplicates(["doc", "tag"]).select("block", "doc", "tag", "text")
    return (
        one_each.groupBy("block").cogroup(routed.groupBy("block"))
        .applyInArrow(run, "doc long, tag long, removed long, sha string, kept binary")
    )


def _plain(keyed: DataFrame) -> DataFrame:
    """``doc, tag, doc_id, n_words, whole_sha`` of every row, as if nothing were removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = [(t or "").encode().split() for t in chunk.column("text").to_pylist()]
            yield pa.record_batch(
                [*(chunk.column(c) for c in ("doc", "tag", "doc_id")), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
                ["doc", "tag", "doc_id", "n_words", "whole_sha"],
            )

    rows = keyed.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc long, tag long, doc_id long, n_words long, whole_sha string")


def found(keyed: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """``doc, tag, removed, sha, kept`` of documents that may hold repeats."""
    files = files_for(keyed.count())
    recurring = recur.repeated(recur.spans(keyed, "word", width, min(GRAM, width)), files)
    touched = recur.touched(keyed, recurring, files)
    different = written(recur.distinct_spans(recurring), "distinct-spans", files)
    spot = F.col("spot")
    plain = different.where("NOT mixed").select(
        "key", "whole", "doc", recur.tag(spot).alias("tag"), recur.first(spot).alias("first"), recur.count(spot).alias("count")
    )
    compared = written(_recurring_windows(_window_digests(touched, different.where("mixed"), width)), "windows", files)
    place = ("doc", "tag", "first")
    windows = plain.select(*place, "count").unionByName(compared.where("own").select(*place, F.lit(1).cast("long").alias("count")))
    passages = written(_passages(touched, windows, width), "passages", files)

    size = touched.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = lambda doc, mark: F.pmod(F.xxhash64(doc, mark), F.lit(blocks)).alias("block")
    route = recurring.select(F.col("key").alias("_key"), F.col("whole").alias("_whole"), block(F.col("doc"), recur.tag(spot))).distinct()
    span = ("key", "whole", F.col("doc").alias("_doc"), F.col("tag").alias("_tag"))
    pieces = F.expr(f"explode(sequence(first DIV {PIECE}, (first + count - 1) DIV {PIECE}))").alias("_piece")
    holds = plain.select(*span, pieces).unionByName(compared.select(*span, F.expr(f"first DIV {PIECE}").alias("_piece")).distinct())
    wanted = (
        holds.join(route, (F.col("key") == F.col("_key")) & (F.col("whole") == F.col("_whole")))
        .select("block", "_doc", "_tag", "_piece").distinct()
    )
    here = (F.col("p_doc") == F.col("_doc")) & (F.col("p_tag") == F.col("_tag")) & (F.col("p_piece") == F.col("_piece"))
    routed = passages.join(wanted, here)
    return _stream(touched.withColumn("block", block(F.col("doc"), F.col("tag"))), routed.select("block", "passage"), width)


def dedup(docs: DataFrame, width: int = 35, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs`` (doc_id, text)."""
    keyed = recur.keyed(docs)
    cut = found(keyed, width, block_bytes).drop("kept").withColumnsRenamed({"doc": "_doc", "tag": "_tag"})
    same = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    return _plain(keyed).join(cut, same, "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "whole_sha").alias("kept_sha256"),
    )


def clean(docs: DataFrame, width: int = 35, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with repeats removed from ``text`` (remaining words joined by one space).

    Texts without repeats stay as they are, byte for byte; all rows and columns are kept.
    """
    cut = found(recur.keyed(docs), width, block_bytes).where("removed > 0")
    cut = cut.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.decode("kept", "UTF-8").alias("_kept"))
    doc, mark = recur.row_key(docs["doc_id"], docs["text"])
    same = (doc == cut["_doc"]) & (mark == cut["_tag"])
    joined = docs.join(cut, same, "left")
    return joined.select(
        *[F.coalesce(cut["_kept"], docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns]
    )


def sql(documents: str = "documents") -> str:
    """The same in DuckDB's SQL (windows of 35 words)."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM {documents}),
w AS (SELECT doc_id, s, array_to_string(list_slice(words, s, s + 34), ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM d WHERE len(words) >= 35)),
r AS (SELECT md5(win) AS win FROM w GROUP BY md5(win) HAVING count(*) > 1),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM w WHERE md5(win) IN (SELECT win FROM r)) GROUP BY doc_id),
x AS (SELECT doc_id, p, words[p] AS word, list_contains(coalesce(gone, []), p) AS cut
      FROM (SELECT d.doc_id, words, gone, unnest(range(1, len(words) + 1)) AS p FROM d LEFT JOIN g USING (doc_id))),
k AS (SELECT doc_id, count(*) FILTER (cut) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT cut) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
