"""Substring dedup by sliding sentence spans.

From every sentence a run of consecutive sentences starts: it ends as soon as it
has two sentences and ``words`` words, or one sentence alone has ``alone`` words.
Where it ends depends on its own words only, so a passage gives the same runs in
every document.  With ``tails`` the shortest such run that ends with each sentence
is taken too: without it, sentences at a passage's end that are too short for a run
of their own would stay.  Runs are hashed and joined globally; each occurrence of a hash
but the first (least doc_id, then place) is a repeated span, and the sentences it
covers go, with the white space behind them."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, record, row_key, rows_of, slices, stored, with_lists

WORDS, ALONE = 25, 50
_GAP = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; the gap behind it belongs to it.  A sentence
    ends after . ! or ? before white space, and at a line's end."""
    ends = [m.end() for m in _GAP.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def _shortest(n: list[int], words: int, alone: int) -> list[tuple[int, int]]:
    """First sentence and end of the run from each sentence that starts one, by the
    sentences' numbers of words."""
    out, total, end, count = [], 0, 0, len(n)
    for i in range(count):
        if n[i] >= alone:
            k = i + 1
        else:
            while end < count and (total < words or end - i < 2) and (n[end] < alone or end <= i):
                total += n[end]
                end += 1
            if end < count and n[end] >= alone and (total < words or end - i < 2):
                k = end + 1  # the long sentence behind closes the run
            elif total >= words and end - i >= 2:
                k = end
            else:
                k = 0
        if k:
            out.append((i, k))
        if end > i:
            total -= n[i]
        else:
            end = i + 1
    return out


def runs(text: str, words: int = WORDS, alone: int = ALONE, tails: bool = False) -> tuple[list[int], list[int], np.ndarray]:
    """First sentence, number of sentences, and 128-bit hash (two numbers) of the
    run from each sentence that starts one, and with ``tails`` of the run up to each
    that ends one, each run once.  Sentences are compared by their words."""
    h, n = array("Q"), []
    for a, b in sentences(text):
        w = text[a:b].split()
        n.append(len(w))
        h.append(xxhash.xxh3_64_intdigest(" ".join(w)))
    found = _shortest(n, words, alone)
    if tails:
        # A run that is the shortest to its end and the shortest from its start is there already.
        ends = {k for _, k in found}
        found += [(len(n) - k, len(n) - i) for i, k in _shortest(n[::-1], words, alone) if len(n) - i not in ends]
    data = memoryview(h).cast("B")
    out = b"".join([xxhash.xxh3_128_digest(data[8 * i : 8 * k]) for i, k in found])
    return [i for i, _ in found], [k - i for i, k in found], np.frombuffer(out, "<i8").reshape(-1, 2)


def occurrences(docs: DataFrame, words: int, alone: int, tails: bool) -> DataFrame:
    """hi, lo, doc_id, row (a hash of the text), at, size of each run."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                ids, rows, at, size, keys = [], [], [], [], []
                for d, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), rows_of(b.column("text"))):
                    if t:
                        a, s, k = runs(t, words, alone, tails)
                        ids.append(np.full(len(a), d))
                        rows.append(np.full(len(a), r))
                        at += a
                        size += s
                        keys.append(k)
                if at:
                    k = np.concatenate(keys)
                    yield record(schema, {"hi": np.ascontiguousarray(k[:, 0]), "lo": np.ascontiguousarray(k[:, 1]), "doc_id": np.concatenate(ids), "row": np.concatenate(rows), "at": at, "size": size})

    return docs.select(*row_key("doc_id", "row"), "text").mapInArrow(run, "hi long, lo long, doc_id long, row long, at int, size int")


def repeated(docs: DataFrame, words: int = WORDS, alone: int = ALONE, tails: bool = False) -> DataFrame:
    """``_id``, ``_row`` and ``_spans``: the repeated spans of each document that has
    any."""
    found = stored(occurrences(docs, words, alone, tails), "span-runs")
    many = found.groupBy("hi", "lo").count().where("count > 1").select("hi", "lo")
    # One row a hash on the right; a hash that many runs have is split by AQE.  Few runs are repeated, so what follows is small.
    again = stored(found.join(many, ["hi", "lo"]), "span-repeats")
    place = F.struct("doc_id", "row", "at")
    first = again.groupBy("hi", "lo").agg(F.min(place).alias("first"))
    again = again.join(first, ["hi", "lo"]).where(place != F.col("first"))
    # No list is longer than the runs of one text.
    return again.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("at", "size")).alias("_spans"))


def without_spans(text: str | None, spans: list[dict] | None) -> tuple[str, list[tuple[int, int]], int]:
    """What stays of a text, the stretches of characters that went, and the number
    of sentences."""
    text = text or ""
    cut = sentences(text)
    if not spans:
        return text, [], len(cut)
    gone = np.zeros(len(cut) + 1, np.int64)
    for s in spans:
        gone[s["at"]] += 1
        gone[s["at"] + s["size"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    stretches: list[tuple[int, int]] = []
    for i in np.flatnonzero(gone).tolist():
        if stretches and stretches[-1][1] == cut[i][0]:
            stretches[-1] = (stretches[-1][0], cut[i][1])
        else:
            stretches.append(cut[i])
    return "".join(text[a:b] for (a, b), g in zip(cut, gone) if not g), stretches, len(cut)


def dedup_spans(docs: DataFrame, words: int = WORDS, alone: int = ALONE, tails: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated spans.  ``tails``: all sentences of a
    repeated passage that has a run, not only those from which a run starts in it.

    A null id comes before any other.  Of one id, texts come by a hash of them, and
    rows of the same text are one document, which lose the same spans.  Null text
    becomes empty.  A column n_chars, if there, is brought up to date; others pass."""
    cols = docs.columns
    df, at = with_lists(docs, repeated(docs, words, alone, tails)), cols.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, "text"):
                got = [without_spans(t, s)[0] if s else t or "" for t, s in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist())]
                arrays = list(b.columns[: len(cols)])
                arrays[at] = pa.array(got, pa.string())
                if "n_chars" in cols:
                    arrays[cols.index("n_chars")] = pa.array(map(len, got), pa.int64()).cast(b.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return df.mapInArrow(run, docs.schema)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed (characters), removed (start and end of each
    stretch that went) and the text that stays, of each document."""
    docs = documents(spark, sf_dir)
    df = with_lists(docs, repeated(docs, tails=True))
    stretch = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", stretch), ("text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, "text"):
                got = [without_spans(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist())]
                yield record(schema, {
                    "doc_id": b.column("doc_id"),
                    "n_sentences": [x[2] for x in got],
                    "n_removed": [sum(e - a for a, e in x[1]) for x in got],
                    "removed": [[{"start": a, "end": e} for a, e in x[1]] for x in got],
                    "text": [x[0] for x in got],
                })

    return df.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, removed array<struct<start: long, end: long>>, text string")
