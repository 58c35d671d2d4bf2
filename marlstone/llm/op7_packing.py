"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared lengths).  Pieces go in descending length into the open sequence that
suits best among those that hold them under every capacity: the least weighted
norm of what would be left ("norm"), or the greatest weighted dot product of
demand and rest ("dot").  Weights are the load of each capacity.

Pieces of one length are alike, so the plan needs only how many there are of each
length: one number for each of at most ``tokens`` lengths reaches the driver.
Sequences in the same state move as runs, and the plan is a list of moves: the
pieces of length L ranked r to r + m lie at one offset of sequences s to s + m.
Executors then look each piece up by length and rank.  Thus the packing is the
global one, whatever the partitions, and no partition leaves sequences half full."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, get_file, make_dir, put_file, record, shared_path, slices, stored
from .encoders import library_encoder, with_end


def plan(counts: dict[int, int], tokens: int = 2048, docs: int = 2048, attention: int = 2048 * 2048, rule: str = "norm") -> np.ndarray:
    """Moves (length, rank, pieces, sequence, offset), by length and rank.

    counts: pieces of each length, 1 to ``tokens``.  A piece whose square exceeds
    ``attention`` fits no sequence: ValueError, as for lengths out of range."""
    if any(not 1 <= n <= tokens or n * n > attention for n, c in counts.items() if c) or docs < 1:
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    cap = np.array([tokens, docs, attention], float)
    load = np.array([sum(c * x for n, c in counts.items() for x in [f(n)]) for f in (lambda n: n, lambda n: 1, lambda n: n * n)], float) / cap
    weight = load / max(load.max(), 1e-12)
    size = 64
    first, many, left = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, 3), np.int64)
    used, opened, moves = 0, 0, []

    def add(at: int, n: int, rest: np.ndarray) -> None:
        nonlocal size, first, many, left, used
        if used == size:
            live = np.flatnonzero((many > 0) & (left[:, 0] > 0) & (left[:, 1] > 0))
            if len(live) > size // 2:
                size *= 2
            f, m, r = first[live], many[live], left[live]
            first, many, left = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, 3), np.int64)
            used = len(live)
            first[:used], many[:used], left[:used] = f, m, r
        first[used], many[used], left[used] = at, n, rest
        used += 1

    for n in sorted((k for k, c in counts.items() if c), reverse=True):
        need, rank, c = np.array([n, 1, n * n]), 0, counts[n]
        while rank < c:
            fits = np.flatnonzero((many[:used] > 0) & (left[:used] >= need).all(1))
            if len(fits):
                after = (left[fits] - need) / cap
                score = (weight * after**2).sum(1) if rule == "norm" else -(weight * (need / cap) * (left[fits] / cap)).sum(1)
                i = int(fits[np.argmin(score)])
                m = min(c - rank, int(many[i]))
                moves.append((n, rank, m, first[i], tokens - left[i, 0]))
                at, rest = int(first[i]), left[i] - need
                first[i] += m
                many[i] -= m
                rank += m
                add(at, m, rest)
                continue
            per = int(min(tokens // n, docs, attention // (n * n)))
            bins = max(1, (c - rank) // per)
            for k in range(min(per, c - rank)):
                moves.append((n, rank, bins, opened, k * n))
                rank += bins
            add(opened, bins, np.array([tokens, docs, attention]) - (k + 1) * need)
            opened += bins
    out = np.array(moves, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


@lru_cache(2)
def _moves(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.load(io.BytesIO(get_file(uri)))
    keys = m[:, 0] << 48 | m[:, 1]
    return keys, m, m[:, 3] - m[:, 1]


def cut(docs: DataFrame, path: str, tokens: int, end_id: int) -> DataFrame:
    """Pieces of each document's ids with ``end_id``: doc_id, piece, start, length,
    ids_crc32, and ``task`` and ``nth``, which number the pieces of one length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task, seen = library_encoder(path, "lower"), TaskContext.get().partitionId(), [0] * (tokens + 1)
        for whole in batches:
            for b in slices(whole, "text"):
                flat, at = with_end(*e.flat(b.column("text")), end_id)
                data, rows = memoryview(flat.astype("<u4", copy=False)).cast("B"), []
                for d, i, j in zip(b.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist()):
                    for k, start in enumerate(range(i, j, tokens)):
                        n = min(tokens, j - start)
                        rows.append((d, k, start - i, n, zlib.crc32(data[4 * start : 4 * (start + n)]), task, seen[n]))
                        seen[n] += 1
                yield record(schema, dict(zip(schema.names, map(list, zip(*rows)))))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(pieces: DataFrame, tokens: int = 2048, docs: int = 2048, attention: int = 2048 * 2048, rule: str = "norm") -> DataFrame:
    """``pieces`` (with length, task, nth as from ``cut``, stored) with sequence_id
    and offset.  No pieces: no rows."""
    spark = pieces.sparkSession
    held = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("many"))
    held = stored(held, "packing-counts")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("many").alias("n")).collect()}
    folder = shared_path(spark, "packing-plan")
    make_dir(folder)
    data = io.BytesIO()
    np.save(data, plan(counts, tokens, docs, attention, rule))
    put_file(f"{folder}/moves.npy", data.getvalue())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("task", "length", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    # A task's pieces of one length are at most that task's rows, so no key is hot.
    ranked = pieces.join(base.hint("shuffle_hash"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, moves, shift = _moves(f"{folder}/moves.npy")
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, length << 48 | rank, "right") - 1
            yield record(schema, {c: b.column(c) for c in schema.names[:5]} | {"sequence_id": rank + shift[i], "offset": moves[i, 4]})

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, tokens: int = 2048, max_docs: int = 2048, attention: int = 2048 * 2048, rule: str = "norm") -> DataFrame:
    """Whole texts (null: empty) in ids with ``end_id``, in pieces of at most
    ``tokens``, packed.  A row of ``docs`` gives its pieces, a repeated row again."""
    return pack(stored(cut(docs, path, tokens, end_id), "packing-pieces"), tokens, max_docs, attention, rule)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of at most 2048 ids, packed; a null text is the end id."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
