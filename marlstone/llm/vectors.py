"""What the two searches share: the query set in a file that every task streams in
blocks, candidates in chunks, and the merge of each chunk's nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_at, list_files, shared_path

Block = tuple[np.ndarray, list[list[float]]]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and ``v`` (array<double>) of rows with an id and a vector of which no
    component is null, infinite or no number."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def save_queries(rows: DataFrame) -> str:
    """Writes the queries (of several rows of an id, the least vector) to the
    shared folder.  Tasks read them in blocks: nothing is broadcast, however many
    they are, and no row is copied for a join."""
    path = shared_path(rows.sparkSession, "queries")
    rows.groupBy("vec_id").agg(F.min("v").alias("v")).write.parquet(path)
    return path


def query_blocks(path: str, size: int) -> Iterator[Block]:
    at, _ = file_at(path)
    for name in list_files(path, ".parquet"):
        with at.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(size, columns=["vec_id", "v"]):
                if b.num_rows:
                    yield b.column(0).to_numpy(), b.column(1)


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers; a shorter vector is filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy())
    if len(n) and (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    at = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[at, place] = flat
    return out


def width(lists: pa.ListArray) -> int:
    return int(np.diff(lists.offsets.to_numpy()).max(initial=0))


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """vec_ids and vectors of about ``size`` rows, across batches, evened out so
    that the last is not small if it can be helped."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.ListArray]:
        t = pa.Table.from_batches(rows).combine_chunks()
        return t.column(0).to_numpy(), t.column(1).chunk(0)

    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            if n >= size and n + part.num_rows > size * 5 // 4:
                yield out(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield out(held)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query of what the chunks found, ties to smaller ids."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores that are allowed, ties to smaller ids."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k] if scores.dtype != object else at[sorted(range(len(at)), key=lambda i: (-scores[at[i]], ids[at[i]]))][:k]


Search = Callable[[np.ndarray, pa.ListArray, str], Iterator[pa.RecordBatch]]
