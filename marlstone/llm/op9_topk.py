"""Exact top-k search by term-at-a-time accumulation.

A chunk of candidates is turned into postings: for each term (component) the
candidates whose weight is not zero, and the weights.  A block of queries goes
through its terms one after another; each scatters query weight times posting
into the block's dense arrays of scores.  Partition selection then takes each
query's best, and a merge over all chunks the final ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record
from .vectors import best, chunks, matrix, nearest, query_blocks, save_queries, usable, width

#: Doubles beyond SAFE are whole numbers; sums of products of vectors within LARGE, times SCALE each, fit 64 bits.
SCALE, SAFE, LARGE = 256.0, float(1 << 53), float(1 << 18)
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def accumulate(queries: np.ndarray, terms: list[tuple[np.ndarray | slice, np.ndarray]], n: int) -> np.ndarray:
    """Scores of ``n`` candidates for each query.  queries: whole numbers."""
    scores = np.zeros((len(queries), n), np.int64)
    for t, (at, weights) in enumerate(terms):
        rows = np.flatnonzero(queries[:, t])
        if isinstance(at, slice) and len(rows) == len(queries):
            scores += queries[:, t, None] * weights
        else:
            for r in rows:
                scores[r, at] += queries[r, t] * weights
    return scores


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    out = []
    for column in np.ascontiguousarray(candidates.T):
        at = np.flatnonzero(column)
        out.append((slice(None), column) if len(at) == len(column) else (at, column[at]))
    return out


def _whole(x: float) -> int:
    """floor(256 x), also where 256 x is no double any more."""
    return int(x) << 8 if abs(x) > SAFE else math.floor(SCALE * x)


def _exact(q: list[float], c: list[float]) -> int:
    """Inner product of vectors too large for 64-bit sums, held to 64 bits."""
    s = sum(_whole(a) * _whole(b) for a, b in zip(q, c))
    return max(-(1 << 63), min((1 << 63) - 1, s))


def search_chunk(ids: np.ndarray, lists: pa.ListArray, path: str, k: int, block: int = 16) -> Iterator[pa.RecordBatch]:
    order = np.argsort(ids, kind="stable")
    ids, lists = ids[order], lists.take(pa.array(order))
    dims, known, out = width(lists), None, ([], [], [])
    for qids, qlists in query_blocks(path, block):
        d = max(dims, width(qlists))
        if known is None or known[0] != d:
            c = matrix(lists, d)
            large = np.flatnonzero((np.abs(c) > LARGE).any(1))
            small = c.copy()
            small[large] = 0
            known = (d, c, large, postings(np.floor(SCALE * small).astype(np.int64)))
        _, c, large, terms = known
        q = matrix(qlists, d)
        odd = (np.abs(q) > LARGE).any(1)
        scores = accumulate(np.floor(SCALE * np.where(odd[:, None], 0, q)).astype(np.int64), terms, len(ids))
        for i, qid in enumerate(qids.tolist()):
            for j in range(len(ids)) if odd[i] else large:
                scores[i, j] = _exact(q[i].tolist(), c[j].tolist())
            at = best(scores[i], ids, ids != qid, k)
            out[0].extend([qid] * len(at))
            out[1].append(ids[at])
            out[2].append(scores[i][at])
        if len(out[0]) > 50_000:
            yield record(_SCHEMA, {"query_id": out[0], "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})
            out = ([], [], [])
    if out[0]:
        yield record(_SCHEMA, {"query_id": out[0], "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, chunk: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best candidates by the
    integer product of vectors of floor(256 x), all if there are fewer.

    Rows with a null id, a null vector, or a component that is null or not finite
    take no part.  Rows with the query's id are its own.  A candidate row that is
    repeated is a candidate each time.  Vectors of different lengths are compared
    as if the shorter had zeros behind.  Products beyond 64 bits are held to them,
    and rank by what they are held to."""
    path = save_queries(usable(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in chunks(batches, chunk):
            yield from search_chunk(ids, lists, path, k)

    return nearest(usable(candidates).mapInArrow(run, "query_id long, vec_id long, score long"), k)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every fiftieth vector, against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
