"""Approximate nearest neighbours on robust-pruned directed graphs.

Each chunk of candidates is a shard with a graph of its own.  Vectors enter in
batches that double: a greedy beam search of the graph so far proposes neighbours,
and robust pruning keeps the nearest of them and drops every other that is nearer,
by a relaxed factor, to a kept one than to the vector itself; links back are added
and pruned alike once they are too many.  Queries search each shard's graph with a
beam; what they reach is scored anew in double precision on the vectors as given.
Vectors of one direction are one node, as pruning would cut copies off; a node that
is reached gives the least ids of each vector in it.  A shard with no more nodes
than a beam is scanned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record
from .vectors import chunks, matrix, nearest, query_blocks, save_queries, usable, width

DEGREE, BEAM, SEARCH, ALPHA = 24, 40, 128, 1.2
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Graph:
    """x: unit vectors (float32), a row each.  Distances are squared Euclidean."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        n = len(x)
        self.next = np.full((n, 2 * degree), -1, np.int32)
        self.n_next = np.zeros(n, np.int32)
        mean = x.mean(0)
        self.start = int(np.argmax(x @ mean))
        order = np.random.RandomState(seed).permutation(n)
        order = order[order != self.start]
        at, size = 0, 1
        while at < len(order):
            self._insert(order[at : at + size])
            at += size
            size = min(2 * size, 512)

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = 2 - 2 * np.einsum("qd,qnd->qn", q, self.x[np.maximum(ids, 0)])
        d[ids < 0] = np.inf
        return d

    def search(self, q: np.ndarray, beam: int, wide: int = 4) -> np.ndarray:
        """Ids in the beam of each query, nearest first; -1 fills up."""
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n + 1), bool)
        seen[:, self.start] = True
        ids = np.full((m, beam), -1, np.int32)
        ids[:, 0] = self.start
        dist = np.full((m, beam), np.inf, np.float32)
        dist[:, 0] = self._distances(q, ids[:, :1])[:, 0]
        open_ = ids >= 0
        live = np.arange(m)
        while len(live):
            # The nearest few of each beam that are not expanded yet.
            rank = np.argsort(np.where(open_[live], dist[live], np.inf), axis=1, kind="stable")[:, :wide]
            ok = np.take_along_axis(open_[live], rank, 1)
            pick = np.where(ok, np.take_along_axis(ids[live], rank, 1), -1)
            mark = open_[live]
            np.put_along_axis(mark, rank, False, 1)
            open_[live] = mark
            new = np.where((pick >= 0)[:, :, None], self.next[np.maximum(pick, 0)], -1).reshape(len(live), -1)
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], new]] = -1
            seen[live[:, None], new] = True
            seen[:, n] = False
            most = max(1, int((new >= 0).sum(1).max()))
            new = -np.sort(-new, 1)[:, :most]
            d = self._distances(q[live], new).astype(np.float32)
            all_ids = np.concatenate([ids[live], new], 1)
            all_d = np.concatenate([dist[live], d], 1)
            all_open = np.concatenate([open_[live], new >= 0], 1)
            keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            dist[live] = np.take_along_axis(all_d, keep, 1)
            open_[live] = np.take_along_axis(all_open, keep, 1) & (ids[live] >= 0)
            live = live[open_[live].any(1)]
        return ids

    def _prune(self, p: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning: neighbours of ``p`` of candidates (-1: none)."""
        cand = np.sort(cand, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == p[:, None]] = -1
        d = self._distances(self.x[p], cand)
        order = np.argsort(d, 1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        v = self.x[np.maximum(cand, 0)]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = cand >= 0
        out = np.full((len(p), self.degree), -1, np.int32)
        rows = np.arange(len(p))
        for k in range(self.degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[some, k] = cand[rows, first][some]
            alive &= self.alpha * between[rows, first] > d
            alive[rows, first] = False
        return out

    def _insert(self, p: np.ndarray) -> None:
        out = self._prune(p, self.search(self.x[p], self.beam))
        self.next[p, : self.degree] = out
        self.n_next[p] = (out >= 0).sum(1)
        a, b = np.repeat(p, self.degree), out.ravel()  # links back: from b to a
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        room = self.next.shape[1]
        while len(b):
            head = np.r_[True, b[1:] != b[:-1]]
            nth = np.arange(len(b)) - np.maximum.accumulate(np.where(head, np.arange(len(b)), 0))
            slot = self.n_next[b] + nth
            fits = slot < room
            self.next[b[fits], slot[fits]] = a[fits]
            self.n_next += np.bincount(b[fits], minlength=len(self.n_next)).astype(np.int32)
            a, b = a[~fits], b[~fits]
            full = np.unique(b)
            for i in range(0, len(full), 2048):
                part = full[i : i + 2048]
                kept = self._prune(part, self.next[part])
                self.next[part] = -1
                self.next[part, : self.degree] = kept
                self.n_next[part] = (kept >= 0).sum(1)


def same_rows(x: np.ndarray) -> np.ndarray:
    """For each row the number of the first row equal to it, counted without repeats."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(r.tobytes(), len(known)) for r in x + 0.0], np.int64)  # -0 is 0


def members(node: np.ndarray, vector: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows by node, and where each node's begin.  Of each vector the rows
    of the k + 1 least ids, k of an id at most: less any one id, the k least are there."""
    order = np.lexsort((ids, vector, node))
    v, i = vector[order], ids[order]
    place = np.arange(len(order))
    head = np.r_[True, v[1:] != v[:-1]]
    new = head | np.r_[True, i[1:] != i[:-1]]
    nth_id = np.cumsum(new)
    nth_id = nth_id - np.maximum.accumulate(np.where(head, nth_id, 0))
    nth_row = place - np.maximum.accumulate(np.where(new, place, 0))
    order = order[(nth_id <= k) & (nth_row < k)]
    return order, np.searchsorted(node[order], np.arange(int(node.max()) + 2))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest number to 0.5 to 1: the
    cosine stays, to the last bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def search_shard(ids: np.ndarray, lists: pa.ListArray, path: str, k: int, beam: int = SEARCH) -> Iterator[pa.RecordBatch]:
    dims, graph = width(lists), None
    given = matrix(lists, dims)
    v = scaled(given)
    norm = np.sqrt((v * v).sum(1))
    unit = (v / norm[:, None]).astype(np.float32)
    node = same_rows(unit)
    rows, starts = members(node, same_rows(given), ids, k)
    n = len(starts) - 1
    unit = unit[np.unique(node, return_index=True)[1]]
    for qids, qlists in query_blocks(path, 256):
        d = max(dims, width(qlists))
        if v.shape[1] < d:
            v, unit, graph = *(np.pad(x, ((0, 0), (0, d - v.shape[1]))) for x in (v, unit)), None
        if graph is None and n > beam:
            graph = Graph(unit)
        q = scaled(matrix(qlists, d))
        qn = np.sqrt((q * q).sum(1))
        near = graph.search((q / qn[:, None]).astype(np.float32), beam) if n > beam else np.broadcast_to(np.arange(n), (len(q), n))
        out: list[tuple] = []
        for i, qid in enumerate(qids.tolist()):
            at = near[i][near[i] >= 0]
            size = starts[at + 1] - starts[at]
            at = rows[np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            at = at[ids[at] != qid]
            s = (v[at] * q[i]).sum(1) / (norm[at] * qn[i])
            top = np.lexsort((ids[at], -s))[:k]
            out.append((np.full(len(top), qid), ids[at][top], s[top]))
        yield record(_SCHEMA, dict(zip(_SCHEMA.names, map(np.concatenate, zip(*out)))))


def with_length(rows: DataFrame) -> DataFrame:
    """Usable rows whose vector is not zero."""
    return usable(rows).where(F.exists("v", lambda x: x != 0.0))


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, shard: int = 8192, beam: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the ``k`` nearest found of each
    query, nearest first, ties to smaller ids.

    Every candidate is in a shard's index.  Rows with a null id, a null or zero
    vector, or a component that is null or not finite take no part; rows with the
    query's id are its own; repeated rows are candidates each; a shorter vector is
    taken to end in zeros.  No rows: none."""
    path = save_queries(with_length(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in chunks(batches, shard):
            yield from search_shard(ids, lists, path, k, beam)

    return nearest(with_length(candidates).mapInArrow(run, "query_id long, vec_id long, score double"), k)


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector, against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
