"""Byte-level BPE, encoding and decoding.

A piece's merges run on a segment tree over its byte positions.  A leaf holds the
rank of the pair that starts there, with the position as tie-breaker; an inner
node holds the least of its children, so the root is the leftmost pair of least
rank.  A merge changes three leaves (the pair's, its left neighbour's, and the
right part's, which goes), each with a logarithmic walk to the root.  Trees of
many pieces advance together as rows of one array; a piece beyond 256 bytes has a
tree of its own, so that a text without spaces costs n log n."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, hold, record, slices, with_field
from .encoders import PLAIN_WORD, WordEncoder, as_bytes, byte_level_pieces, cut_byte_level

_NONE = np.int64(1) << 60


class Ranks:
    """A rank file: tokens by id, and the ids that pairs of tokens merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {b: a for a, b in self.rank.items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.values[i], _NONE)


def _together(ranks: Ranks, pieces: list[bytes], size: int) -> list[bytes]:
    """Ids of pieces of 2 to ``size`` bytes, a power of two."""
    n, bits, rows = len(pieces), size.bit_length(), np.arange(len(pieces))
    length = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    tok = ranks.byte[raw]
    place = np.arange(size)
    follow = np.broadcast_to(place + 1, (n, size)).copy()
    before = np.broadcast_to(place - 1, (n, size)).copy()
    alive = place < length[:, None]
    tree = np.full((n, 2 * size), _NONE)
    r = ranks.of_pairs(tok[:, :-1], tok[:, 1:])
    tree[:, size:-1] = np.where(alive[:, 1:] & (r < _NONE), r << bits | place[:-1], _NONE)
    for k in range(size.bit_length() - 2, -1, -1):
        w = 1 << k
        tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])

    def put(at: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[at, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])

    def leaf_rank(at: np.ndarray, left: np.ndarray, right: np.ndarray, there: np.ndarray) -> np.ndarray:
        r = ranks.of_pairs(tok[at, left], tok[at, np.minimum(right, size - 1)])
        return np.where(there & (r < _NONE), r << bits | left, _NONE)

    act = rows[tree[:, 1] < _NONE]
    while len(act):
        root = tree[act, 1]
        pos = root & ((1 << bits) - 1)
        gone = follow[act, pos]
        right = follow[act, gone]
        tok[act, pos] = root >> bits
        alive[act, gone] = False
        follow[act, pos] = right
        has = right < length[act]
        before[act[has], right[has]] = pos[has]
        put(act, gone, np.full(len(act), _NONE))
        put(act, pos, leaf_rank(act, pos, right, has))
        left = before[act, pos]
        ok = left >= 0
        if ok.any():
            at, le, po = act[ok], left[ok], pos[ok]
            put(at, le, leaf_rank(at, le, po, np.ones(len(at), bool)))
        act = act[tree[act, 1] < _NONE]
    flat = tok[alive].astype("<u4")
    ends = np.cumsum(alive.sum(1)) * 4
    data, at = flat.tobytes(), 0
    out = []
    for e in ends.tolist():
        out.append(data[at:e])
        at = e
    return out


def _alone(ranks: Ranks, piece: bytes) -> bytes:
    """Ids of one long piece, on a segment tree of its own."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tok = ranks.byte[np.frombuffer(piece, np.uint8)]
    none, pairs = int(_NONE), ranks.pairs
    r = ranks.of_pairs(tok[:-1], tok[1:])
    level = np.full(size, _NONE)
    level[: n - 1] = np.where(r < _NONE, r << 32 | np.arange(n - 1), _NONE)
    levels = [level]
    while len(level) > 1:
        levels.append(level := np.minimum(level[::2], level[1::2]))
    tree = np.concatenate([np.full(1, _NONE), *reversed(levels)]).tolist()
    tok, follow, before, alive = tok.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

    def put(leaf: int, value: int) -> None:
        node = leaf + size
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least

    while (root := tree[1]) < none:
        pos, rank = root & 0xFFFFFFFF, root >> 32
        gone = follow[pos]
        right = follow[gone]
        tok[pos], follow[pos], alive[gone] = rank, right, 0
        put(gone, none)
        if right < n:
            before[right] = pos
            r = pairs.get(rank << 32 | tok[right])
            put(pos, none if r is None else r << 32 | pos)
        else:
            put(pos, none)
        if (left := before[pos]) >= 0:
            r = pairs.get(tok[left] << 32 | rank)
            put(left, none if r is None else r << 32 | left)
    return as_bytes([t for t, a in zip(tok, alive) if a])


def encode_pieces(ranks: Ranks, pieces: list[str], together: int = 256) -> list[bytes]:
    """Ids of pieces: a piece that is a token is that token, whatever its merges
    would give; others by merges."""
    out: list[bytes | None] = [None] * len(pieces)
    by_size: dict[int, list[int]] = {}
    raw = [p.encode() for p in pieces]
    for i, p in enumerate(raw):
        if (r := ranks.rank.get(p)) is not None:
            out[i] = r.to_bytes(4, "little")
        elif not p:
            out[i] = b""
        elif len(p) > together:
            out[i] = _alone(ranks, p)
        else:
            by_size.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
    for size, at in by_size.items():
        step = max(1, (1 << 18) // size)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            for i, ids in zip(part, _together(ranks, [raw[i] for i in part], size)):
                out[i] = ids
    return out


def encoder(path: str) -> tuple[Ranks, WordEncoder]:
    def make() -> tuple[Ranks, WordEncoder]:
        ranks = Ranks(path)
        return ranks, WordEncoder(byte_level_pieces, lambda p: encode_pieces(ranks, p), PLAIN_WORD, cut_byte_level)

    return hold(("bpe", path), make)


def decode(ranks: Ranks, ids: bytes) -> bytes:
    return b"".join(map(ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with column ``ids`` (array<int>): the whole of ``text`` in ids.

    Null and empty texts: an empty array.  A column that has the name ``ids`` is
    replaced; all others pass as they are, repeated rows each."""
    keep = [c for c in docs.columns if c != ids]
    df = docs.select(*[f"`{c}`" for c in keep])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, e = encoder(path)
        for whole in batches:
            for b in slices(whole, text):
                flat, ends = e.flat(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))], names=[*keep, ids])

    schema = with_field(df.schema, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``.

    Null and empty texts have no ids and the digests of nothing; a null id stays
    null, and a repeated row has a row each time."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, e = encoder(path)
        for whole in batches:
            for b in slices(whole, "text"):
                flat, ends = e.flat(b.column("text"))
                data = memoryview(flat.astype("<u4", copy=False)).cast("B") if len(flat) else b""
                got = [data[4 * i : 4 * j] for i, j in zip(ends.tolist(), ends[1:].tolist())]
                yield record(schema, {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": np.diff(ends),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in got],
                    "decoded_sha256": [hashlib.sha256(decode(ranks, x)).hexdigest() for x in got],
                })

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of the bytes they decode to."""
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
