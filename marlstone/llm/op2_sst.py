"""Token-ID output as sorted string tables.

A shard holds documents in ascending id: blocks of prefix-compressed entries with
restart points, a sparse index with each block's first key, a Bloom filter, and a
footer.  A document is found by filter, bisection of the index, and bisection of
one block's restarts.

    entry   shared, rest, value lengths (varints), rest of the key, value
    block   entries, restart offsets (u32 each), their number (u32)
    file    blocks, index, filter, footer (JSON), its length (u32), magic

A key is the id as 8 bytes, big-endian with the sign flipped; a null id is the
empty key and comes first.  A value is the ids, 2 bytes each if all ids of the
vocabulary fit, else 4.  Several rows of one id are several entries, in order."""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_at, make_dir, record, shared_path, slices
from .encoders import library_encoder, with_end

MAGIC, RESTART, BLOCK, HASHES, BITS = b"MSST\x01\0\0\0", 16, 1 << 16, 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bits(keys: list[bytes], m: int) -> np.ndarray:
    """The ``HASHES`` places of each key in a filter of ``m`` bits."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    i = np.arange(HASHES, dtype=np.uint64)
    return (h[:, :1] + i * (h[:, 1:] | np.uint64(1))) % np.uint64(m)


def bloom(keys: list[bytes], m: int) -> bytes:
    bits = np.zeros((m + 7) // 8, np.uint8)
    for i in range(0, len(keys), 1 << 16):
        at = _bits(keys[i : i + (1 << 16)], m).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
    return bits.tobytes()


class ShardWriter:
    """Writes one shard; the file appears under its name only when whole."""

    def __init__(self, uri: str, width: int, name: str):
        self.fs, self.path = file_at(uri)
        self.part = f"{self.path}.{name}.part"
        self.out, self.width, self.at = self.fs.open_output_stream(self.part), width, 0
        self.index: list[list] = []
        self.keys: list[bytes] = []
        self.n_docs = self.n_tokens = 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def _flush(self) -> None:
        if self.count:
            self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.out.write(bytes(self.block))
            self.index[-1][2] = len(self.block)
            self.at += len(self.block)
            self._open()

    def add(self, key: bytes, value: bytes) -> None:
        if not self.count:
            self.index.append([key.hex(), self.at, 0])
        shared = 0
        if self.count % RESTART:
            if key and self.last:  # both have eight bytes: the first that differs
                shared = 8 - ((int.from_bytes(key) ^ int.from_bytes(self.last)).bit_length() + 7 >> 3)
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last, self.count = key, self.count + 1
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(value) // self.width
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._flush()

    def close(self) -> None:
        self._flush()
        m = max(64, len(self.keys) * BITS)
        bits = bloom(self.keys, m)
        index = json.dumps(self.index).encode()
        foot = json.dumps({"index": [self.at, len(index)], "bloom": [self.at + len(index), len(bits), m], "width": self.width, "n_docs": self.n_docs, "n_tokens": self.n_tokens}).encode()
        self.out.write(index + bits + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class Shard:
    """A shard opened for look-up (``get``) and for reading in order (``scan``)."""

    def __init__(self, uri: str):
        at, path = file_at(uri)
        self.f = at.open_input_file(path)
        n = self.f.size()
        tail = self.f.read_at(12, n - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        k = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self.f.read_at(k, n - 12 - k))
        self.width = self.foot["width"]
        self.index = [(bytes.fromhex(a), b, c) for a, b, c in json.loads(self.f.read_at(self.foot["index"][1], self.foot["index"][0]))]
        self.firsts = [x[0] for x in self.index]
        self.bloom = self.f.read_at(self.foot["bloom"][1], self.foot["bloom"][0])

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits([key], self.foot["bloom"][2])[0].tolist())

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        _, at, size = self.index[i]
        data = self.f.read_at(size, at)
        n = struct.unpack_from("<I", data, size - 4)[0]
        return data, list(struct.unpack_from(f"<{n}I", data, size - 4 - 4 * n)), size - 4 - 4 * n

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            data, _, end = self._block(i)
            for k, v in self._entries(data, 0, end):
                yield id_of(k), self._ids(v)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of ``doc_id``; none: an empty list."""
        key, out = key_of(doc_id), []
        if not self.index or not self.may_hold(key):
            return out
        for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            data, restarts, end = self._block(i)
            heads = [next(self._entries(data, r, end))[0] for r in restarts] if len(restarts) < 8 else None
            if heads is None:
                lo, hi = 0, len(restarts)
                while lo < hi:
                    mid = (lo + hi) // 2
                    if next(self._entries(data, restarts[mid], end))[0] < key:
                        lo = mid + 1
                    else:
                        hi = mid
                start = max(0, lo - 1)
            else:
                start = max(0, bisect_left(heads, key) - 1)
            for k, v in self._entries(data, restarts[start], end):
                if k > key:
                    break
                if k == key:
                    out.append(self._ids(v))
        return out


def width_of(path: str, end_id: int) -> int:
    """Bytes an id of the tokenizer in the file at ``path``, and of ``end_id``."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4


def ranges(docs: DataFrame, shards: int) -> np.ndarray:
    """Ids at which ranges of about as many documents each begin, less the first."""
    if shards < 2:
        return np.zeros(0, np.int64)
    at = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / shards for k in range(1, shards)], max(10_000, 20 * shards)).alias("at"))
    return np.array(at.collect()[0].at or [], np.int64)


def write_shards(docs: DataFrame, path: str, end_id: int, out: str, shards: int) -> list[tuple[str, int, int]]:
    """Encodes ``docs`` (doc_id, text; null text: empty), ends each document with
    ``end_id``, and writes shards in ascending id below ``out``.  Returns (file,
    documents, tokens) of each shard in order: a row a file, as any listing has.

    Null ids come first.  Rows of one id are entries of one shard, in the order of
    their ids' bytes; so an id with very many rows makes a long shard, which is
    written and read as a stream like others.  No rows: no shards."""
    make_dir(out)
    width, bounds = width_of(path, end_id), ranges(docs, shards)
    found = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(path, "bytes")
        for whole in batches:
            for b in slices(whole, "text"):
                flat, at = with_end(*e.flat(b.column("text")), end_id)
                ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((width * at).astype(np.int32)), pa.py_buffer(flat.astype(f"<u{width}"))])
                doc_id = b.column("doc_id")
                shard = np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(), "right")
                yield record(found, {"shard": np.where(doc_id.is_null(), 0, shard).astype(np.int32), "doc_id": doc_id, "ids": ids})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = TaskContext.get(), None
        name = f"{out}/shard-{at.partitionId():07d}.sst"
        for b in batches:
            w = w or ShardWriter(name, width, str(at.taskAttemptId()))
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                w.add(key_of(d), x.as_buffer())
        if w:
            w.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [w.n_docs], "n_tokens": [w.n_tokens]})

    # Ids are moved, not texts.  Shards are ranges, each sorted, so they are in global order.
    encoded = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(encode, "shard int, doc_id long, ids binary")
    moved = encoded.repartitionById(shards, "shard").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    rows = moved.mapInArrow(write, "file string, n_docs long, n_tokens long").collect()
    return sorted((r.file, r.n_docs, r.n_tokens) for r in rows)


def read_shards(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files.  No
    files: no rows."""
    starts, total = [], 0
    for name, _, n in files:
        starts.append((name, total))
        total += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                rows: list[tuple] = []
                for d, ids in Shard(name).scan():
                    rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield record(schema, dict(zip(schema.names, map(list, zip(*rows)))))
                        rows = []
                if rows:
                    yield record(schema, dict(zip(schema.names, map(list, zip(*rows)))))

    listed = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)), "file")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, as read back from the shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, shared_path(spark, "op2"), shards)
    return read_shards(spark, files)
