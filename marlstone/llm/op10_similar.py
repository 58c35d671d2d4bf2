"""SimHash near-dedup at a similarity, for the pipeline: five-word shingles, 0.8.

Texts of Jaccard similarity 0.8 differ in some ten of 64 SimHash bits, beyond what
filing by equal blocks can find.  So a text has 512 bits here, and files are made
by min-hashes of the same shingles: ten files a text, each for three of them; a
pair of similarity 0.8 shares one with probability 0.999.  Equal texts are one
member.  A file is searched from member to member: those not yet reached whose
distances to the pivots allow it are compared, and what is near is reached.  In a
group of copies the first step reaches all, so its cost is its size, not its
pairs, and no link is lost.

Bits only propose: their limit is five deviations above the mean at the similarity,
and what they link falls into groups.  Each group is then searched in the same way,
but a link counts only if the two sets of shingles have the similarity."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_at, record, rows_of, shared_path, slices, stored, with_lists
from .components import components

SIZE, LEAST, WORDS, FILES, HASHES = 5, 0.8, 8, 10, 3
HELD = 1 << 21
NODE = np.dtype("V16")
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), 11) | 1 for i in range(WORDS + FILES * HASHES)], np.uint64)
PIVOTS = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i, j]), 13) for i in range(8) for j in range(WORDS)), np.uint64).reshape(8, WORDS)


def _limit(p: float) -> int:
    return math.ceil(64 * WORDS * p + 5 * math.sqrt(64 * WORDS * p * (1 - p)))


def most_bits(least: float = LEAST) -> int:
    """Differing bits up to which texts are compared.  Sets of equal size and Jaccard
    similarity s have the cosine 2s / (1 + s), others of that similarity a greater
    one; a bit differs with the angle over pi, a little more at some sizes."""
    return _limit(math.acos(2 * least / (1 + least)) / math.pi) + 3


@lru_cache(4096)
def most_bits_of(n: int, least: float = LEAST) -> int:
    """The same where the smaller set has ``n`` shingles: of few, a bit's ties count
    as 0, so its chance to differ is summed over all sizes of the larger set."""
    if n >= 32:
        return most_bits(least)
    worst = 0.0
    for m in range(n, int(n / least + 1e-9) + 1):
        both = next((c for c in range(n + 1) if c >= least * (n + m - c) - 1e-9), None)
        if both is None:
            continue
        over = lambda size, k: sum(math.comb(size - both, j) for j in range(size - both + 1) if 2 * (k + j) > size) / 2 ** (size - both)
        chances = [(over(n, k), over(m, k)) for k in range(both + 1)]
        worst = max(worst, sum(math.comb(both, k) / 2**both * (a + b - 2 * a * b) for k, (a, b) in enumerate(chances)))
    return _limit(worst)


def _mixed(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = h * odd
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def shingles(w: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of some words, ascending."""
    h, join = xxhash.xxh64_intdigest, b" ".join
    grams = map(join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [join(w)]
    return np.unique(np.fromiter((h(g, 42) for g in grams), np.uint64))


def sketch(text: str | None, size: int = SIZE) -> tuple[bytes, list[int], bytes, int]:
    """128 bits for the text's words, its file keys, its SimHash bits, and its
    number of distinct shingles."""
    w = (text or "").encode().lower().split()
    node = xxhash.xxh3_128_digest(b" ".join(w))
    if not w:
        return node, [], bytes(8 * WORDS), 0
    grams = shingles(w, size)
    ones, low = np.zeros((WORDS, 64), np.int64), np.full(FILES * HASHES, ~np.uint64(0))
    for i in range(0, len(grams), 1 << 14):
        part = grams[i : i + (1 << 14)]
        for k in range(WORDS):
            ones[k] += np.unpackbits(_mixed(part, _ODD[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
        for k in range(FILES * HASHES):
            low[k] = min(low[k], _mixed(part, _ODD[WORDS + k]).min())
    keys = [xxhash.xxh3_64_intdigest(low[HASHES * k : HASHES * (k + 1)].tobytes(), k) - (1 << 63) for k in range(FILES)]
    return node, keys, np.packbits(2 * ones.reshape(-1) > len(grams), bitorder="little").tobytes(), len(grams)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                got = [sketch(t, size) for t in rows_of(b.column("text"))]
                yield record(schema, {"doc_id": b.column("doc_id"), "hash": b.column("hash"), "node": [x[0] for x in got], "keys": [x[1] for x in got], "bits": [x[2] for x in got], "n": [x[3] for x in got]})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) hash", "text").mapInArrow(run, "doc_id long, hash long, node binary, keys array<long>, bits binary, n int")


def reach(bits: np.ndarray, most: int | np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each member of a file the place of the first one that leads to it.
    ``most``: of each member, or of all; the greater of two counts.  ``alike`` says
    which of some members within that distance of one are linked to it."""
    most = np.broadcast_to(most, len(bits))
    table = np.bitwise_count(bits[:, None, :] ^ PIVOTS).sum(2, np.int16)
    root, left = np.full(len(bits), -1), np.arange(len(bits))
    while len(left):
        start, todo = int(left[0]), [int(left[0])]
        root[start], left = start, left[1:]
        while todo and len(left):
            x = todo.pop()
            limit = np.maximum(most[left], most[x])
            near = (np.abs(table[left] - table[x]) <= limit[:, None]).all(1)
            near[near] = np.bitwise_count(bits[left[near]] ^ bits[x]).sum(1, np.int64) <= limit[near]
            if alike is not None:
                near[near] = alike(x, left[near])
            hit = left[near]
            root[hit] = start
            todo += hit.tolist()
            left = left[~near]
    return root


def limits(n: np.ndarray, least: float) -> np.ndarray:
    return np.array([most_bits_of(x, least) for x in np.minimum(n, 32).tolist()])


def of_a_size(n: np.ndarray, x: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` are not too large or small to have the similarity with ``x``."""
    return np.minimum(n[others], n[x]) >= least * np.maximum(n[others], n[x]) - 1e-9


def links(distinct: DataFrame, least: float) -> DataFrame:
    """Links a-b between nodes that connect each file's members as far as bits and
    numbers of shingles allow the similarity."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = distinct.select(F.explode("keys").alias("k"), "node", "bits", "n").repartition(n, "k").sortWithinPartitions("k", "node")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def solve(k: np.ndarray, node: np.ndarray, bits: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        ends = np.r_[starts[1:], len(k)]
        a, b = [], []
        for i, j in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            m = n[i:j]
            r = reach(bits[i:j], limits(m, least), lambda x, others: of_a_size(m, x, others, least))
            other = np.flatnonzero(r != np.arange(j - i))
            a += node[i:j][other].tolist()
            b += node[i:j][r[other]].tolist()
        return record(schema, {"a": a, "b": b}) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, NODE), np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int32)]
        for batch in batches:
            got = [batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), NODE), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WORDS), batch.column(3).to_numpy()]
            k, node, bits, n_grams = (np.concatenate([h, g]) for h, g in zip(held, got))
            last = np.flatnonzero(k != k[-1])
            whole = int(last[-1]) + 1 if len(last) else 0  # the last file may go on in the next batch
            if whole and (out := solve(k[:whole], node[:whole], bits[:whole], n_grams[:whole])) is not None:
                yield out
            held = [k[whole:], node[whole:], bits[whole:], n_grams[whole:]]
        if len(held[0]) and (out := solve(*held)) is not None:
            yield out

    return filed.mapInArrow(run, "a binary, b binary")


class Group:
    """Members of one group with their shingles, which beyond ``HELD`` numbers are
    in a file in the shared folder: a group of any size takes 100 bytes a member or so."""

    def __init__(self, folder: str) -> None:
        self.nodes: list[bytes] = []
        self.folder, self.bits, self.held, self.at, self.written = folder, bytearray(), [], [0], 0
        self.path: str | None = None

    def add(self, node: bytes, bits: bytes, grams: np.ndarray) -> None:
        self.nodes.append(node)
        self.bits += bits
        self.held.append(grams)
        self.at.append(self.at[-1] + len(grams))
        if self.at[-1] - self.written > HELD:
            self._flush()

    def _flush(self) -> None:
        if not self.path:
            self.fs, root = file_at(self.folder)
            self.fs.create_dir(root, recursive=True)
            self.path = f"{root}/{uuid.uuid4().hex}.part"
            self.out = self.fs.open_output_stream(self.path)
        for g in self.held:
            self.out.write(g.tobytes())
        self.written, self.held = self.at[-1], []

    def links(self, least: float) -> tuple[list[bytes], list[bytes]]:
        """Links a-b that connect the members whose sets have the similarity."""
        at, n = np.array(self.at), np.diff(self.at)
        if self.path:
            self._flush()
            self.out.close()
            file = self.fs.open_input_file(self.path)
            stretch = lambda a, b: np.frombuffer(file.read_at(8 * (b - a), 8 * a), np.uint64)
        else:
            flat = np.concatenate(self.held)
            stretch = lambda a, b: flat[a:b]

        def all_of(members: np.ndarray) -> np.ndarray:
            """The shingles of some members, in order, by few reads."""
            first, last = at[members], at[members + 1]
            heads = np.flatnonzero(np.r_[True, first[1:] - last[:-1] > 1 << 13])
            parts = []
            for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(members)]):
                whole, base = stretch(int(first[i]), int(last[j - 1])), int(first[i])
                parts += [whole[a - base : b - base] for a, b in zip(first[i:j].tolist(), last[i:j].tolist())]
            return np.concatenate(parts)

        def alike(x: int, others: np.ndarray) -> np.ndarray:
            own, ok = stretch(int(at[x]), int(at[x + 1])), of_a_size(n, x, others, least)
            rest = others[ok]
            both = np.zeros(len(rest), np.int64)
            part = np.cumsum(n[rest]) // HELD
            for i in np.unique(part).tolist():
                some = np.flatnonzero(part == i)
                all_ = all_of(rest[some])
                hit = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
                both[some] = np.add.reduceat(hit, np.cumsum(n[rest[some]]) - n[rest[some]], dtype=np.int64)
            ok[ok] = both >= least * (n[x] + n[rest] - both) - 1e-9
            return ok

        try:
            r = reach(np.frombuffer(bytes(self.bits), np.uint64).reshape(-1, WORDS), limits(n, least), alike)
        finally:
            if self.path:
                file.close()
                self.fs.delete_file(self.path)
        other = np.flatnonzero(r != np.arange(len(r))).tolist()
        return [self.nodes[i] for i in other], [self.nodes[r[i]] for i in other]


def verified(docs: DataFrame, groups: DataFrame, size: int, least: float) -> DataFrame:
    """Links a-b between nodes of a group (node, root, bits, and the doc_id and hash
    of a text of the node) whose sets of shingles have the similarity."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.selectExpr("cast(doc_id as bigint) _id", "xxhash64(text) _hash", "text")
    # Only grouped nodes' texts go on, one a node (or several rows of one id and text, which are the same node).
    rows = texts.join(groups.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("hash")))
    rows = rows.select("root", "node", "bits", "text").repartition(n, "root").sortWithinPartitions("root", "node")
    schema, folder = pa.schema([("a", pa.binary()), ("b", pa.binary())]), shared_path(docs.sparkSession, "similar-shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, group = None, Group(folder)

        def done() -> Iterator[pa.RecordBatch]:
            if len(group.nodes) > 1:
                yield record(schema, dict(zip("ab", group.links(least))))

        for whole in batches:
            for b in slices(whole, "text"):
                for r, node, bits, text in zip(b.column("root").to_pylist(), b.column("node").to_pylist(), b.column("bits").to_pylist(), rows_of(b.column("text"))):
                    if r != root:
                        yield from done()
                        root, group = r, Group(folder)
                    if not group.nodes or group.nodes[-1] != node:
                        group.add(node, bits, shingles(text.encode().lower().split(), size))
        yield from done()

    return rows.mapInArrow(run, "a binary, b binary")


def _named(docs: DataFrame, size: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Every row's node, and of every node its component: root, and as ``first`` the
    document of it that is first (a null id is least; then the text's hash decides)."""
    rows = stored(sketches(docs, size), "similar")
    one = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "hash")
    first = rows.groupBy("node").agg(F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.min(one).alias("one"))
    first = stored(first, "similar-distinct")
    near = components(links(first, least), "similar-near")
    groups = first.select("node", "bits", "one.doc_id", "one.hash").join(near, "node")
    linked = components(verified(docs, groups, size, least), "similar-links")
    known = first.join(linked, "node", "left").select("node", "one", F.coalesce("root", "node").alias("root"))
    group = known.groupBy("root").agg(F.min("one").alias("first"))
    return rows, stored(known.select("node", "root").join(group, "root"), "similar-named")


def similar_components(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """doc_id and component_id (least doc_id of the texts that are linked) of each
    row.  Texts are linked if their sets of shingles have a Jaccard similarity of
    ``least`` and share a file.  Texts of the same words, case aside, are linked, blank and null ones among
    them; a text of fewer words than ``size`` is one shingle.  A null id is less than
    any other."""
    rows, named = _named(docs, size, least)
    return rows.select("doc_id", "node").join(named.select("node", F.col("first.doc_id").alias("component_id")), "node").select("doc_id", "component_id")


def dedup_similar(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """``docs`` less all documents of a component but its first: of least id, a null
    one first, then of least hash of the text.  Rows alike in id and text are one
    document, and all stay with it."""
    _, named = _named(docs, size, least)
    kept = named.select(F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("first.hash").alias("_row")).distinct()
    return with_lists(docs, kept.withColumn("__kept", F.lit(True))).where("__kept").drop("__kept")
