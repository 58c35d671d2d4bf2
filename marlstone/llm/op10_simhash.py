"""SimHash near-dedup with pivot distance tables.

Copies share a fingerprint, so only distinct fingerprints are compared.  Two that
differ in at most two bits agree in four of six blocks of bits at least; each
fingerprint is filed under its 15 choices of four blocks.  Within a file, a table
of distances to reference fingerprints (pivots) is made; by the triangle
inequality a pair whose distances to any pivot differ by more than the limit is
no link and is dropped without being compared, and survivors are verified.  A
file's members differ in at most 22 bits, so it is bounded; one of over ``MANY``
members is filed again by the same rule within these bits, after which a file has at
most 256 members, and its pivot tables are searched like any other's.  Each file gives a forest of links, and all forests together
the components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, record, rows_of, slices, stored, with_lists
from .components import components

MANY = 1024
_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
_BLOCK_MASKS = [((1 << n) - 1) << at for at, n in _BLOCKS]
MASKS = [sum(m) for m in combinations(_BLOCK_MASKS, 4)]
PIVOTS = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(12)], np.uint64)


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64 bits, each set if over half of the shingles' hashes have it set."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    grams = map(join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [join(w)]
    hashes = np.fromiter((h(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, row (a hash of the text) and fingerprint (the 64 bits as a signed
    number) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                got = np.array([fingerprint(t, size) for t in rows_of(b.column("text"))], np.uint64)
                yield record(schema, {"doc_id": b.column("doc_id"), "row": b.column("row"), "fp": got.view(np.int64)})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) row", "text").mapInArrow(run, "doc_id long, row long, fp long")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place reachable from each of ``n`` places over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_pairs(x: np.ndarray, group: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of one group whose fingerprints differ in at most ``most`` bits.
    ``group`` ascends.  Pivot distances decide first."""
    table = np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int8)
    a, b, live, step = [], [], np.arange(len(x) - 1), 1
    while len(live):
        live = live[live + step < len(x)]
        live = live[group[live] == group[live + step]]
        i, j = live, live + step
        for k in range(len(PIVOTS)):
            ok = np.abs(table[i, k] - table[j, k]) <= most
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(x[i] ^ x[j]) <= most
        a.append(i[ok])
        b.append(j[ok])
        step += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def near_in_parts(x: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large group whose members differ in bits of ``free`` only:
    these bits, too, agree in four of six blocks of a pair."""
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split([i for i in range(64) if free >> i & 1], 6)]
    a, b = [], []
    for part in combinations(blocks, 4):
        key = x & np.uint64(sum(part))
        order = np.argsort(key, kind="stable")
        group = np.cumsum(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.bincount(group)[group]
        order, group = order[size > 1], group[size > 1]
        i, j = near_pairs(x[order], group)
        a.append(order[i])
        b.append(order[j])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame) -> DataFrame:
    """Links a-b that connect all fingerprints (column fp, distinct) with at most
    two differing bits, one tree for each file and component."""
    files = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(MASKS)])
    filed = distinct.select("fp", F.explode(files).alias("f")).select("f.c", "f.k", "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = filed.repartition(n, "c", "k").sortWithinPartitions("c", "k", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        x = fp.view(np.uint64)
        edge = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])]
        group = np.cumsum(edge) - 1
        size = np.bincount(group)[group]
        some = (size > 1) & (size <= MANY)
        at = np.flatnonzero(some)
        i, j = near_pairs(x[at], group[at])
        a, b = [at[i]], [at[j]]
        for g in np.unique(group[size > MANY]).tolist():
            at = np.flatnonzero(group == g)
            i, j = near_in_parts(x[at], ~MASKS[int(c[at[0]])] & (1 << 64) - 1)
            a.append(at[i])
            b.append(at[j])
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            return None
        r = roots(len(x), a, b)
        tree = np.flatnonzero(r != np.arange(len(x)))
        return record(schema, {"a": fp[tree], "b": fp[r[tree]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            c, k, fp = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            last = np.flatnonzero((c != c[-1]) | (k != k[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last file may go on in the next batch
            if whole and (out := solve(c[:whole], k[:whole], fp[:whole])) is not None:
                yield out
            held = [c[whole:], k[whole:], fp[whole:]]
        if len(held[0]) and (out := solve(*held)) is not None:
            yield out

    return filed.mapInArrow(run, "a long, b long")


def _named(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint, and of every fingerprint its component: root, and as
    ``first`` the document of it that is first (a null id is least; then the
    fingerprint and the text's hash decide)."""
    fps = stored(fingerprints(docs, size), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "fp", "row"))
    least = stored(fps.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    linked = components(links(least.select("fp")), "simhash-links").withColumnRenamed("node", "fp")
    known = least.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    group = known.groupBy("root").agg(F.min("first").alias("first"))
    return fps, stored(known.select("fp", "root").join(group, "root"), "simhash-named")


def near_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable) of each row.

    Null or blank texts have fingerprint zero and link like others.  A null id is
    less than any other; rows of one id each have a row.  No rows: none."""
    fps, named = _named(docs, size)
    # One row a fingerprint on the right; a fingerprint that many rows have is split by AQE.
    return fps.join(named.select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def dedup_near(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` less all documents of a component but its first: of least id, a null
    one first, then of least fingerprint and hash of the text.  Rows alike in id and
    text are one document, and all stay with it."""
    _, named = _named(docs, size)
    kept = named.select(*[F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("first.row").alias("_row")]).distinct()
    return with_lists(docs, kept.withColumn("__kept", F.lit(True))).where("__kept").drop("__kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    got = near_components(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
