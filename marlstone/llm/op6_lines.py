"""Line dedup on levelled sorted runs.

The index of lines is a set of sorted runs of (key hash, documents, last document,
own), one file for each run and each share of the hash space.  Documents come in
batches.  Each batch's keys, sorted, are merge-anti-joined with the live runs.  The
keys that no run has are new: they are entries of their own in the batch's run.  For
keys that a run has already, the batch's run only holds what is to be added to that
entry.  When a level holds ``fan_in`` runs they are compacted into one of the next
level, and what is to be added goes to its entry if both are there.  At the end the
live runs are merged: every key has one entry, and its counts are added to it.  Lines
go if their key is in enough documents, but in the last document.

A key is hashed to 128 bits.  Runs are read and written in blocks, so a task holds a
block a run, whatever a run's size.  A task reads the runs it is told of and writes
files under new names; the driver drops old runs after the job.  So a task that is run
again, on whatever executor, finds what it needs and writes the same."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, file_at, make_dir, record, row_key, rows_of, shared_path, slices, stored, with_lists

STRIP = b" \t\n\v\f\r"
RUN = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("n", "<i8"), ("last", "<i8"), ("own", "i1")])
BLOCK = 1 << 16


def key_hash(line: bytes, least: int) -> tuple[int, int] | None:
    """Hash of a line's key, or None if the key has fewer than ``least`` code
    points.  UTF-8 continuation bytes are no code points of their own."""
    key = line.strip(STRIP)
    if len(key) < least:
        return None
    if len(key) < 4 * least and not key.isascii() and len(key.decode()) < least:
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key.lower()))


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row (a hash of the text) and hash of each key of a row, once a row."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                ids, rows, hi, lo = [], [], [], []
                for d, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), rows_of(b.column("text"))):
                    found = {key_hash(x, least) for x in t.encode().split(b"\n")} if t else set()
                    found.discard(None)
                    for a, c in found:
                        ids.append(d)
                        rows.append(r)
                        hi.append(a)
                        lo.append(c)
                if ids:
                    yield record(schema, {"doc_id": ids, "row": rows, "hi": hi, "lo": lo})

    return docs.select(*row_key("doc_id", "row"), "text").mapInArrow(run, "doc_id long, row long, hi long, lo long")


def together(streams: list[Iterator[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Sorted streams of blocks in step: of each stream what is at most a key that
    all have come to.  So equal keys come together, and a block a stream is held."""
    heads = [next(s, None) for s in streams]
    while live := [h for h in heads if h is not None]:
        hi, lo = min((int(h["hi"][-1]), int(h["lo"][-1])) for h in live)
        out = []
        for i, h in enumerate(heads):
            if h is None:
                out.append(np.zeros(0, RUN))
                continue
            k = int(((h["hi"] < hi) | (h["hi"] == hi) & (h["lo"] <= lo)).sum())
            out.append(h[:k])
            heads[i] = h[k:] if k < len(h) else next(streams[i], None)
        yield out


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several: documents added, last documents' maximum.  No key
    has two entries of its own."""
    x = np.concatenate(runs)
    x = x[np.lexsort((x["lo"], x["hi"]))]
    heads = np.flatnonzero(np.r_[True, (x["hi"][1:] != x["hi"][:-1]) | (x["lo"][1:] != x["lo"][:-1])])
    out = x[heads].copy()
    for name, f in (("n", np.add), ("last", np.maximum), ("own", np.add)):
        out[name] = f.reduceat(x[name], heads)
    if (out["own"] > 1).any():
        raise RuntimeError("a key is in two runs")
    return out


def unknown(batch: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """Which keys of a sorted batch no run has (merge-anti-join)."""
    new = np.ones(len(batch), bool)
    keys = batch[["hi", "lo"]]
    for r in runs:
        if len(r):
            i = np.searchsorted(r["hi"], batch["hi"], "left")
            j = np.searchsorted(r["hi"], batch["hi"], "right")
            one = j - i == 1
            at = np.minimum(i, len(r) - 1)
            new &= ~(one & (r["lo"][at] == batch["lo"]))
            for k in np.flatnonzero(j - i > 1):  # two keys that share 64 bits
                new[k] &= not (r["lo"][i[k] : j[k]] == keys["lo"][k]).any()
    return new


class Shares:
    """The files of runs below a folder: each run has one for each share."""

    def __init__(self, at: str):
        self.at = at

    def read(self, name: str, share: int) -> Iterator[np.ndarray]:
        at, root = file_at(self.at)
        path = f"{root}/{name}/{share:06d}.run"
        if at.get_file_info(path).type.name == "NotFound":
            return
        with at.open_input_stream(path) as f:
            while data := f.read(BLOCK * RUN.itemsize):
                yield np.frombuffer(data, RUN)

    def write(self, name: str, share: int, blocks: Iterator[np.ndarray]) -> None:
        """Whole file or none."""
        at, root = file_at(self.at)
        path = f"{root}/{name}/{share:06d}.run"
        part = f"{path}.{uuid.uuid4().hex}.part"
        with at.open_output_stream(part) as out:
            for b in blocks:
                out.write(b.tobytes())
        at.move(part, path)

    def merged(self, names: list[str], share: int) -> Iterator[np.ndarray]:
        for blocks in together([self.read(n, share) for n in names]):
            yield merge(blocks)


class LineRuns:
    """The runs in the shared folder; ``add`` takes a batch, ``frequent`` gives the
    keys of at least so many documents."""

    def __init__(self, spark: SparkSession, shares: int, fan_in: int = 2):
        self.spark, self.shares, self.fan_in, self.at = spark, shares, fan_in, shared_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.batches = 0

    def add(self, keys: DataFrame) -> tuple[int, int]:
        """Adds a batch of (doc_id, hi, lo), no document of which was in another
        batch.  Returns how many keys it has and how many of them were new."""
        own, merges, levels, name = f"run-{self.batches}", [], [list(x) for x in self.levels], f"run-{self.batches}"
        for k in range(len(levels) + 1):
            if k == len(levels):
                levels.append([])
            levels[k].append(name)
            if len(levels[k]) < self.fan_in:
                break
            merges.append((levels[k], name := f"level-{k + 1}-{self.batches}"))
            levels[k] = []
        for n in [own, *(m for _, m in merges)]:
            make_dir(f"{self.at}/{n}")
        live = [n for level in self.levels for n in level]
        counts = keys.select("doc_id", "hi", "lo").distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        parts = counts.repartition(self.shares, "hi").select("hi", "lo", "n", "last").sortWithinPartitions("hi", "lo")
        files = Shares(self.at)

        def sorted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                if b.num_rows:
                    x = np.zeros(b.num_rows, RUN)
                    for i, c in enumerate(RUN.names[:4]):
                        x[c] = b.column(i).to_numpy()
                    yield x

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share, found = TaskContext.get().partitionId(), [0, 0]

            def entries() -> Iterator[np.ndarray]:
                for batch, *runs in together([sorted_keys(batches), *(files.read(n, share) for n in live)]):
                    if len(batch):
                        batch["own"] = new = unknown(batch, runs)
                        found[0], found[1] = found[0] + len(batch), found[1] + int(new.sum())
                        yield batch

            files.write(own, share, entries())
            for names, to in merges:
                files.write(to, share, files.merged(names, share))
            yield pa.RecordBatch.from_pydict({"keys": found[:1], "new": found[1:]})

        done = parts.mapInArrow(run, "keys long, new long").agg(F.sum("keys"), F.sum("new")).collect()[0]
        if done[0] is None:  # no key at all: no task ran, and there is no run
            return 0, 0
        self.levels, self.batches = levels, self.batches + 1
        kept = {n for level in levels for n in level}
        at, root = file_at(self.at)
        for n in {own, *live, *(m for _, m in merges)} - kept:
            at.delete_dir(f"{root}/{n}")
        return done[0], done[1]

    def frequent(self, least: int) -> DataFrame:
        """hi, lo, last of the keys of at least ``least`` documents."""
        live, files = [n for level in self.levels for n in level], Shares(self.at)
        schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("last", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for share in b.column("id").to_pylist():
                    for x in files.merged(live, share):
                        if not x["own"].all():
                            raise RuntimeError("a key is in no run")
                        x = x[x["n"] >= least]
                        yield record(schema, {c: np.ascontiguousarray(x[c]) for c in schema.names})

        return self.spark.range(0, self.shares, 1, self.shares).mapInArrow(run, "hi long, lo long, last long")


def surplus(docs: DataFrame, least: int = 40, documents: int = 5, batches: int = 4) -> DataFrame:
    """``_id``, ``_row`` and ``_drop``, the hashes of the keys whose lines go there."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "line-keys")
    keys = line_keys(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    keys.write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema(keys.schema).parquet(path)
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(batches):
        runs.add(pairs.where(F.col("batch") == k))  # reads the batch's folder only
    hot = stored(runs.frequent(documents), "line-frequent")
    # A hot key's rows are on one side only; AQE splits that partition, or broadcasts the keys where it finds them small.
    gone = pairs.join(hot, ["hi", "lo"]).where("doc_id <> last")
    # No list is longer than the lines of one text.
    return gone.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("hi", "lo")).alias("_drop"))


def without_lines(text: str | None, drop: list[dict] | None, least: int) -> tuple[str, int, int]:
    """What stays of a text, its lines, and how many went."""
    text = text or ""
    n = text.count("\n") + 1
    if not drop:
        return text, n, 0
    gone = {(x["hi"], x["lo"]) for x in drop}
    kept = [x for x in text.encode().split(b"\n") if key_hash(x, least) not in gone]
    return b"\n".join(kept).decode(), n, n - len(kept)


def dedup_lines(docs: DataFrame, least: int = 40, documents: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` with ``text`` less the lines whose key (stripped, lower-cased in
    A-Z, at least ``least`` code points) is found in ``documents`` ids or more, but
    in the largest id of them.

    A null id is less than any other and is one document; rows of one id are one
    document for counting, and all lose the same keys.  Null text becomes empty.
    A column n_chars, if there, is brought up to date; other columns pass."""
    cols = docs.columns
    df = with_lists(docs, surplus(docs, least, documents, batches))
    at, drop = cols.index("text"), len(cols)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, "text"):
                got = [without_lines(t, d, least)[0] for t, d in zip(b.column(at).to_pylist(), b.column(drop).to_pylist())]
                arrays = list(b.columns[:drop])
                arrays[at] = pa.array(got, pa.string())
                if "n_chars" in cols:
                    arrays[cols.index("n_chars")] = pa.array(map(len, got), pa.int64()).cast(b.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return df.mapInArrow(run, docs.schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and what stays of each document, as ``dedup_lines`` has it."""
    docs = documents(spark, sf_dir)
    df = with_lists(docs, surplus(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, "text"):
                got = [without_lines(t, d, 40) for t, d in zip(b.column("text").to_pylist(), b.column("_drop").to_pylist())]
                yield record(schema, {"doc_id": b.column("doc_id"), "n_lines": [x[1] for x in got], "n_dropped": [x[2] for x in got], "kept_sha256": [hashlib.sha256(x[0].encode()).hexdigest() for x in got]})

    return df.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_az AS k FROM (
    SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
hot AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, h.k IS NOT NULL AND l.doc_id <> h.last AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
