"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text are its words, pairs of neighbouring words, the shapes of words
(case, script, punctuation) and their pairs, and whether a word follows itself,
hashed into ``2**bits`` weights; a feature's value is its count over the root of
the sum of squared counts.  Only the text is looked at."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import documents, get_file, hold, make_dir, put_file, record, rows_of, shared_path, slices, windows, with_field

BITS, WORD = 20, re.compile(r"\w+|[^\w\s]+")
_MIX, _SHAPE, _PAIR, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def shape(word: str) -> int:
    """A class of words by how they look, not by what they say."""
    if word.isdigit():
        k = 1
    elif word.isalpha():
        k = 2 if word.islower() else 3 if word.isupper() and len(word) > 1 else 4 if word[0].isupper() and word[1:].islower() else 5
    elif word[0].isalnum() or word[0] == "_":
        k = 6
    else:
        k = 7 + (xxhash.xxh32_intdigest(word) & 0xFFFF)
    return k << 4 | min(len(word), 15)


class Buckets:
    """Counts of buckets, added part by part: a long text takes no more than its
    distinct buckets and one part."""

    def __init__(self) -> None:
        self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, buckets: list[np.ndarray]) -> None:
        at, n = np.unique(np.concatenate(buckets), return_counts=True)
        if len(self.at):
            both, back = np.unique(np.concatenate([self.at, at]), return_inverse=True)
            n = np.bincount(back, np.concatenate([self.n, n])).astype(np.int64)
            at = both
        self.at, self.n = at, n

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.at, self.n


class Features(dict):
    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word) & ~0xFFFFFF | shape(word) & 0xFFFFFF
        if len(self) < self.limit and len(word) < 64:
            self[word] = h
        return h

    def of(self, text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets in order, and their values."""
        seen, down, last = Buckets(), np.uint64(64 - bits), np.zeros(0, np.uint64)
        for part in windows(text):
            new = np.fromiter(map(self.__getitem__, WORD.findall(part)), np.uint64)
            w = np.concatenate([last, new])  # the last word of the part before makes a pair with the first
            s = (w & np.uint64(0xFFFFFF)) * _SHAPE
            again = w[1:] == w[:-1]
            k = len(last)
            seen.add([((x * _MIX) >> down).astype(np.int32) for x in (new, s[k:], (w[:-1] ^ w[1:] * _PAIR) * _PAIR, s[:-1] ^ s[1:] * _PAIR, again * _AGAIN + _AGAIN)])
            last = w[-1:]
        at, n = seen.counts()
        n = n.astype(np.float64)
        return at, n / max(1e-9, np.sqrt((n * n).sum()))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


class Ftrl:
    """Per-coordinate FTRL-proximal; the bias has the last place."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _packed(model: Ftrl) -> bytes:
    data = io.BytesIO()
    np.save(data, model.weights().astype("<f4"))
    return zlib.compress(data.getvalue(), 1)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 5 = 0")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, epochs: int = 16, label: str = "quality") -> str:
    """Learns ``label`` from labelled rows that are not held out, and returns the
    URI of the weights in the shared folder.

    At most ``max_rows`` rows are learnt from, those of least hash of their id: a
    documented bound, so the one task that updates weights in turn has a bounded
    input, which it goes through ``epochs`` times.  An id with labels at odds counts
    as the greater, an id with several texts as the least; a null label or id is no
    label.  No labels: the weights are zero and every score is one half."""
    spark = docs.sparkSession
    known = labels.where(f"doc_id is not null and {label} is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows rows of two numbers: safe to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _features()
        for whole in batches:
            for b in slices(whole, "text"):
                got = [f.of(t or "") for t in rows_of(b.column("text"))]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("_label"), "at": [a.astype("<i4").tobytes() for a, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got]})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for b in batches:
            for y, at, x in zip(*(b.column(c).to_pylist() for c in ("label", "at", "x"))):
                seen.append((y, np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4")))
        for _ in range(epochs):
            for y, at, x in seen:
                model.learn(at, x.astype(float), y)
        yield pa.RecordBatch.from_pydict({"weights": [_packed(model)]})

    used = rows.mapInArrow(features, "doc_id long, label int, at binary, x binary")
    # One ordered partition of a bounded number of rows; the order makes the weights reproducible.
    ordered = used.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "at")
    got = ordered.mapInArrow(learn, "weights binary").collect()
    folder = shared_path(spark, "quality-model")
    make_dir(folder)
    put_file(f"{folder}/weights", got[0].weights if got else _packed(Ftrl()))
    return f"{folder}/weights"


def _features() -> Features:
    return hold(("features",), Features)


@lru_cache(2)
def _weights(uri: str) -> np.ndarray:
    return np.load(io.BytesIO(zlib.decompress(get_file(uri)))).astype(np.float64)


def _score(uri: str, texts: Iterator[str | None]) -> list[float]:
    f, w = _features(), _weights(uri)
    out = []
    for t in texts:
        at, x = f.of(t or "")
        out.append(sigmoid(float(w[at] @ x) + w[-1]))
    return out


def score(docs: DataFrame, model: str, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with column ``name``: the chance of label 1 for the whole text; a
    null or empty text gets that of the bias alone.  A column of that name is
    replaced; repeated rows stay."""
    keep = [c for c in docs.columns if c != name]
    df = docs.select(*[f"`{c}`" for c in keep])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_score(model, rows_of(b.column(at))), pa.float64())], names=[*keep, name])

    return df.mapInArrow(run, with_field(df.schema, name, T.DoubleType()))


def keep_good(docs: DataFrame, model: str, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more, as they are; a null or empty
    text by the bias alone, a repeated row each time."""
    cols = docs.columns
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.filter(pa.array([s >= least for s in _score(model, rows_of(b.column(at)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and whether it was held out of training."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield record(schema, {"doc_id": b.column("doc_id"), "score": _score(model, rows_of(b.column("text")))})

    scored = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
