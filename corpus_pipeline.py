"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and is the next stage's docs.  All but the last give the columns of
``documents``; a stage that changes texts brings n_chars up to date."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import stored
from marlstone.llm.op5_spans import dedup_spans
from marlstone.llm.op6_lines import dedup_lines
from marlstone.llm.op7_packing import pack_documents
from marlstone.llm.op8_quality import keep_good, train
from marlstone.llm.op10_similar import dedup_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of label 1 is at least 0.3."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents have stay in the last only."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of texts linked at a similarity
    of 0.8 of five-word shingles: SimHash proposes, the shingles decide."""
    return dedup_similar(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences stay where they are first."""
    return dedup_spans(docs, tails=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences of at most 2048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("passages", passages),
    ("packing", packing),
]

#: A trained classifier and fingerprints aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
