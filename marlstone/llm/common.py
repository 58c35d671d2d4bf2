"""What the operators share: the cluster's shared folder, file access, batch
helpers and cutting very long texts at places where no tokenizer looks across."""

from __future__ import annotations

import atexit
import posixpath
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

T_ = TypeVar("T_")
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the folder in ``spark.checkpoint.dir``.  Only where that is unset
    (tests on one machine) a folder of our own stands in and goes at exit."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root if "://" in root or root.startswith("file:") else "file://" + root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return "file://" + _local_roots[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there plays the part
    of a checkpoint and has the same lifetime."""
    return posixpath.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and
    a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str, row: str) -> tuple[Column, Column]:
    """What tells documents apart where rows may have no id or the same: the id (a
    null one counts as the least) and a hash of the text.  Rows alike in both are one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(doc_id), F.xxhash64("text").alias(row)


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` with the last column of ``lists`` (``_id``, ``_row``, and that) of its
    documents.  The side with the lists is hashed, so texts are moved but not sorted;
    a row that is repeated very often is split by AQE."""
    name = lists.columns[-1]
    left = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *row_key("__id", "__row"))
    on = (F.col("__id") == F.col("_id")) & (F.col("__row") == F.col("_row"))
    both = left.join(lists.hint("shuffle_hash"), on, "left")
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], name)


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out anew if its files have fewer row groups than there are
    cores: these can't be split, and most cores would have nothing to do.  No more
    footers are read than there are cores; a larger scan is left as it is."""
    cores, files = docs.sparkSession.sparkContext.defaultParallelism, docs.inputFiles()
    if not 0 < len(files) < cores:
        return docs
    groups = 0
    for name in files:
        at, path = file_at(name)
        with at.open_input_file(path) as f:
            groups += pq.ParquetFile(f).num_row_groups
    return docs.repartition(2 * cores) if groups < cores else docs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a folder's documents."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as bigint) doc_id", "text"))


def file_at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


def make_dir(uri: str) -> None:
    at, path = file_at(uri)
    at.create_dir(path, recursive=True)


def put_file(uri: str, data: bytes) -> None:
    """Whole file or none: written beside its place, then moved there."""
    at, path = file_at(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with at.open_output_stream(part) as out:
        out.write(data)
    at.move(part, path)


def get_file(uri: str) -> bytes:
    at, path = file_at(uri)
    with at.open_input_file(path) as f:
        return f.read()


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def list_files(uri: str, suffix: str) -> list[str]:
    at, path = file_at(uri)
    found = at.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(suffix))


_held: dict[tuple, object] = {}


def hold(key: tuple, make: Callable[[], T_]) -> T_:
    """The one large thing (a vocabulary with its memo) that a Python worker keeps
    from task to task; that of another operator goes, as executors are shared."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def rows_of(column: pa.Array | pa.ChunkedArray, step: int = 128) -> Iterator[object]:
    """Values one by one, converted a few at a time so that a batch of large
    texts never exists twice."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``most`` bytes of ``column``."""
    sizes = batch.column(column).nbytes / max(1, batch.num_rows)
    step = max(1, min(rows, int(most / max(1.0, sizes))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def record(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


#: A space before something that isn't white space: a pre-tokenizer whose pieces
#: hold white space at most in front starts a piece there in any case.
_BEFORE_WORD = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def words_at_spaces(text: str) -> list[str]:
    """``text`` without the spaces at which it may be cut: all parts but the first
    had one space in front."""
    return _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")


def windows(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``size``, cut only before a space and a word."""
    at = 0
    while len(text) - at > size:
        m = _BEFORE_WORD.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text

