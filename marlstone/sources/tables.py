"""Where a program's tables come from."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import reduce
from types import NoneType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.types import RANGES, Model, TypeInfo
from ..plans.values import Scalar, col


class Source:
    """Scans of a model's types.  frames: DataFrames by type name; others are read
    from Parquet at ``root/<name>.parquet``, with ``files`` for other file names."""

    def __init__(self, spark: SparkSession, model: Model, root: str | None = None, frames: dict[str, DataFrame | Callable[[], DataFrame]] | None = None, files: dict[str, str] | None = None, stream: bool = False):
        self.spark, self.model, self.root, self.frames, self.files, self.stream = spark, model, root, frames or {}, files or {}, stream

    def scan(self, t: TypeInfo) -> DataFrame:
        """The contract's columns, in its order; the rest of a file isn't read."""
        if t.name in self.frames:
            df = self.frames[t.name]
            df = df() if callable(df) else df
        else:
            if self.root is None:
                raise KeyError(f"no source for {t.name}")
            path = posixpath.join(self.root, self.files.get(t.name, f"{t.name.lower()}.parquet"))
            if self.stream:
                df = self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(path)
            else:
                df = self.spark.read.parquet(path)
        missing = [f.name for f in t.fields if f.name not in df.columns]
        if missing:
            raise KeyError(f"{t.name} has no column {missing[0]}")
        return df.select(*[col(f.name) for f in t.fields])


def _checked(c: Column, f: Any, model: Model) -> Column:
    """A value of the field's type: unsigned numbers in range, vectors of their
    dimension, required fields not null; else the action fails."""
    kind = model.spark(f.type)
    out = c.cast(kind)
    if f.scalar in RANGES:
        low, high = RANGES[f.scalar]
        ok = out.isNull() | out.between(F.lit(low), F.lit(high).cast("decimal(20,0)") if high >= 1 << 63 else F.lit(high))
        out = F.when(ok, out).otherwise(F.raise_error(F.lit(f"OutOfRange: {f.name}")).cast(kind))
    if isinstance(kind, T.ArrayType) and "generic" in f.inner and f.inner["generic"]["path"][-1] == "vector":
        n = int(f.inner["generic"]["arguments"][0]["literal"])
        out = F.when(out.isNull() | (F.size(out) == n), out).otherwise(F.raise_error(F.lit(f"BadDimension: {f.name}")).cast(kind))
    if not f.optional:
        out = F.coalesce(out, F.raise_error(F.lit(f"NullValue: {f.name}")).cast(kind))
    return out


def _is_plain(v: Any) -> bool:
    return isinstance(v, (bool, float, str, NoneType)) or isinstance(v, int) and -(1 << 63) <= v < 1 << 63


def checked_rows(model: Model, t: TypeInfo, rows: DataFrame) -> DataFrame:
    """Rows with the fields of a type, each of which is checked."""
    return rows.select(*[_checked(col(f.name), f, model).alias(f.name) for f in t.fields])


def literal_rows(spark: SparkSession, model: Model, t: TypeInfo, rows: list[dict[str, Scalar]]) -> DataFrame:
    """Constructed rows.  What is known while lowering becomes a table of plain
    values, however many rows there are; a row with any other value (an id or time to
    be made by Spark, a list) is a struct of expressions.  All are checked as columns."""
    plain, other, out = [], [], []
    for r in rows:
        (plain if all(x.known and _is_plain(x.known[0]) for x in r.values()) else other).append(r)
    if plain:
        columns, kinds = {}, []
        for f in t.fields:
            values = [r[f.name].known[0] for r in plain]
            seen = {type(v) for v in values} - {NoneType}
            kind = next((k for k, of in ((T.StringType(), {str}), (T.BooleanType(), {bool}), (T.LongType(), {int}), (T.DoubleType(), {int, float})) if seen <= of), T.StringType())
            make = float if isinstance(kind, T.DoubleType) else str if isinstance(kind, T.StringType) else lambda v: v
            columns[f.name] = [None if v is None else make(v) for v in values]
            kinds.append(T.StructField(f.name, kind))
        data = spark.createDataFrame(list(zip(*columns.values())), T.StructType(kinds))
        out.append(checked_rows(model, t, data))
    if other:
        made = F.array(*[F.struct(*[_checked(r[f.name].column, f, model).alias(f.name) for f in t.fields]) for r in other])
        out.append(spark.range(0, 1, 1, 1).select(F.inline(made)))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], model.schema(t))
