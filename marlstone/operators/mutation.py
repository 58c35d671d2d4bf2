"""Mutations as DataFrame to DataFrame: the table's new state, and the rows that
changed.  Nothing is written here; snapshots are (sources/snapshots.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.types import TypeInfo
from ..plans.values import Change, col

HIT = "__hit"


def insert(t: TypeInfo, now: DataFrame, new: DataFrame, one: bool) -> Change:
    """Appends ``new``, whose keys and unique fields must be new to the table and to
    each other; else the action on either frame fails.

    The check joins the few new rows with the table on each such field; the table
    is filtered to rows that clash, so none of it is shuffled but through a join on
    a key of the new rows."""
    names = [f.name for f in t.fields if f.primary or f.unique]
    checked = new
    for n in names:
        clash = now.select(col(n).alias("__old")).where(F.col("__old").isNotNull()).union(
            new.groupBy(col(n).alias("__old")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 and __old is not null").select("__old")
        )
        hit = clash.join(new.select(col(n).alias("__old")).distinct(), "__old", "left_semi").distinct().withColumn(HIT, F.lit(True))
        failed = F.when(F.col(HIT), F.raise_error(F.concat(F.lit(f"DuplicateKey: {t.name}.{n} = "), col(n).cast("string"))))
        checked = checked.join(hit, col(n) == F.col("__old"), "left").withColumn("__bad", failed).where(F.col("__bad").isNull()).drop("__old", HIT, "__bad")
    checked = checked.select(*[col(f.name) for f in t.fields])
    return Change(t, now.select(*[col(f.name) for f in t.fields]).unionByName(checked), checked, one)


def update(t: TypeInfo, rows: DataFrame, p: Column, to: dict[str, Column], schema: T.StructType, one: bool) -> Change:
    """Sets fields of the rows where ``p`` is true; new values see the old row."""
    types = {f.name: f.dataType for f in schema}
    marked = rows.select(p.alias(HIT), *[F.when(p, to[f.name].cast(types[f.name])).otherwise(col(f.name)).alias(f.name) if f.name in to else col(f.name) for f in t.fields])
    fields = [col(f.name) for f in t.fields]
    return Change(t, marked.select(*fields), marked.where(F.col(HIT)).select(*fields), one)


def delete(t: TypeInfo, rows: DataFrame, p: Column, one: bool) -> Change:
    """Keeps the rows where ``p`` isn't true, those where it is null among them."""
    fields = [col(f.name) for f in t.fields]
    return Change(t, rows.where(~p).select(*fields), rows.where(p).select(*fields), one)
