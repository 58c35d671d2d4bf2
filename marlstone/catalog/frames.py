"""Catalog records as DataFrames, and differences as joins of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import Bound, _content
from .model import to_json, type_text

FIELDS = "type_id long, type_path string, kind string, field_id long, field_name string, type string, slot long, content string"


def fields(spark: SparkSession, bound: Bound) -> DataFrame:
    """One row a field of a bound snapshot; a type without fields has a row without one."""
    rows = [(t["typeId"], "::".join(t["canonicalPath"]), t["kind"], f["fieldId"], f["canonicalName"], type_text(f["canonicalType"]), f["virtualFieldIndex"], to_json(_content(f))) for t in bound["types"] for f in t["fields"]]
    rows += [(t["typeId"], "::".join(t["canonicalPath"]), t["kind"], None, None, None, None, None) for t in bound["types"] if not t["fields"]]
    return spark.createDataFrame(rows, FIELDS)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, type_id, field_id between two frames of ``fields``: full outer joins
    on the ids, each pair classified.  Fields of an added type are not listed; a row
    without a field stands for its type alone."""
    a, b = old.where("field_id is not null").alias("a"), new.where("field_id is not null").alias("b")
    both = a.join(b, (F.col("a.type_id") == F.col("b.type_id")) & (F.col("a.field_id") == F.col("b.field_id")), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    found = F.array_compact(F.array(
        F.when(F.col("b.field_id").isNull(), F.lit("fieldRemoved")),
        F.when(F.col("a.field_id").isNull(), F.lit("fieldAdded")),
        F.when(F.col("a.field_name") != F.col("b.field_name"), F.lit("fieldRenamed")),
        F.when(F.col("a.content") != F.col("b.content"), F.lit("fieldChanged")),
    ))
    of_fields = both.select(F.explode(found).alias("change"), pick("type_id"), pick("field_id"))
    ta, tb = (d.select("type_id", "type_path", "kind").distinct() for d in (old, new))
    of_fields = of_fields.join(ta.select("type_id"), "type_id", "left_semi").select("change", "type_id", "field_id")
    types = ta.alias("a").join(tb.alias("b"), F.col("a.type_id") == F.col("b.type_id"), "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("b.type_id").isNull(), F.lit("typeRemoved")),
        F.when(F.col("a.type_id").isNull(), F.lit("typeAdded")),
        F.when(F.col("a.type_path") != F.col("b.type_path"), F.lit("typeRenamed")),
        F.when(F.col("a.kind") != F.col("b.kind"), F.lit("typeKindChanged")),
    ))
    of_types = types.select(F.explode(found).alias("change"), pick("type_id"), F.lit(None).cast("long").alias("field_id"))
    return of_fields.unionByName(of_types)


def tombstones(spark: SparkSession, history: dict) -> DataFrame:
    rows = [("type", t["typeId"], None, t["retiredAtRevision"]) for t in history["retiredTypes"]] + [("field", f["typeId"], f["fieldId"], f["retiredAtRevision"]) for f in history["retiredFields"]]
    return spark.createDataFrame(rows, "what string, type_id long, field_id long, retired_at long")
