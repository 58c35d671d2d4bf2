"""Connected components of links between numbers, by alternating large and small
stars (Kiveris et al., "Connected components in MapReduce and beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Links v-m of each u's neighbours (greater ones for a large star, others and
    u itself for a small one) with the least of u and its neighbours."""
    if large:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        out = e.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node reachable) of each node of ``links`` (a, b).

    Every round is written to the shared folder.  A hub's links meet in one
    partition, which AQE splits for the join; its minimum is combined first."""
    e = stored(links.where("a <> b").distinct(), name)
    before = None
    while True:
        e = stored(_star(_star(e, True), False), name)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1000003)).collect()[0])
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
