"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.runtime import cut, drop_table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node that has an edge (u, v); component_id is the smallest id reachable.

    Nulls and self-loops are ignored; repeated edges count once; without edges the result is empty.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == seen or not got[0]:
            break
        seen = got
        step = _small(_large(now).where("u <> v").distinct()).where("u <> v").distinct()
        after = cut(step, "cc")
        drop_table(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
