"""Nearest neighbours, ranges and matches. Queries are taken in blocks of a broadcast side whose size is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vector

_DISTANCE = {"l2": lambda a, b: F.sqrt(vector.squared_l2(a, b)), "l1": vector.l1, "cosine": lambda a, b: 1 - vector.cosine_similarity(a, b), "hamming": vector.hamming}
#: A set of queries beyond this is refused: take it in blocks, or use the near-duplicate operators.
MOST_QUERIES = 100_000


def pairs(queries: DataFrame, train: DataFrame, key: str, vec: str, metric: str) -> DataFrame:
    """(q, t, d): a stated set of queries against all rows."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"over {MOST_QUERIES} queries at once")
    q = queries.select(F.col(key).alias("q"), F.col(vec).alias("_a"))
    t = train.select(F.col(key).alias("t"), F.col(vec).alias("_b"))
    return t.crossJoin(F.broadcast(q)).select("q", "t", _DISTANCE[metric](F.col("_a"), F.col("_b")).alias("d"))


def nearest(queries: DataFrame, train: DataFrame, key: str, vec: str, k: int, metric: str = "l2", with_self: bool = False) -> DataFrame:
    """(q, t, d, place): the k nearest of each query, of equals the lower key. Each task keeps k of a query before the
    shuffle, as Spark's window limit is pushed below it."""
    p = pairs(queries, train, key, vec, metric)
    p = p if with_self else p.where("q <> t")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))
    return p.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def classify(near: DataFrame, labels: DataFrame, key: str, label: str, weighted: bool = False) -> DataFrame:
    """(q, label) by votes of the neighbours; of equal votes the lowest label. Weighted: by 1 / d, a match takes all."""
    n = near.join(labels.select(F.col(key).alias("t"), F.col(label).alias("label")), "t")
    w = F.when(F.col("d") < 1e-12, 1e18).otherwise(1 / F.col("d")) if weighted else F.lit(1.0)
    votes = n.groupBy("q", "label").agg(F.sum(w).alias("v"))
    return votes.groupBy("q").agg(F.min_by("label", F.struct(-F.col("v"), F.col("label"))).alias("label"))


def regress(near: DataFrame, values: DataFrame, key: str, value: str, weighted: bool = False) -> DataFrame:
    n = near.join(values.select(F.col(key).alias("t"), F.col(value).cast("double").alias("y")), "t")
    w = F.when(F.col("d") < 1e-12, 1e18).otherwise(1 / F.col("d")) if weighted else F.lit(1.0)
    return n.groupBy("q").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


def ratio_test(near: DataFrame, ratio: float) -> DataFrame:
    """(q, t) of the best match where it is nearer than ratio times the second; a single candidate stays."""
    g = near.groupBy("q").agg(F.max(F.when(F.col("place") == 1, F.col("t"))).alias("t"), F.max(F.when(F.col("place") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("place") == 2, F.col("d"))).alias("d2"))
    return g.where(F.col("d2").isNull() | ((F.col("d2") > 1e-12) & (F.col("d1") / F.col("d2") < ratio))).select("q", "t")


def cross_check(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """(q, t) of ab whose best match back is q."""
    return ab.where("place = 1").select("q", "t").join(ba.where("place = 1").select(F.col("q").alias("t"), F.col("t").alias("q")), ["q", "t"], "left_semi")


def within(queries: DataFrame, train: DataFrame, key: str, vec: str, eps: float, metric: str = "l2") -> DataFrame:
    """(q, t, d) with d <= eps, a row itself included."""
    return pairs(queries, train, key, vec, metric).where(F.col("d") <= eps)


def dbscan_core(queries: DataFrame, train: DataFrame, key: str, vec: str, eps: float, min_samples: int) -> DataFrame:
    """(q, n, core): neighbours within eps, itself included, and whether they are enough."""
    return within(queries, train, key, vec, eps).groupBy("q").agg(F.count("*").alias("n")).withColumn("core", F.col("n") >= min_samples)


def nearest_center(vec: Column, centers: Column) -> Column:
    """(d2, cluster): the nearest of an array of (cluster, center); of equals the lower cluster."""
    return F.array_min(F.transform(centers, lambda c: F.struct(vector.squared_l2(vec, c["center"]).alias("d2"), c["cluster"].alias("cluster"))))


def with_cluster(df: DataFrame, vec: str, centroids: DataFrame, name: str = "_near") -> DataFrame:
    """df with name, the nearest of centroids (cluster, center) as (d2, cluster). All centroids travel as one row and each
    row looks for its own, so no row is shuffled; they are a model of k vectors, not a table."""
    held = F.broadcast(centroids.agg(F.collect_list(F.struct("cluster", "center")).alias("_centers")))
    return df.crossJoin(held).withColumn(name, nearest_center(F.col(vec), F.col("_centers"))).drop("_centers")


def assign(df: DataFrame, key: str, vec: str, centroids: DataFrame) -> DataFrame:
    """(key, cluster, d2): nearest of centroids (cluster, center); of equals the lower cluster."""
    return with_cluster(df.select(key, vec), vec, centroids).select(key, F.col("_near.cluster").alias("cluster"), F.col("_near.d2").alias("d2"))


def center_distances(df: DataFrame, key: str, vec: str, centroids: DataFrame) -> DataFrame:
    """(key, cluster, d): the distance of each row to each centroid (cluster, center)."""
    return df.select(key, vec).crossJoin(F.broadcast(centroids.select("cluster", "center"))).select(key, "cluster", F.sqrt(vector.squared_l2(F.col(vec), F.col("center"))).alias("d"))
