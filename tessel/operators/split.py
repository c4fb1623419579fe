"""Splits and folds as columns, by a deterministic order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.order import numbered, running


def _places(df: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """df with _n, the place from 1, and _n_all, the number of rows; within by if given."""
    return running(df, order, {"_n": F.lit(1).cast("long")}, by)


def holdout(df: DataFrame, order: list[str], ratio: float, by: str | None = None) -> DataFrame:
    """df with is_test: the first round(n * ratio) rows in order, at least 1 and at most n - 1; within by if given."""
    n = F.col("_n_all")
    return _places(df, order, by).withColumn("is_test", F.col("_n") <= F.greatest(F.least(F.round(n * F.lit(ratio)), n - 1), F.lit(1))).drop("_n", "_n_all")


def k_fold(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """Contiguous folds of n div k rows; the remainder is in the last."""
    size = F.nullif(F.floor(F.col("_n_all") / k), F.lit(0))
    return _places(df, order).withColumn("fold", F.least(F.floor((F.col("_n") - 1) / size), F.lit(k - 1)).cast("long")).drop("_n", "_n_all")


def stratified_k_fold(df: DataFrame, order: list[str], k: int, by: str) -> DataFrame:
    return _places(df, order, by).withColumn("fold", ((F.col("_n") - 1) % k).cast("long")).drop("_n", "_n_all")


def repeated_k_fold(df: DataFrame, key: str, k: int, repeats: int, seed: int = 1) -> DataFrame:
    """Each row once for each repeat, with repeat and fold: folds of rows in an order dealt anew by a hash of key and
    seed + repeat."""
    each = [k_fold(df, [F.xxhash64(key, F.lit(seed + r)), key], k).withColumn("repeat", F.lit(r).cast("long")) for r in range(repeats)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def group_k_fold(df: DataFrame, order: str, k: int, group: str) -> DataFrame:
    """Groups by first appearance, dealt out in turn."""
    g = numbered(df.groupBy(group).agg(F.min(order).alias("_o")), ["_o", group], "fold")
    return df.join(g.select(group, (F.col("fold") % k).cast("long").alias("fold")), group)


def time_series_split(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """(fold, train_end, test_end) by place: training rows grow by n div (k + 1), the last test runs to n."""
    n = df.agg(F.count("*").alias("n"))
    f = n.select("n", F.floor(F.col("n") / (k + 1)).alias("c"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    return f.select(F.col("fold").cast("long").alias("fold"), (F.col("fold") * F.col("c")).alias("train_end"), F.when(F.col("fold") == k, F.col("n")).otherwise((F.col("fold") + 1) * F.col("c")).alias("test_end"))


def fold_mask(fold: int) -> Column:
    return F.col("fold") == fold
