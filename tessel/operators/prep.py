"""Feature transformers: a fit is one aggregate, a transform a projection with its one-row result."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.stats import unpivot

TINY = 1e-12


def _with(df: DataFrame, fit: DataFrame) -> DataFrame:
    """df with the columns of a one-row fit."""
    return df.crossJoin(F.broadcast(fit))


def standard_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))


def standard_scale(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Less the mean, by the population deviation; a constant column stays as it is."""
    d = _with(df, fit if fit is not None else standard_fit(df, columns))
    return d.withColumns({c: F.when(F.col(f"_s_{c}") > TINY, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}).select(df.columns)


def standard_invert(df: DataFrame, columns: list[str], fit: DataFrame) -> DataFrame:
    return _with(df, fit).withColumns({c: F.when(F.col(f"_s_{c}") > TINY, F.col(c) * F.col(f"_s_{c}") + F.col(f"_m_{c}")).otherwise(F.col(c)) for c in columns}).select(df.columns)


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """From 0 to 1; a constant column is 0."""
    d = _with(df, df.agg(*(F.min(c).alias(f"_a_{c}") for c in columns), *(F.max(c).alias(f"_b_{c}") for c in columns)))
    return d.withColumns({c: F.when(F.col(f"_b_{c}") - F.col(f"_a_{c}") > TINY, (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).otherwise(0.0) for c in columns}).select(df.columns)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Less the median, by the exact quartile range; a range of 0 leaves the difference."""
    d = _with(df, df.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in columns)))
    q = lambda c, i: F.col(f"_q_{c}")[i]
    return d.withColumns({c: (F.col(c) - q(c, 1)) / F.when(q(c, 2) - q(c, 0) > TINY, q(c, 2) - q(c, 0)).otherwise(1.0) for c in columns}).select(df.columns)


def normalize(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    """Each row by its norm (l1, l2 or max); a row of norm 0 stays as it is."""
    absolute = [F.abs(F.col(c)) for c in columns]
    total: Column = F.greatest(*absolute) if norm == "max" else sum(absolute[1:], absolute[0]) if norm == "l1" else F.sqrt(sum((x * x for x in absolute[1:]), absolute[0] * absolute[0]))
    d = df.withColumn("_n", total)
    return d.withColumns({c: F.when(F.col("_n") > TINY, F.col(c) / F.col("_n")).otherwise(F.col(c)) for c in columns}).select(df.columns)


def impute(df: DataFrame, columns: list[str], how: str = "mean", value: float = 0.0) -> DataFrame:
    """Nulls and NaN by the mean, median, mode (of equals the smallest) or a constant; a column without values by 0."""
    seen = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    if how == "constant":
        return df.withColumns({c: F.coalesce(seen[c], F.lit(value)) for c in columns})
    if how == "mode":
        counts = unpivot(df, columns).where("value IS NOT NULL AND NOT isnan(value)").groupBy("feature", "value").count()
        best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("v"))
        fit = best.agg(*(F.max(F.when(F.col("feature") == c, F.col("v"))).alias(f"_i_{c}") for c in columns))
    else:
        fit = df.agg(*((F.avg(seen[c]) if how == "mean" else F.percentile(seen[c], F.lit(0.5))).alias(f"_i_{c}") for c in columns))
    return _with(df, fit).withColumns({c: F.coalesce(seen[c], F.col(f"_i_{c}"), F.lit(0.0)) for c in columns}).select(df.columns)


def label_index(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """(label, code) from 0: sorted, or by first appearance in order_by."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.min(order_by or column).alias("_o"))
    return g.select("label", (F.row_number().over(Window.orderBy("_o")) - 1).cast("long").alias("code"))


def label_encode(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """df with the column code; a value that isn't in the index raises."""
    d = df.join(F.broadcast(index), df[column] == index["label"], "left")
    return d.select(*df.columns, F.coalesce("code", F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))).alias("code"))


def one_hot(df: DataFrame, column: str, drop: str = "none", unknown: str = "error") -> DataFrame:
    """A column of 0 and 1 for each value (sorted); drop: none, first, or binary (the first of two)."""
    values = [r[0] for r in df.select(F.col(column).cast("double")).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    kept = values[1:] if drop == "first" or drop == "binary" and len(values) == 2 else values
    return df.select(*(c for c in df.columns if c != column), *(F.when(F.abs(F.col(column) - v) < 1e-10, 1.0).otherwise(0.0).alias(f"{column}_{int(v)}") for v in kept))


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, bias: bool = True, interaction_only: bool = False) -> DataFrame:
    """Products of up to degree columns, by degree and then by first column."""
    out = [F.lit(1.0).alias("bias")] if bias else []
    for d in range(1, degree + 1):
        for c in combinations_with_replacement(columns, d):
            if not interaction_only or len(set(c)) == d:
                x = F.col(c[0]).cast("double")
                for y in c[1:]:
                    x = x * F.col(y)
                out.append(x.alias("_x_".join(c)))
    return df.select(*(c for c in df.columns if c not in columns), *out)


def variances(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """(feature, variance, kept): population variance, kept above the threshold."""
    return unpivot(df, columns).groupBy("feature").agg(F.var_pop("value").alias("variance")).withColumn("kept", F.col("variance") > threshold)


def f_classif(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, f): variance between classes over that within; 0 under two classes."""
    long = unpivot(df, columns, keep=[target])
    per = long.groupBy("feature", target).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("within"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    g = per.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand).alias("between"), F.sum("within").alias("within"))
    return g.select("feature", F.when((F.col("k") < 2) | (F.col("n") <= F.col("k")), 0.0).when(F.col("within") <= 0, 1.7976931348623157e308).otherwise((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def select_k_best(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f"), "feature")).cast("long")).where(F.col("place") <= k)


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """df with bin: 0 for missing, else 1 and up by quantiles of distinct values; a value on an edge goes right."""
    seen = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").distinct()
    edges = seen.agg(F.array_distinct(F.percentile("v", F.array(*(F.lit(i / bins) for i in range(1, bins))))).alias("_e"))
    x = F.col(column).cast("double")
    return _with(df, edges).withColumn("bin", F.when(x.isNull() | F.isnan(x), 0).otherwise(F.size(F.filter("_e", lambda e: e <= x)) + 1).cast("long")).drop("_e")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov) of each pair a <= b, with n - 1."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.a", "x.b", "x.cov")


def pca(df: DataFrame, columns: list[str], k: int, whiten: bool = False) -> DataFrame:
    """PC1 ... PCk of the centred columns; each component's largest loading is positive."""
    import numpy as np

    n = len(columns)
    rows = {(r["a"], r["b"]): r["cov"] for r in covariance(df, columns).collect()}
    c = np.array([[rows.get((a, b), rows.get((b, a))) for b in columns] for a in columns], dtype=float)
    means = df.agg(*(F.avg(x).alias(x) for x in columns)).first()
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(values)[::-1][:k]
    out = []
    for i, j in enumerate(order.tolist(), 1):
        v = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j])
        v = v / np.sqrt(values[j]) if whiten and values[j] > TINY else v
        out.append(sum(((F.col(columns[m]) - means[columns[m]]) * float(v[m]) for m in range(1, n)), (F.col(columns[0]) - means[columns[0]]) * float(v[0])).alias(f"PC{i}"))
    return df.select(*(x for x in df.columns if x not in columns), *out)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, weight): n / (classes * rows of the class)."""
    g = df.groupBy(target).count()
    return g.select(target, (F.sum("count").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("count"))).alias("weight"))
