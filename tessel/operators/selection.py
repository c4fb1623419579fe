"""Calibration, cross-validation, parameter search, stacking and importance.

A model is given as fit(train) -> predict, and predict(df) -> df with a column `prediction`. A search makes its models with
make(**parameters) -> fit.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.order import numbered
from tessel.runtime import cut

Predict = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Predict]


def cross_val_predict(df: DataFrame, fit: Fit, fold: str = "fold", k: int = 5) -> DataFrame:
    """df with the prediction of the model that was fitted without the row's fold."""
    parts = [fit(df.where(F.col(fold) != i))(df.where(F.col(fold) == i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accuracy(target: str) -> Column:
    return F.avg((F.abs(F.col(target) - F.col("prediction")) < 1e-6).cast("double"))


def cross_val_score(df: DataFrame, fit: Fit, score: Column, fold: str = "fold", k: int = 5) -> DataFrame:
    """(fold, score): the score, an aggregate over prediction, of each fold."""
    return cross_val_predict(df, fit, fold, k).groupBy(fold).agg(score.alias("score"))


def search(df: DataFrame, make: Callable[..., Fit], grid: dict[str, list], score: Column, k: int = 5, draws: int | None = None, seed: int = 1) -> list[tuple[dict, float]]:
    """(parameters, mean score over folds), best first and of equals the first met. With draws, so many distinct
    combinations of the grid are taken at random, without replacement."""
    combos = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    if draws is not None and draws < len(combos):
        combos = random.Random(seed).sample(combos, draws)
    out = []
    for c in combos:
        m = cross_val_score(df, make(**c), score, k=k).agg(F.avg("score").alias("s")).first()["s"]
        out.append((c, float("-inf") if m is None or m != m else float(m)))
    return sorted(out, key=lambda x: -x[1])


def stacking(df: DataFrame, fits: list[Fit], final: Callable[[list[str]], Fit], key: str, k: int = 5) -> Predict:
    """final(columns) is fitted on the out-of-fold predictions of each base; bases are fitted again on all rows."""
    names = [f"base{i}" for i in range(len(fits))]
    meta = df
    for n, f in zip(names, fits, strict=True):
        meta = meta.join(cross_val_predict(df, f, k=k).select(key, F.col("prediction").cast("double").alias(n)), key)
    top = final(names)(cut(meta, "stacking"))
    bases = [f(df) for f in fits]

    def predict(rows: DataFrame) -> DataFrame:
        d = rows
        for n, b in zip(names, bases, strict=True):
            d = b(d).withColumn(n, F.col("prediction").cast("double")).drop("prediction")
        return top(d).drop(*names)

    return predict


def permutation_importance(df: DataFrame, key: str, predict: Predict, features: list[str], score: Column, repeats: int = 5, seed: int = 1) -> DataFrame:
    """(feature, mean, std) of the loss of score as a column's values are dealt anew among the rows."""
    rows = numbered(df, [key])
    base = predict(df).agg(score.alias("s")).first()["s"]
    out = []
    for f in features:
        drops = []
        for r in range(repeats):
            dealt = numbered(df.select(F.col(key).alias("_k"), F.col(f).alias("_v")), [F.xxhash64("_k", F.lit(f), F.lit(seed + r)), "_k"]).select("row", F.col("_v").alias(f))
            drops.append(base - predict(rows.drop(f).join(dealt, "row")).agg(score.alias("s")).first()["s"])
        m = sum(drops) / repeats
        out.append((f, m, (sum((x - m) ** 2 for x in drops) / max(repeats - 1, 1)) ** 0.5))
    return df.sparkSession.createDataFrame(out, "feature string, mean double, std double")


def platt(df: DataFrame, score: str, target: str, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a * score + b)) by damped Newton steps, an aggregate each, on targets drawn in by the
    counts of both classes."""
    import numpy as np

    s, pos = F.col(score).cast("double"), F.col(target) > 0.5
    r = df.agg(F.sum(pos.cast("long")).alias("p"), F.count("*").alias("n")).first()
    p, n = r["p"] or 0, r["n"] - (r["p"] or 0)
    t = F.when(pos, (p + 1) / (p + 2)).otherwise(1 / (n + 2))
    d = df.select(s.alias("s"), t.alias("t"))

    def loss(w) -> Column:
        z = F.lit(float(w[0])) * F.col("s") + F.lit(float(w[1]))
        return F.sum(F.col("t") * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))

    w = np.array([0.0, float(np.log((n + 1) / (p + 1)))])
    for _ in range(rounds):
        z = F.lit(float(w[0])) * F.col("s") + F.lit(float(w[1]))
        q = 1 / (1 + F.exp(z))
        e, h = F.col("t") - q, q * (1 - q)
        m = d.agg(loss(w).alias("l"), F.sum(e * F.col("s")).alias("g0"), F.sum(e).alias("g1"), F.sum(h * F.col("s") * F.col("s")).alias("h0"), F.sum(h * F.col("s")).alias("h1"), F.sum(h).alias("h2")).first()
        step = np.linalg.solve(np.array([[m["h0"] + 1e-12, m["h1"]], [m["h1"], m["h2"] + 1e-12]]), np.array([m["g0"], m["g1"]]))
        sizes = [0.5**i for i in range(8)]
        tried = d.agg(*(loss(w - f * step).alias(f"l{i}") for i, f in enumerate(sizes))).first()
        better = [f for i, f in enumerate(sizes) if tried[f"l{i}"] <= m["l"] + 1e-12]
        if not better or np.abs(better[0] * step).max() < 1e-8:
            break
        w = w - better[0] * step
    return float(w[0]), float(w[1])


def platt_predict(score: Column, fitted: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(F.lit(fitted[0]) * score + F.lit(fitted[1])))


def _pool(blocks: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(weight, mean x, mean y) of adjacent blocks, merged while their means fall."""
    out: list[tuple[float, float, float]] = []
    for w, x, y in blocks:
        while out and out[-1][2] >= y:
            v, a, b = out.pop()
            w, x, y = v + w, (v * a + w * x) / (v + w), (v * b + w * y) / (v + w)
        out.append((w, x, y))
    return out


def isotonic(df: DataFrame, score: str, target: str) -> list[tuple[float, float]]:
    """Knots (mean x, mean y) of the rising fit. Each range of scores is pooled in its task and the blocks that are left
    are pooled again, which gives the same fit."""
    import pandas as pd

    g = df.select(F.col(score).cast("double").alias("x"), F.col(target).cast("double").alias("y")).groupBy("x").agg(F.count("*").cast("double").alias("w"), F.avg("y").alias("y"))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, float, float]] = []
        for p in parts:
            held = _pool(held + list(zip(p["w"], p["x"], p["y"], strict=True)))
        yield pd.DataFrame(held, columns=["w", "x", "y"])

    rows = g.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(task, "w double, x double, y double").collect()
    return [(x, y) for _, x, y in _pool(sorted(((r["w"], r["x"], r["y"]) for r in rows), key=lambda b: b[1]))]


def isotonic_predict(score: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, level beyond them."""
    if not knots:
        return F.lit(None).cast("double")
    xs, ys = F.lit([k[0] for k in knots]), F.lit([k[1] for k in knots])
    i = F.size(F.filter(xs, lambda v: v <= score))
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return F.when(i == 0, knots[0][1]).when(i == len(knots), knots[-1][1]).otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))


def calibrated(df: DataFrame, fit: Fit, target: str, method: str = "platt", k: int = 5) -> Predict:
    """The model fitted on all rows, its scores (the column prediction) mapped by a calibrator of out-of-fold scores."""
    held = cut(cross_val_predict(df, fit, k=k).select("prediction", target), "calibrated")
    model = fit(df)
    if method == "platt":
        w = platt(held, "prediction", target)
        return lambda rows: model(rows).withColumn("prediction", platt_predict(F.col("prediction"), w))
    knots = isotonic(held, "prediction", target)
    return lambda rows: model(rows).withColumn("prediction", isotonic_predict(F.col("prediction"), knots))


def spark_ml(stage, features: list[str]) -> Fit:
    """A model of Spark ML (trees, forests, support vectors one against the rest, perceptrons) over numeric columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    keep = {"featuresCol": "_x", "predictionCol": "prediction"}

    def fit(train: DataFrame) -> Predict:
        s = stage.copy()
        for name, value in keep.items():
            s._set(**{name: value})
        m = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), s]).fit(train)
        return lambda rows: m.transform(rows).select(*rows.columns, "prediction")

    return fit


def linear_svr(df: DataFrame, features: list[str], target: str, c: float = 1.0, epsilon: float = 0.1, rate: float = 0.5, rounds: int = 100, tol: float = 1e-4) -> DataFrame:
    """(term, coef): w**2 / (2 C n) + mean of |error| beyond epsilon, by steps of falling size over all rows on
    standardised features; it stops when no weight moves by tol."""
    import numpy as np

    x = [F.col(f).cast("double") for f in features]
    m = df.agg(F.count("*").alias("n"), F.avg(target).alias("y"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(x)), *(F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x))).first()
    mean = np.array([m[f"m{i}"] for i in range(len(x))])
    std = np.array([m[f"s{i}"] if m[f"s{i}"] > 1e-12 else 1.0 for i in range(len(x))])
    d = df.select(F.array(*((v - float(a)) / float(s) for v, a, s in zip(x, mean, std, strict=True))).alias("x"), F.col(target).cast("double").alias("y"))
    w, b, k = np.zeros(len(x)), float(m["y"]), len(x)
    for i in range(rounds):
        z = sum((F.col("x")[j] * float(w[j]) for j in range(k)), F.lit(b))
        e = z - F.col("y")
        side = F.when(e > epsilon, 1.0).when(e < -epsilon, -1.0).otherwise(0.0)
        r = d.agg(F.avg(side).alias("b"), *(F.avg(side * F.col("x")[j]).alias(f"g{j}") for j in range(k))).first()
        step = rate / (1 + i) ** 0.5
        dw = step * (np.array([r[f"g{j}"] for j in range(k)]) + w / (c * m["n"]))
        db = step * r["b"]
        w, b = w - dw, b - db
        if max(np.abs(dw).max(), abs(db)) < tol:
            break
    coef = w / std
    rows = [("intercept", float(b - coef @ mean)), *((f, float(v)) for f, v in zip(features, coef, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")
