"""Clustering, boosting and selection against plain Python on small made-up rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import boost, cluster, selection


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (4, 0), (0, 4))] + [np.array([[30.0, 30.0]])])
    return x, spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)], "id long, v array<double>, c int")


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    of = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if of[i] < 0:
            of[i], todo = of.max() + 1, [i]
            while todo:
                j = todo.pop()
                for t in np.flatnonzero(d[j] & core & (of < 0)):
                    of[t] = of[i]
                    todo.append(t)
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        of[i] = of[near].min() if len(near) else -1
    return of.tolist()


@pytest.mark.parametrize("eps", [0.25, 0.6])
def test_dbscan(blobs, eps):
    x, df = blobs
    got = [r["cluster"] for r in cluster.dbscan(df, "id", "v", eps, 4).orderBy("id").collect()]
    assert got == brute_dbscan(x, eps, 4) and got[-1] == -1


@pytest.mark.parametrize("linkage", ["ward", "single", "complete", "average"])
def test_agglomerative_parts_blobs(blobs, linkage):
    _, df = blobs
    got = [r["cluster"] for r in cluster.agglomerative(df, "id", "v", 4, linkage).orderBy("id").collect()]
    assert got == [0] * 40 + [1] * 40 + [2] * 40 + [3]


def test_agglomerative_of_none(blobs):
    assert cluster.agglomerative(blobs[1].where("id < 0"), "id", "v", 2).count() == 0


def test_silhouette_alone_and_single(blobs):
    _, df = blobs
    assert cluster.silhouette(df, "id", "c", "v").where("id = 120").first()["silhouette"] == 1.0
    assert {r["silhouette"] for r in cluster.silhouette(df.withColumn("c", F.lit(0)), "id", "c", "v").collect()} == {0.0}


def test_scores_of_one_cluster(blobs):
    one = blobs[1].withColumn("c", F.lit(0))
    assert cluster.calinski_harabasz(one, "c", "v").first()[0] == 0.0
    assert cluster.davies_bouldin(one, "c", "v").first()[0] == 0.0


def test_boost_first_split_is_the_best(spark):
    rng = np.random.default_rng(5)
    x, noise = rng.integers(0, 40, 300).astype(float), rng.integers(0, 40, 300).astype(float)
    y = np.where(x < 17, 1.0, 5.0) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(noise, x, y, strict=True)], "a double, b double, y double")
    m = boost.hist_boost(df, ["a", "b"], "y", rounds=1, rate=1.0, depth=1, min_leaf=1)
    gain = lambda v, c: (y[v < c].mean() - y[v >= c].mean()) ** 2 * (v < c).sum() * (v >= c).sum() if 0 < (v < c).sum() < 300 else 0
    best = max(((gain(v, c), f, c) for f, v in ((0, noise), (1, x)) for c in np.unique(v)), key=lambda g: g[0])
    t = m.rounds[0][0]
    assert (t.feature[1], m.edges[t.feature[1]][t.bin[1] - 1]) == (best[1], best[2])
    want = np.where(x < best[2], y[x < best[2]].mean(), y[x >= best[2]].mean())
    got = [r["prediction"] for r in m.predict(df).collect()]
    assert np.allclose(sorted(got), sorted(want))


def test_boost_classes_missing_and_leaves(spark):
    rows = [(None if i % 9 == 0 else float(i % 30), i % 30 // 10 if i % 9 else 0) for i in range(270)]
    df = spark.createDataFrame(rows, "x double, y int")
    m = boost.hist_boost(df, ["x"], "y", "softmax", rounds=2, depth=3, leaves=3, min_leaf=1)
    got = m.predict(df)
    assert got.where("prediction <> y").count() == 0
    assert all(sum(f >= 0 for f in t.feature) <= 2 for r in m.rounds for t in r)
    b = boost.hist_boost(df.withColumn("y", (F.col("y") > 0).cast("int")), ["x"], "y", "log", rounds=6, depth=2, min_leaf=1)
    assert b.predict(df).where("(prediction >= 0.5) <> (y > 0)").count() == 0


def test_isolation_forest_finds_the_far_row(blobs):
    _, df = blobs
    d = df.select("id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    got = boost.isolation_forest(d, "id", ["a", "b"], trees=50, sample=64).orderBy(F.desc("score")).collect()
    assert got[0]["id"] == 120 and got[0]["outlier"] and got[0]["score"] > 0.6


def test_isotonic(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 60, 400).astype(float), rng.random(400)
    y = y + x / 100
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    blocks = []
    for v in np.unique(x):
        blocks.append([(x == v).sum(), v, y[x == v].mean()])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            (v0, a0, b0), (v1, a1, b1) = blocks[-2:]
            blocks[-2:] = [[v0 + v1, (v0 * a0 + v1 * a1) / (v0 + v1), (v0 * b0 + v1 * b1) / (v0 + v1)]]
    knots = selection.isotonic(df, "x", "y")
    assert np.allclose(knots, [(a, b) for _, a, b in blocks])
    at = [-5.0, 10.5, 30.25, 99.0]
    got = [r["p"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i int, x double").select("i", selection.isotonic_predict(F.col("x"), knots).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, np.interp(at, [k[0] for k in knots], [k[1] for k in knots]))


def test_platt(spark):
    s = [3, 2, 1, 0.5, -0.5, -1, -2, -3]
    df = spark.createDataFrame([(float(v), int(i < 4)) for i, v in enumerate(s)], "s double, y int")
    a, b = selection.platt(df, "s", "y")
    t = np.where(np.arange(8) < 4, 5 / 6, 1 / 6)
    p = 1 / (1 + np.exp(a * np.array(s) + b))
    assert a < 0 and abs(((t - p) * np.array(s)).sum()) < 1e-6 and abs((t - p).sum()) < 1e-6


def test_numbered_and_importance(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("b"))
    rows = selection.numbered(df, [-F.col("id")], "row").collect()
    assert len(rows) == 200 and all(r["row"] == 199 - r["id"] for r in rows)
    df = df.withColumn("y", (F.col("a") > 3).cast("int"))
    predict = lambda d: d.withColumn("prediction", (F.col("a") > 3).cast("double"))
    got = {r["feature"]: r["mean"] for r in selection.permutation_importance(df, "id", predict, ["a", "b"], selection.accuracy("y"), 2).collect()}
    assert got["a"] > 0.2 and got["b"] == 0


def test_search_draws_distinct(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4 % 2).alias("fold"))
    make = lambda v, w: lambda train: lambda rows: rows.withColumn("prediction", F.lit(float(v)) * F.col("y"))
    got = selection.search(df, make, {"v": [0, 1], "w": [1, 2, 3]}, selection.accuracy("y"), k=2, draws=4)
    assert len({tuple(p.values()) for p, _ in got}) == 4 and got[0][1] == max(s for _, s in got)


def test_linear_svr(spark):
    df = spark.range(300).select((F.col("id") % 50 / 10).alias("a"), (F.col("id") % 7 / 7).alias("b")).withColumn("y", 2 * F.col("a") - 3 * F.col("b") + 1)
    got = {r["term"]: r["coef"] for r in selection.linear_svr(df, ["a", "b"], "y", c=1000.0, rounds=150).collect()}
    assert abs(got["a"] - 2) < 0.3 and abs(got["b"] + 3) < 0.6
