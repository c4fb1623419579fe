"""Boosting grows all trees of a round together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import boost
from tessel.plans import catalogue, learning


def test_classes_share_passes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 8, 400)
    x = np.stack([y * 10 + rng.integers(0, 5, 400), rng.integers(0, 50, 400)], axis=1).astype(float)
    df = spark.createDataFrame([(*map(float, v), int(c)) for v, c in zip(x, y, strict=True)], "a double, b double, y int")
    spark.sparkContext.setJobGroup("boost-test", "")
    try:
        m = boost.hist_boost(df, ["a", "b"], "y", "softmax", rounds=1, depth=3, min_leaf=1)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost-test")) <= 24  # one by one, 8 trees took 24 passes of some jobs each
    assert m.predict(df).where("prediction <> y").count() == 0
    monkeypatch.setattr(boost, "HISTOGRAMS", 1)  # a pass for each node
    again = boost.hist_boost(df, ["a", "b"], "y", "softmax", rounds=1, depth=3, min_leaf=1)
    assert [(t.feature, t.bin) for t in again.rounds[0]] == [(t.feature, t.bin) for t in m.rounds[0]]


@pytest.mark.parametrize("loss", ["softmax", "log", "squared"])
def test_held_rows_give_the_trees_of_passes(spark, monkeypatch, loss):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(size=300)).round(2) if loss == "squared" else np.digitize(x[:, 0] + x[:, 1] * x[:, 2], [-0.5, 0.5] if loss == "softmax" else [0.0])
    rows = [(*(None if j == 1 and i % 11 == 0 else float(v) for j, v in enumerate(r)), None if i % 50 == 7 else float(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    fit = lambda: boost.hist_boost(df, ["a", "b", "c"], "y", loss, rounds=2, depth=5, leaves=7, min_leaf=5)
    held = fit()
    monkeypatch.setattr(boost, "HELD", 0)
    passes = fit()
    shape = lambda m: [[(t.feature, t.bin) for t in r] for r in m.rounds]
    assert shape(held) == shape(passes)
    assert all(sum(f >= 0 for f in t.feature) == 6 for r in held.rounds for t in r)
    leaf = lambda m: np.array([r["_raw"] for r in m.raw(df).orderBy("a").collect()])
    assert np.allclose(leaf(held), leaf(passes), rtol=1e-9, atol=1e-12)


def test_passes_leave_out_nodes_that_no_leaf_needs(spark, monkeypatch):
    monkeypatch.setattr(boost, "HELD", 0)
    levels, splits = [], boost._splits
    monkeypatch.setattr(boost, "_splits", lambda *a: levels.append(len(a[4])) or splits(*a))
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(200, 2))], "a double, y double")
    boost.hist_boost(df, ["a"], "y", rounds=1, depth=5, leaves=3, min_leaf=1)
    assert max(levels) <= 4


def test_multiclass_query_does_all_rounds(spark, monkeypatch):
    made, fit = [], boost.hist_boost
    monkeypatch.setattr(boost, "hist_boost", lambda *a, **b: made.append(fit(*a, **b)) or made[-1])
    got = catalogue.queries()["hist_gbt_multiclass"](spark, "/root/testdata/sf0.001")
    assert len(made[0].rounds) == 100 and {len(r) for r in made[0].rounds} == {10}
    assert max(t.depth for r in made[0].rounds for t in r) == 8 and max(sum(f >= 0 for f in t.feature) for r in made[0].rounds for t in r) > 7  # depth 3 has 7 splits
    right = got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert got.count() == learning._vectors(spark, "/root/testdata/sf0.001").count() and right > 0.95
