"""Places and running sums against plain Python, with ties, nulls, clashing names and a group that holds most rows."""

from itertools import accumulate

import pytest

from pyspark.sql import functions as F

from tessel.operators import metrics, order, split


@pytest.mark.parametrize("by", [None, "k"])
def test_running(spark, by):
    rows = [(i, None if i % 7 == 0 else "a" if i % 3 else "b", float(i * 37 % 11), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, x double, v0 int").withColumns({"g": F.lit(1), "part": F.lit(2), "row": F.lit(3), "o0": F.lit(4)})
    got = {r["id"]: (r["t"], r["t_all"]) for r in order.running(df, [order.falling("x"), "id"], {"t": F.col("v0").cast("long")}, by).collect()}
    want = {}
    for k in {r[1] for r in rows} if by else {0}:
        mine = sorted((r for r in rows if not by or r[1] == k), key=lambda r: (-r[2], r[0]))
        upto = list(accumulate(r[3] for r in mine))
        want |= {r[0]: (u, upto[-1]) for r, u in zip(mine, upto, strict=True)}
    assert got == want


def test_empty_and_small(spark):
    none = spark.createDataFrame([], "id int, y int, s double")
    assert order.numbered(none, ["id"]).collect() == []
    assert metrics.auc(none, "y", "s", "id").first()["auc"] is None
    assert [r["i"] for r in metrics.roc(none, "y", "s", "id").collect()] == [0]
    three = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r["fold"] for r in split.k_fold(three, ["id"], 5).collect()] == [4, 4, 4]
    one_class = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.2), (3, None, 0.9)], "id int, y int, s double")
    assert metrics.auc(one_class, "y", "s", "id").first()["auc"] is None
    assert metrics.average_precision(one_class, "y", "s", "id").first()["average_precision"] == 1.0


def test_repeats_differ(spark):
    f = split.repeated_k_fold(spark.range(100), "id", 4, 3).toPandas()
    assert (f.groupby(["repeat", "fold"]).size() == 25).all() and not f.duplicated(["repeat", "id"]).any()
    assert f.pivot(index="id", columns="repeat", values="fold").nunique(axis=1).max() > 1
