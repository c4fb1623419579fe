"""Small frames with ties, constants, missing and odd values."""

import json

import pytest
from pyspark.sql import functions as F

from tessel.functions import boxes, geo, vector
from tessel.operators import metrics, models, prep, split, stats, text
from tessel.sources import files


def test_entry_imports():
    import __spark_entry__ as e

    assert "summary_lineitem" in e.queries()


def test_require_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "a double")
    with pytest.raises(ValueError):
        stats.require_finite(df, ["a"])
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "a double")
    assert stats.require_finite(nan, ["a"], allow_nan=True) is nan
    with pytest.raises(ValueError):
        stats.require_finite(nan, ["a"])


def test_constant_columns(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "a double")
    assert [r.a for r in prep.standard_scale(df, ["a"]).collect()] == [7.0, 7.0]
    assert [r.a for r in prep.minmax_scale(df, ["a"]).collect()] == [0.0, 0.0]
    assert [r.a for r in prep.robust_scale(df, ["a"]).collect()] == [0.0, 0.0]
    assert [(r.bin, r.n) for r in stats.histogram(df, "a", 5).collect()] == [(0, 2)]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (4.0, None)], "a double, b double")
    got = prep.impute(df, ["a", "b"], "mean").collect()
    assert got[1].a == pytest.approx(8 / 3) and got[0].b == 0.0
    ties = spark.createDataFrame([(2.0,), (1.0,), (None,)], "a double")
    assert prep.impute(ties, ["a"], "mode").collect()[2].a == 1.0


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    with pytest.raises(Exception, match="unknown label"):
        prep.label_encode(df, "s", prep.label_index(df.where("s = 'a'"), "s")).collect()


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2), (2, 1, 0.8), (3, 1, 0.9)], "k long, t int, s double")
    assert metrics.auc(df, "t", "s", "k").first()[0] == pytest.approx(1.0)
    assert metrics.average_precision(df, "t", "s", "k").first()[0] == pytest.approx(1.0)


def test_folds_partition_rows(spark):
    df = spark.range(23)
    got = split.k_fold(df, ["id"], 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == [4, 4, 4, 4, 7]
    assert split.holdout(df, ["id"], 0.001).where("is_test").count() == 1


def test_tokenize(spark):
    df = spark.createDataFrame([("  'Été,' don't  (x) -- 42! ",)], "t string")
    assert df.select(text.tokenize(F.col("t"))).first()[0] == ["été", "don't", "x", "42"]
    assert df.select(text.ngrams(F.array(F.lit("a"), F.lit("b")), 1, 3)).first()[0] == ["a", "b", "a b"]


def test_vectors_and_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(vector.squared_l2(a, b), vector.l1(a, b), vector.cosine_similarity(a, b), vector.quantize_int8(a)["scale"]).first()
    assert list(r) == [25.0, 7.0, 0.0, 1.0]
    box = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    assert box.select(boxes.iou(F.col("a"), F.col("b"))).first()[0] == pytest.approx(25 / 175)


def test_models(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    got = {r.term: r.coef for r in models.least_squares(df, ["x"], "y").collect()}
    assert got["x"] == pytest.approx(2) and got["intercept"] == pytest.approx(1)
    sep = spark.createDataFrame([(i, float(i), int(i >= 10)) for i in range(20)], "k long, x double, y int")
    model = models.gaussian_nb(sep, ["x"], "y")
    right = models.gaussian_predict(sep, "k", ["x"], model).join(sep, "k").where(F.col("class") == F.col("y")).count()
    assert right == 20


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("f1,f2,target\n1,4,a\n2,x,b\n3,6,a\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "TARGET").orderBy("row_id").collect()
    assert [r.target_code for r in rows] == [0, 1, 0] and rows[1].f2 != rows[1].f2
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square, "properties": {"n": 1}}, {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}, "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    got = files.read_geojson(spark, str(tmp_path / "g.json"))
    assert [r.type for r in got.collect()] == ["Polygon", "Point"]
    area = got.where("type = 'Polygon'").select(geo.area(files.polygon(F.col("coordinates")))).first()[0]
    assert area == pytest.approx(4.0)
