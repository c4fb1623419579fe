"""Composed transformers on tables with missing, constant and unknown values."""

import pytest
from pyspark.errors import PySparkException

from tessel.operators import compose, sparse


def test_fit_and_transform_on_different_tables(spark):
    a = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0), (5.0, 5.0, float("nan"))], "x double, k double, h double")
    b = spark.createDataFrame([(7.0, 9.0, None)], "x double, k double, h double")
    for kind, x, k in (("standard", 4 / (8 / 3) ** 0.5, 9.0), ("minmax", 1.5, 4.0), ("robust", 2.0, 4.0)):
        fitted = compose.Linear(kind, ("x", "k")).fit(a)
        r = fitted.transform(b).first()
        assert r.x == pytest.approx(x) and r.k == pytest.approx(k) and fitted.inverse(fitted.transform(b)).first()[:2] == pytest.approx((7.0, 9.0))
    assert compose.Impute("mean", ("h",)).fit(a).transform(b).first().h == 2.0
    assert compose.Impute("median", ("h",)).fit(b).transform(b).first().h == 0.0


def test_one_hot_unknown(spark):
    a, b = spark.createDataFrame([("u",), ("v",)], "c string"), spark.createDataFrame([("w",), (None,)], "c string")
    assert compose.OneHot(("c",)).fit(a).transform(a).orderBy("c_u").collect() == [(0.0, 1.0), (1.0, 0.0)]
    assert compose.OneHot(("c",), drop="binary").fit(a).transform(a).columns == ["c_v"]
    assert {tuple(r) for r in compose.OneHot(("c",), unknown="ignore").fit(a).transform(b).collect()} == {(0.0, 0.0)}
    with pytest.raises(PySparkException):
        compose.OneHot(("c",)).fit(a).transform(b).collect()
    with pytest.raises(ValueError, match="over 1"):
        compose.OneHot(("c",), most=1).fit(a)


def test_pipeline_and_columns(spark):
    a = spark.createDataFrame([(1, None, "p"), (2, 4.0, "q"), (3, 8.0, "p")], "id int, x double, g string")
    fitted = compose.Pipeline((compose.Impute("mean", ("x",)), compose.Linear("minmax", ("x",)))).fit(a)
    assert [r.x for r in fitted.transform(a).orderBy("id").collect()] == [0.5, 0.0, 1.0]
    with pytest.raises(ValueError, match="inverse"):
        fitted.inverse(a)
    out = compose.ColumnTransformer((compose.OneHot(("g",)), compose.Linear("minmax", ("x",))), ("id",)).fit(a).transform(a)
    assert out.columns == ["id", "g_p", "g_q", "x"]


def test_gather_repeats_and_keeps_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    p = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 9)], "pos int, k int")
    assert [(r.pos, r.v) for r in sparse.gather(df, "k", p).orderBy("pos").collect()] == [(0, "b"), (1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="mask"):
        sparse.masked(df, ["k", "v"], [True])
