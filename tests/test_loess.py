"""Loess by distinct x against its definition, a row at a time."""

import numpy as np
import pytest

from tessel.operators import stats


def plain(x, y, k):
    place, out = np.lexsort((np.arange(len(x)), x)).argsort(), []
    for i in range(len(x)):
        d = np.abs(x - x[i])
        near = np.lexsort((place, d))[:k]
        m, u = d[near].max(), x[near] - x[i]
        w = (1 - (d[near] / m) ** 3) ** 3 if m > 0 else np.ones(k)
        t = np.where(np.isnan(y[near]), 0.0, y[near])
        s0, s1, s2, t0, t1 = w.sum(), w @ u, w @ (u * u), w @ t, (w * u) @ t
        det = s0 * s2 - s1 * s1
        out.append((s2 * t0 - s1 * t1) / det if abs(det) > 1e-9 else t0 / s0)
    return out


@pytest.mark.parametrize("distinct", [2, 9, 60, 1000])
def test_loess(spark, distinct):
    rng = np.random.default_rng(distinct)
    x, y = np.sort(rng.random(distinct) ** 3)[rng.integers(0, distinct, 150)] * 50, rng.normal(size=150)
    x[:70 if distinct == 9 else 0] = 3.0
    y[::17] = np.nan
    df = spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    fitted = stats.loess(df, "id", "x", "y")
    assert "Generate" not in fitted._jdf.queryExecution().executedPlan().toString()  # no row is sent to blocks of others
    got = [r["fit"] for r in fitted.orderBy("id").collect()]
    assert np.allclose(got, plain(x, y, 45), rtol=1e-7, atol=1e-9)
