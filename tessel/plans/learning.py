"""Queries of clusterings, boosted trees, calibration and model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import geo
from tessel.operators import boost, cluster, metrics, selection, split
from tessel.plans.catalogue import query
from tessel.plans.tabular import rounded
from tessel.runtime import input_table

_VECTORS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_LONG = "l AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), m AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM l GROUP BY 1, 2)"


def _vectors(spark, d):
    return input_table(spark, d, "embeddings")


@query("calinski_harabasz", f"WITH {_VECTORS}, {_LONG}, b AS (SELECT *, n * pow(m - sum(n * m) OVER p / sum(n) OVER p, 2) AS b FROM m WINDOW p AS (PARTITION BY i)), c AS (SELECT label, max(n) AS n, sum(b) AS b, sum(ss) AS w FROM b GROUP BY 1) SELECT round(sum(b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM c")
def _(spark, d):
    return rounded(cluster.calinski_harabasz(_vectors(spark, d), "label", "embedding"))


@query("davies_bouldin", f"WITH {_VECTORS}, {_LONG}, c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT label, c, avg(list_distance(v, c)) AS s FROM e JOIN c USING (label) GROUP BY 1, 2) SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)")
def _(spark, d):
    return rounded(cluster.davies_bouldin(_vectors(spark, d), "label", "embedding"))


@query("silhouette_samples", f"WITH {_VECTORS}, p AS (SELECT q.vec_id, q.label AS ql, t.label AS tl, avg(list_distance(q.v, t.v)) AS d FROM e q JOIN e t ON q.vec_id <> t.vec_id GROUP BY 1, 2, 3), r AS (SELECT vec_id, coalesce(max(d) FILTER (ql = tl), 0) AS a, min(d) FILTER (ql <> tl) AS b FROM p GROUP BY 1) SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM r")
def _(spark, d):
    return rounded(cluster.silhouette(_vectors(spark, d), "vec_id", "label", "embedding"))


@query("silhouette_score", f"WITH {_VECTORS}, p AS (SELECT q.vec_id, q.label AS ql, t.label AS tl, avg(list_distance(q.v, t.v)) AS d FROM e q JOIN e t ON q.vec_id <> t.vec_id GROUP BY 1, 2, 3), r AS (SELECT vec_id, coalesce(max(d) FILTER (ql = tl), 0) AS a, min(d) FILTER (ql <> tl) AS b FROM p GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM r")
def _(spark, d):
    return rounded(cluster.silhouette(_vectors(spark, d), "vec_id", "label", "embedding").agg(F.avg("silhouette").alias("silhouette")))


@query("dbscan")
def _(spark, d):
    return cluster.dbscan(_vectors(spark, d), "vec_id", "embedding", 0.9, 4)


@query("agglomerative_ward")
def _(spark, d):
    return cluster.agglomerative(_vectors(spark, d), "vec_id", "embedding", 10)


_POINTS = "p AS (SELECT c_custkey, (c_custkey * 37 % 360) - 180.0 AS lon, (c_custkey * 53 % 170) - 85.0 AS lat FROM customer)"


def _points(spark, d):
    k = F.col("c_custkey")
    return input_table(spark, d, "customer").select(k, (k * 37 % 360 - 180.0).alias("lon"), (k * 53 % 170 - 85.0).alias("lat"))


def _xy(spark, d, f):
    return rounded(_points(spark, d).select("c_custkey", f(F.col("lon"), F.col("lat")).alias("p")).select("c_custkey", "p.*"), 9)


_P2 = "pow(radians(lat), 2)"


@query("natural_earth", f"WITH {_POINTS} SELECT c_custkey, round(radians(lon) * (0.8707 + {_P2} * (-0.131979 + {_P2} * (-0.013791 + {_P2} * (0.003971 + {_P2} * -0.001529)))), 9) AS x, round(radians(lat) * (1.007226 + {_P2} * (0.015085 + {_P2} * (-0.044475 + {_P2} * (0.028874 + {_P2} * -0.005916)))), 9) AS y FROM p")
def _(spark, d):
    return _xy(spark, d, geo.natural_earth)


def _conic_sql(p1: float, p2: float, l0: float, p0: float, k: float, dx: float, dy: float) -> tuple[str, str]:
    n = f"((sin(radians({p1})) + sin(radians({p2}))) / 2)"
    c = f"(pow(cos(radians({p1})), 2) + 2 * {n} * sin(radians({p1})))"
    rho = f"(sqrt(abs({c} - 2 * {n} * sin(radians(lat)))) / {n})"
    rho0 = f"(sqrt(abs({c} - 2 * {n} * sin(radians({p0})))) / {n})"
    t = f"({n} * (radians(lon) - radians({l0})))"
    return f"{rho} * sin({t}) * {k} + {dx}", f"({rho0} - {rho} * cos({t})) * {k} + {dy}"


_ALBERS = {k: _conic_sql(*v) for k, v in geo.ALBERS_USA.items()}
_ROUTED = [f"round(CASE WHEN lat < 25 AND lon > -180 AND lon < -154 THEN {_ALBERS['hawaii'][i]} WHEN lat > 50 AND (lon < -130 OR lon > 170) THEN {_ALBERS['alaska'][i]} ELSE {_ALBERS['lower48'][i]} END, 9)" for i in (0, 1)]


@query("albers_usa", f"WITH {_POINTS} SELECT c_custkey, {_ROUTED[0]} AS x, {_ROUTED[1]} AS y FROM p")
def _(spark, d):
    return _xy(spark, d, geo.albers_usa)


for _name, _to, _back in (("mercator_inverse", geo.mercator, geo.mercator_inverse), ("equal_earth_inverse", geo.equal_earth, geo.equal_earth_inverse), ("natural_earth_inverse", geo.natural_earth, geo.natural_earth_inverse)):

    @query(_name, f"WITH {_POINTS} SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
    def _(spark, d, to=_to, back=_back):
        p = _points(spark, d).select("c_custkey", to(F.col("lon"), F.col("lat")).alias("p"))
        p = p.select("c_custkey", back(F.col("p.x"), F.col("p.y")).alias("p")).select("c_custkey", "p.*")
        return p.select("c_custkey", *((F.round(c, 6) + 0.0).alias(c) for c in ("lon", "lat")))


_F = ["p_size", "p_partkey", "brand"]


def _parts(spark, d):
    p = input_table(spark, d, "part").withColumn("brand", F.crc32("p_brand") % 100).withColumn("big", (F.col("p_retailprice") > 1400).cast("int"))
    return split.stratified_k_fold(p.select("p_partkey", "p_size", "brand", "p_retailprice", "big"), ["p_partkey"], 3, "big")


def _boost_fit(**parameters):
    def fit(train):
        return boost.hist_boost(train, _F, "big", "log", **({"rounds": 3, "depth": 3} | parameters)).predict

    return fit


def _label(fit):
    """A fit whose prediction is 1 or 0 in place of a probability."""
    def again(train):
        p = fit(train)
        return lambda rows: p(rows).withColumn("prediction", (F.col("prediction") >= 0.5).cast("double"))

    return again


@query("hist_gbt_regression")
def _(spark, d):
    m = boost.hist_boost(_parts(spark, d), _F, "p_retailprice", rounds=5, depth=4)
    return rounded(metrics.regression(m.predict(_parts(spark, d)), "p_retailprice", "prediction"), 4)


@query("hist_gbt_multiclass")
def _(spark, d):
    e = _vectors(spark, d).select("vec_id", "label", *(F.col("embedding")[i].alias(f"x{i}") for i in range(64)))
    m = boost.hist_boost(e, [f"x{i}" for i in range(64)], "label", "softmax")
    return m.predict(e).select("vec_id", "label", "prediction")


@query("isolation_forest")
def _(spark, d):
    return boost.isolation_forest(input_table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("grid_search")
def _(spark, d):
    found = selection.search(_parts(spark, d), lambda **p: _label(_boost_fit(**p)), {"rounds": [1], "depth": [1, 2]}, selection.accuracy("big"), k=3)
    return spark.createDataFrame([(str(p), s) for p, s in found], "parameters string, score double")


@query("cross_val_predict")
def _(spark, d):
    return selection.cross_val_predict(_parts(spark, d), _boost_fit(rounds=1), k=3).select("p_partkey", "fold", "big", "prediction")


@query("calibrated_platt")
def _(spark, d):
    return selection.calibrated(_parts(spark, d), _boost_fit(rounds=1, depth=2), "big", "platt", 3)(_parts(spark, d)).select("p_partkey", "prediction")


@query("calibrated_isotonic")
def _(spark, d):
    return selection.calibrated(_parts(spark, d), _boost_fit(rounds=1, depth=2), "big", "isotonic", 3)(_parts(spark, d)).select("p_partkey", "prediction")


@query("stacking")
def _(spark, d):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    bases = [selection.spark_ml(DecisionTreeClassifier(labelCol="big", maxDepth=4), _F), selection.spark_ml(LogisticRegression(labelCol="big"), _F)]
    final = lambda columns: selection.spark_ml(LogisticRegression(labelCol="big"), columns)
    return selection.stacking(_parts(spark, d), bases, final, "p_partkey", 3)(_parts(spark, d)).select("p_partkey", "prediction")


@query("linear_svc")
def _(spark, d):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    e = _vectors(spark, d).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    fit = selection.spark_ml(OneVsRest(classifier=LinearSVC(), labelCol="label", parallelism=4), [f"x{i}" for i in range(64)])
    return fit(e)(e).select("vec_id", "label", "prediction")


@query("mlp_classifier")
def _(spark, d):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    fit = selection.spark_ml(MultilayerPerceptronClassifier(labelCol="big", layers=[3, 8, 2], seed=1, maxIter=30), _F)
    return fit(_parts(spark, d))(_parts(spark, d)).select("p_partkey", "prediction")


@query("linear_svr")
def _(spark, d):
    return rounded(selection.linear_svr(_parts(spark, d), ["p_size", "p_partkey"], "p_retailprice", rounds=20), 4)


@query("permutation_importance")
def _(spark, d):
    parts = _parts(spark, d)
    return selection.permutation_importance(parts, "p_partkey", _label(_boost_fit(rounds=1, depth=2))(parts), _F, selection.accuracy("big"), repeats=2)
