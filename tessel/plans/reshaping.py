"""Queries over composed transformers and sparse matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import compose, sparse
from tessel.plans.catalogue import query
from tessel.plans.tabular import rounded
from tessel.runtime import input_table

_HOLES = "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 2 THEN l_discount END AS l_discount FROM lineitem)"


def _lineitem(spark, d):
    return input_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("l_discount"))


@query(
    "pipeline_impute_scale",
    f"""WITH f AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b FROM {_HOLES} WHERE l_linenumber <= 3),
    i AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, coalesce(l_discount, b)::DOUBLE AS c FROM {_HOLES}, f),
    s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(c) AS mc, stddev_pop(c) AS sc FROM i WHERE l_linenumber <= 3)
    SELECT l_orderkey, l_linenumber, round((q - mq) / sq, 6) AS l_quantity, round((c - mc) / sc, 6) AS l_discount FROM i, s WHERE l_linenumber > 3""",
)
def _(spark, d):
    """Fitted on the first three lines of orders, applied to the others."""
    li, two = _lineitem(spark, d).drop("l_extendedprice"), ("l_quantity", "l_discount")
    fitted = compose.Pipeline((compose.Impute("mean", two), compose.Linear("standard", two))).fit(li.where("l_linenumber <= 3"))
    return rounded(fitted.transform(li.where("l_linenumber > 3")))


@query(
    "pipeline_inverse",
    "SELECT l_orderkey, l_linenumber, round(l_quantity::DOUBLE, 6) AS l_quantity, round(l_extendedprice::DOUBLE, 6) AS l_extendedprice FROM lineitem WHERE l_linenumber > 3",
)
def _(spark, d):
    li, two = _lineitem(spark, d).drop("l_discount"), ("l_quantity", "l_extendedprice")
    fitted = compose.Pipeline((compose.Linear("robust", two), compose.Linear("minmax", two))).fit(li.where("l_linenumber <= 3"))
    return rounded(fitted.inverse(fitted.transform(li.where("l_linenumber > 3"))))


@query(
    "column_transformer",
    """WITH f AS (SELECT min(l_quantity) AS lo, max(l_quantity) - min(l_quantity) AS r, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS i FROM lineitem WHERE l_linenumber <= 3)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / i, 6) AS l_extendedprice, round((l_quantity - lo) / r, 6) AS l_quantity, (l_returnflag = 'N')::INT::DOUBLE AS "l_returnflag_N", (l_returnflag = 'R')::INT::DOUBLE AS "l_returnflag_R" FROM lineitem, f""",
)
def _(spark, d):
    li = input_table(spark, d, "lineitem")
    steps = (compose.Linear("robust", ("l_extendedprice",)), compose.Linear("minmax", ("l_quantity",)), compose.OneHot(("l_returnflag",), drop="first", unknown="ignore"))
    return rounded(compose.ColumnTransformer(steps, ("l_orderkey", "l_linenumber")).fit(li.where("l_linenumber <= 3")).transform(li))


_CELLS = "(SELECT o_custkey AS row, (o_orderkey % 40)::INT AS col, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _cells(spark, d, by_row=False):
    o = input_table(spark, d, "orders")
    return sparse.merged(o.select(F.col("o_custkey").alias("row"), (F.col("o_orderkey") % 40).cast("int").alias("col"), F.col("o_totalprice").alias("value")), by_row)


@query("sparse_triplets_merged", f"SELECT row, col, round(value, 4) AS value FROM {_CELLS}")
def _(spark, d):
    return rounded(_cells(spark, d), 4)


@query(
    "sparse_from_dense",
    "SELECT row, col, round(value, 6) AS value FROM (SELECT l_orderkey * 10 + l_linenumber AS row, unnest([0, 1, 2])::INT AS col, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS value FROM lineitem) WHERE value <> 0",
)
def _(spark, d):
    li = input_table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(sparse.triplets(li, "k", ["l_quantity", "l_discount", "l_tax"]))


@query("sparse_to_dense", f"SELECT row, round(coalesce(sum(value) FILTER (col = 0), 0), 4) AS a, round(coalesce(sum(value) FILTER (col = 1), 0), 4) AS b FROM {_CELLS} GROUP BY row")
def _(spark, d):
    return rounded(sparse.dense(_cells(spark, d), ["a", "b"]), 4)


@query("sparse_density", f"SELECT count(*) AS nnz, round(count(*) / (SELECT count(*) * 40 FROM customer), 9) AS density FROM {_CELLS}")
def _(spark, d):
    return rounded(sparse.density(_cells(spark, d), input_table(spark, d, "customer").count(), 40), 9)


@query("sparse_matvec", f"SELECT row, round(sum(value * (col + 1)), 3) AS y FROM {_CELLS} GROUP BY row")
def _(spark, d):
    return rounded(sparse.times_vector(_cells(spark, d), spark.range(40).select(F.col("id").cast("int").alias("col"), (F.col("id") + 1).cast("double").alias("x"))), 3)


@query(
    "sparse_scale",
    f"WITH c AS (SELECT * FROM {_CELLS}), n AS (SELECT count(*) AS n FROM customer), f AS (SELECT col, sqrt(sum(value * value) / n - pow(sum(value) / n, 2)) AS std FROM c, n GROUP BY col, n) SELECT row, col, round(value / std, 6) AS value FROM c JOIN f USING (col) WHERE std > 1e-12",
)
def _(spark, d):
    return rounded(sparse.scale(_cells(spark, d), input_table(spark, d, "customer").count()))


@query(
    "sparse_distances",
    f"""WITH c AS (SELECT row, col, value / 1e5 AS value FROM {_CELLS}), k AS (SELECT DISTINCT a.row AS q, b.row AS t FROM c a JOIN c b ON a.col = b.col AND a.row <> b.row WHERE a.row % 100 = 0),
    w AS (SELECT k.q, k.t, g.col, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM k CROSS JOIN (SELECT unnest(range(40))::INT AS col) g LEFT JOIN c a ON a.row = k.q AND a.col = g.col LEFT JOIN c b ON b.row = k.t AND b.col = g.col)
    SELECT q, t, round(sum(a * b), 8) AS dot, round(sqrt(sum((a - b) * (a - b))), 8) AS l2, round(sum(abs(a - b)), 8) AS l1, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 8) AS cosine FROM w GROUP BY q, t""",
)
def _(spark, d):
    c = _cells(spark, d, by_row=True).withColumn("value", F.col("value") / 1e5)
    return rounded(sparse.distances(c.where("row % 100 = 0"), c), 8)


@query("row_gather", "WITH p AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_custkey AS c_custkey FROM orders) SELECT pos, c_custkey, c_name FROM p JOIN customer USING (c_custkey)")
def _(spark, d):
    from tessel.operators.order import numbered

    o = numbered(input_table(spark, d, "orders").select("o_orderdate", "o_orderkey", F.col("o_custkey").alias("c_custkey")), ["o_orderdate", "o_orderkey"], "pos")
    return sparse.gather(input_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", o.select("pos", "c_custkey"))


@query("mask_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def _(spark, d):
    return sparse.masked(input_table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], [True, False, True], ["l_orderkey", "l_linenumber"])


@query("coord_flip", "SELECT o_orderkey, o_totalprice AS x, o_custkey AS y FROM orders")
def _(spark, d):
    return sparse.flipped(input_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("x"), F.col("o_totalprice").alias("y")))


@query("pivot_layers", "SELECT l_linenumber, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 4) AS \"A\", round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 4) AS \"N\", round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS \"R\" FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(sparse.layers(input_table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"]), 4)


@query("class_counts", "SELECT class, n, count(*) OVER () AS classes FROM (SELECT trunc(l_quantity)::INT AS class, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, d):
    return sparse.class_counts(input_table(spark, d, "lineitem"), "l_quantity")


@query("class_weights_custom", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM lineitem")
def _(spark, d):
    return sparse.custom_weights(input_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", {1: 0.5, 2: 2.0})
