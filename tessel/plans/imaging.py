"""Queries of images and charts' layouts. Images are made of part: 64 parts each, 8 by 8, by size."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import geo
from tessel.operators import images, treemap
from tessel.plans.catalogue import query
from tessel.plans.tabular import rounded
from tessel.runtime import input_table

_PX = "px AS (SELECT p_partkey // 64 AS image, (p_partkey % 64 // 8)::INT AS y, (p_partkey % 8)::INT AS x, p_size::DOUBLE AS value FROM part WHERE p_partkey // 64 IN (SELECT p_partkey // 64 FROM part GROUP BY 1 HAVING count(*) = 64))"
#: Each pixel's neighbours at (dx, dy), the nearest pixel beyond the border.
_NEAR = f"WITH {_PX}, o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS i) b), near AS (SELECT c.image, c.y, c.x, o.dx, o.dy, n.value FROM px c, o JOIN px n ON n.image = c.image AND n.y = greatest(0, least(7, c.y + o.dy)) AND n.x = greatest(0, least(7, c.x + o.dx)))"


def _pixels(spark, d):
    p = input_table(spark, d, "part").select(F.expr("p_partkey div 64").alias("image"), F.expr("CAST(p_partkey % 64 div 8 AS int)").alias("y"), F.expr("CAST(p_partkey % 8 AS int)").alias("x"), F.col("p_size").cast("double").alias("value"))
    full = p.groupBy("image").count().where("count = 64").select("image")
    return p.join(full, "image", "left_semi")


def _near_sql(value: str) -> str:
    return f"{_NEAR} SELECT image, y, x, round({value}, 4) AS value FROM near GROUP BY image, y, x"


_FILTERS = (
    ("image_sobel_x", "sum(value * dx * (2 - abs(dy)))", images.sobel_x, {}),
    ("image_sobel_y", "sum(value * dy * (2 - abs(dx)))", images.sobel_y, {}),
    ("image_scharr_x", "sum(value * dx * CASE WHEN dy = 0 THEN 10 ELSE 3 END)", images.scharr_x, {}),
    ("image_gradient_magnitude", "sqrt(pow(sum(value * dx * (2 - abs(dy))), 2) + pow(sum(value * dy * (2 - abs(dx))), 2))", images.gradient_magnitude, {}),
    ("image_box", "avg(value)", images.box, {"radius": 1}),
    ("image_median", "median(value)", images.median, {"radius": 1}),
    ("image_erode", "min(value)", images.erode, {}),
    ("image_dilate_cross", "max(CASE WHEN dx = 0 OR dy = 0 THEN value END)", images.dilate, {"shape": "cross"}),
    ("image_morph_gradient", "max(value) - min(value)", images.morphological_gradient, {}),
)
for _name, _value, _f, _parameters in _FILTERS:

    @query(_name, _near_sql(_value))
    def _(spark, d, f=_f, parameters=_parameters):
        out = images.filtered(images.to_images(_pixels(spark, d), "image"), f, **parameters)
        return images.pixel_table(out, "image").select("image", "y", "x", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


@query("image_integral", f"WITH {_PX} SELECT a.image, a.y, a.x, sum(b.value) AS total FROM px a JOIN px b ON a.image = b.image AND b.y <= a.y AND b.x <= a.x GROUP BY 1, 2, 3")
def _(spark, d):
    return images.integral(_pixels(spark, d)).select("image", "y", "x", "total")


@query("image_components")
def _(spark, d):
    bright = _pixels(spark, d).withColumn("value", (F.col("value") > 25).cast("double"))
    return images.components(images.to_images(bright, "image"), "image")


#: The cells' areas are the shares; their places are tested on a small chart.
@query("treemap_mktsegment", "SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (PARTITION BY c_nationkey), 6) AS area FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2")
def _(spark, d):
    s = input_table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    return treemap.treemap(s, ["c_nationkey"], "c_mktsegment", "v").select("c_nationkey", "c_mktsegment", F.round(F.col("w") * F.col("h"), 6).alias("area"))


@query("geo_simplify")
def _(spark, d):
    lines = input_table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y")))).alias("line"))
    return lines.select("o_custkey", F.size("line").alias("points"), F.size(geo.simplify(F.col("line"), 50.0)).alias("kept"))


@query("albers_inverse", "SELECT c_custkey, (c_custkey % 60 - 125)::DOUBLE AS lon, (c_nationkey + 25)::DOUBLE AS lat FROM customer")
def _(spark, d):
    c = input_table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 60 - 125).cast("double").alias("lon"), (F.col("c_nationkey") + 25).cast("double").alias("lat"))
    on = geo.ALBERS_USA["lower48"]
    p = c.select("c_custkey", geo.albers(F.col("lon"), F.col("lat"), *on).alias("p"))
    return rounded(p.select("c_custkey", geo.albers_inverse(F.col("p.x"), F.col("p.y"), *on).alias("q")).select("c_custkey", "q.*"))
