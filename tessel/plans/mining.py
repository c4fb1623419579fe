"""Queries over texts, vectors, shapes, boxes and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessel.functions import boxes, geo, vector
from tessel.operators import models, neighbors, text
from tessel.plans.catalogue import query
from tessel.plans.tabular import rounded
from tessel.runtime import input_table
from tessel.streaming import partial_fit

_TOKENS = r"list_filter(list_transform(regexp_split_to_array(text, '[\s\x{0b}\x{85}\p{Z}]+'), lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda w: w <> '')"
_TERMS = f"t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY 1, 2)"


def _docs(spark, d):
    return input_table(spark, d, "documents")


@query("tokenize_counts", f"WITH {_TERMS} SELECT doc_id, sum(n)::BIGINT AS tokens, count(*) AS terms FROM c GROUP BY 1")
def _(spark, d):
    return text.term_counts(_docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("terms"))


@query("ngrams_bigram", f"WITH {_TERMS}, b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM t) SELECT term, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return text.term_counts(_docs(spark, d), "doc_id", "text", 2, 2).groupBy("term").agg(F.sum("n").alias("n")).where("n >= 3")


@query("vocab_min_df", f"WITH {_TERMS}, v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= ceil(0.8 * (SELECT count(*) FROM documents))) SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM v")
def _(spark, d):
    return text.vocabulary(text.term_counts(_docs(spark, d), "doc_id", "text"), _docs(spark, d).count(), 5, 0.8)


@query("count_vectors", f"WITH {_TERMS}, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT term, sum(n) AS s FROM c GROUP BY 1 ORDER BY s DESC, term LIMIT 500)) SELECT doc_id, idx, n FROM c JOIN v USING (term)")
def _(spark, d):
    c = text.term_counts(_docs(spark, d), "doc_id", "text")
    v = text.vocabulary(c, _docs(spark, d).count(), max_features=500)
    return c.join(F.broadcast(v), "term").select("doc_id", "idx", "n")


for _name, _sub, _norm in (("tfidf_l2", False, "l2"), ("tfidf_l1", False, "l1"), ("tfidf_sublinear", True, "l2")):
    _tf = "1 + ln(n)" if _sub else "n"
    _by = "sqrt(sum(w * w) OVER p)" if _norm == "l2" else "sum(abs(w)) OVER p"

    @query(_name, f"WITH {_TERMS}, f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT doc_id, term, ({_tf}) * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1) AS w FROM c JOIN f USING (term)) SELECT doc_id, term, round(w / {_by}, 7) AS weight FROM w WINDOW p AS (PARTITION BY doc_id)")
    def _(spark, d, sub=_sub, norm=_norm):
        c = text.term_counts(_docs(spark, d), "doc_id", "text")
        return rounded(text.tfidf(c, "doc_id", _docs(spark, d).count(), True, sub, norm), 7)


@query("multinomial_nb", f"WITH {_TERMS}, o AS (SELECT quality AS class, term, sum(n) AS n FROM c JOIN labels USING (doc_id) GROUP BY 1, 2), g AS (SELECT class, term, coalesce(n, 0) AS n FROM (SELECT DISTINCT term FROM o) CROSS JOIN (SELECT DISTINCT class FROM o) LEFT JOIN o USING (class, term)) SELECT class, term, round(ln((n + 1) / (sum(n) OVER p + count(*) OVER p)), 7) AS log_prob FROM g WINDOW p AS (PARTITION BY class)")
def _(spark, d):
    return rounded(models.multinomial_nb(text.term_counts(_docs(spark, d), "doc_id", "text"), input_table(spark, d, "labels"), "doc_id", "quality"), 7)


_SETS = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS q, t.vec_id AS t, {d} AS d FROM e q, e t WHERE q.vec_id % 100 = 0{s})"
_D = {"l2": "list_distance(q.e, t.e)", "cosine": "1 - list_cosine_similarity(q.e, t.e)", "l1": "list_sum(list_transform(list_zip(q.e, t.e), lambda z: abs(z[1] - z[2])))"}
_NEAR = _SETS + ", n AS (SELECT q, t, d, row_number() OVER (PARTITION BY q ORDER BY d, t) AS place FROM p QUALIFY place <= {k})"


def _emb(spark, d):
    e = input_table(spark, d, "embeddings")
    return e, e.where("vec_id % 100 = 0")


for _m, _name in (("cosine", "cosine_topk"), ("l2", "l2_topk"), ("l1", "manhattan_topk")):

    @query(_name, _NEAR.format(d=_D[_m], s=" AND q.vec_id <> t.vec_id", k=5) + " SELECT q, t, round(d, 7) AS d, place FROM n")
    def _(spark, d, m=_m):
        e, q = _emb(spark, d)
        return rounded(neighbors.nearest(q, e, "vec_id", "embedding", 5, m), 7)


@query("knn_classify", _NEAR.format(d=_D["l2"], s=" AND q.vec_id <> t.vec_id", k=5) + ", v AS (SELECT q, label, count(*) AS v FROM n JOIN embeddings ON vec_id = t GROUP BY 1, 2) SELECT q, label FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, label) = 1")
def _(spark, d):
    e, q = _emb(spark, d)
    return neighbors.classify(neighbors.nearest(q, e, "vec_id", "embedding", 5), e, "vec_id", "label")


@query("knn_regress", _NEAR.format(d=_D["l2"], s=" AND q.vec_id <> t.vec_id", k=5) + " SELECT q, round(sum(label / d) / sum(1 / d), 7) AS y FROM n JOIN embeddings ON vec_id = t GROUP BY 1")
def _(spark, d):
    e, q = _emb(spark, d)
    return rounded(neighbors.regress(neighbors.nearest(q, e, "vec_id", "embedding", 5), e, "vec_id", "label", True), 7)


@query("ratio_test", _NEAR.format(d=_D["l2"], s=" AND q.vec_id <> t.vec_id", k=2) + " SELECT q, max(t) FILTER (place = 1) AS t FROM n GROUP BY q HAVING max(d) FILTER (place = 2) > 1e-12 AND max(d) FILTER (place = 1) / max(d) FILTER (place = 2) < 0.98")
def _(spark, d):
    e, q = _emb(spark, d)
    return neighbors.ratio_test(neighbors.nearest(q, e, "vec_id", "embedding", 2), 0.98)


@query("cross_check", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS t, list_distance(a.e, b.e) AS d FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), x AS (SELECT q, t FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, t) = 1), y AS (SELECT q, t FROM p QUALIFY row_number() OVER (PARTITION BY t ORDER BY d, q) = 1) SELECT q, t FROM x JOIN y USING (q, t)")
def _(spark, d):
    """Every hundredth vector against all others, and each of those found against all of the hundredths."""
    e, a = _emb(spark, d)
    there = neighbors.nearest(a, e, "vec_id", "embedding", 1)
    found = e.join(there.select(F.col("t").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return neighbors.cross_check(there, neighbors.nearest(found, a, "vec_id", "embedding", 1))


@query("eps_neighbours_dbscan_core", _SETS.format(d=_D["l2"], s="") + " SELECT q, count(*) AS n, count(*) >= 3 AS core FROM p WHERE d <= 1.2 GROUP BY 1")
def _(spark, d):
    e, q = _emb(spark, d)
    return neighbors.dbscan_core(q, e, "vec_id", "embedding", 1.2, 3)


def _fixed(e):
    return e.where("vec_id < 10").select(F.col("vec_id").cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("center"))


_ASSIGN = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), a AS (SELECT x.vec_id, x.e, c.vec_id AS cluster, list_distance(x.e, c.e) AS d FROM e x, e c WHERE c.vec_id < 10 QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.e, c.e), c.vec_id) = 1)"


@query("kmeans_assign_fixed", f"{_ASSIGN} SELECT vec_id, cluster::INTEGER AS cluster, round(d * d, 7) AS d2 FROM a")
def _(spark, d):
    e = input_table(spark, d, "embeddings")
    return rounded(neighbors.assign(e, "vec_id", "embedding", _fixed(e)), 7)


@query("kmeans_transform", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT x.vec_id, c.vec_id::INTEGER AS cluster, round(list_distance(x.e, c.e), 7) AS d FROM e x, e c WHERE c.vec_id < 10")
def _(spark, d):
    e = input_table(spark, d, "embeddings")
    return rounded(neighbors.center_distances(e, "vec_id", "embedding", _fixed(e)), 7)


@query("kmeans_one_lloyd", f"{_ASSIGN}, l AS (SELECT cluster, unnest(range(0, len(e))) AS i, unnest(e) AS v FROM a) SELECT cluster::INTEGER AS cluster, i::INTEGER AS i, round(avg(v), 7) AS m FROM l GROUP BY 1, 2")
def _(spark, d):
    e = input_table(spark, d, "embeddings")
    return rounded(models.lloyd(e, "vec_id", "embedding", _fixed(e)).select("cluster", F.posexplode("center").alias("i", "m")), 7)


@query("kmeans_fit")
def _(spark, d):
    return models.kmeans(input_table(spark, d, "embeddings"), "vec_id", "embedding", 10).select("cluster", "n", F.round(vector.norm(F.col("center")), 6).alias("norm"))


@query("quantize_int8", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS s FROM e) SELECT vec_id, round(s, 9) AS scale, list_sum(list_transform(e, lambda x: round(x / s)))::BIGINT AS total FROM s")
def _(spark, d):
    q = input_table(spark, d, "embeddings").select("vec_id", vector.quantize_int8(F.col("embedding")).alias("x"))
    return q.select("vec_id", F.round("x.scale", 9).alias("scale"), F.aggregate("x.q", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("topk_softmax", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, unnest(range(0, len(e))) AS i, unnest(e) AS x FROM e), p AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, i::INTEGER AS i, round(p, 8) AS p FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) <= 3")
def _(spark, d):
    e = input_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    s = e.select("vec_id", F.transform("e", lambda x: F.exp(x)).alias("x")).select("vec_id", "x", vector.total(F.col("x")).alias("t"))
    top = F.slice(F.sort_array(F.transform("x", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 3)
    return s.select("vec_id", "t", F.explode(top).alias("z")).select("vec_id", F.col("z.i").alias("i"), F.round(-F.col("z.x") / F.col("t"), 8).alias("p"))


@query("top_p", "WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT event_type, n / sum(n) OVER () AS p FROM s), c AS (SELECT *, sum(p) OVER (ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT event_type, round(p, 8) AS p FROM c WHERE c - p < 0.7")
def _(spark, d):
    from pyspark.sql import Window

    s = input_table(spark, d, "events").groupBy("event_type").count()
    p = s.select("event_type", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("p"))
    upto = F.sum("p").over(Window.orderBy(F.desc("p"), "event_type").rowsBetween(Window.unboundedPreceding, 0))
    return rounded(p.withColumn("c", upto).where("c - p < 0.7").select("event_type", "p"), 8)


_BOX = "(SELECT s_suppkey AS id, s_nationkey AS img, (s_suppkey * 37 % 50)::DOUBLE AS x0, (s_suppkey * 53 % 50)::DOUBLE AS y0, (s_suppkey * 37 % 50 + 20 + s_suppkey % 7)::DOUBLE AS x1, (s_suppkey * 53 % 50 + 20)::DOUBLE AS y1, s_acctbal AS score FROM supplier)"


def _boxes(spark, d):
    k = F.col("s_suppkey")
    return input_table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("img"), (k * 37 % 50).cast("double").alias("x0"), (k * 53 % 50).cast("double").alias("y0"), (k * 37 % 50 + 20 + k % 7).cast("double").alias("x1"), (k * 53 % 50 + 20).cast("double").alias("y1"), F.col("s_acctbal").alias("score"))


@query("iou_pairs", f"WITH b AS (SELECT * FROM {_BOX}), p AS (SELECT a.id AS a, b.id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.img = b.img AND a.id < b.id) SELECT a, b, round(i / (s - i), 8) AS iou FROM p")
def _(spark, d):
    b = _boxes(spark, d).select("id", "img", F.struct("x0", "y0", "x1", "y1").alias("box"))
    j = b.alias("l").join(b.alias("r"), (F.col("l.img") == F.col("r.img")) & (F.col("l.id") < F.col("r.id")))
    return j.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(boxes.iou(F.col("l.box"), F.col("r.box")), 8).alias("iou"))


@query("nms")
def _(spark, d):
    return boxes.non_maximum(_boxes(spark, d), ["img"], 0.3).select("id", "img", "score")




def _shapes(spark, d):
    k, n = F.col("c_custkey") % 90, F.col("c_nationkey") * 2
    ring = F.array(*(F.struct((k + x).alias("x"), (n + y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 1.0), (5.0, 4.0), (1.0, 3.0))))
    hole = F.array(*(F.struct((k + x).alias("x"), (n + y).alias("y")) for x, y in ((2.0, 1.5), (3.0, 1.5), (3.0, 2.0), (2.0, 2.0))))
    return input_table(spark, d, "customer").select("c_custkey", k.alias("k"), n.alias("n"), ring.alias("ring"), F.array(ring, hole).alias("polygon"))


#: The quadrilateral has area 11 and its hole 0.5; its centroid lies at (2.5, 2) from the corner by symmetry.
@query("geo_area_centroid_bounds", "SELECT c_custkey, 10.5::DOUBLE AS area, round(c_custkey % 90 + 2.5, 6) AS cx, round(c_nationkey * 2 + 2.0, 6) AS cy, (c_custkey % 90 + 5.0)::DOUBLE AS x1, (c_nationkey * 2 + 4.0)::DOUBLE AS y1 FROM customer")
def _(spark, d):
    s = _shapes(spark, d)
    c, b = geo.centroid(F.col("ring")), geo.bounds(F.col("ring"))
    return s.select("c_custkey", F.round(geo.area(F.col("polygon")), 6).alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), b["x1"].alias("x1"), b["y1"].alias("y1"))


@query("geo_point_in_polygon", "WITH p AS (SELECT c_custkey, (c_custkey * 7 % 60) / 10.0 AS x, (c_custkey * 11 % 50) / 10.0 AS y FROM customer) SELECT c_custkey, (y >= x / 4 AND y >= 3 * (x - 4) + 1 AND y < 3 + (x - 1) / 4 AND y < 3 * x) AND NOT (x >= 2 AND x < 3 AND y >= 1.5 AND y < 2) AS inside FROM p WHERE abs(y - x / 4) > 1e-6 AND abs(y - 3 * (x - 4) - 1) > 1e-6 AND abs(y - 3 - (x - 1) / 4) > 1e-6 AND abs(y - 3 * x) > 1e-6")
def _(spark, d):
    x, y = (F.col("c_custkey") * 7 % 60) / 10.0, (F.col("c_custkey") * 11 % 50) / 10.0
    s = _shapes(spark, d).select("c_custkey", (F.col("k") + x).alias("x"), (F.col("n") + y).alias("y"), "polygon", x.alias("u"), y.alias("v"))
    s = s.where("abs(v - u / 4) > 1e-6 AND abs(v - 3 * (u - 4) - 1) > 1e-6 AND abs(v - 3 - (u - 1) / 4) > 1e-6 AND abs(v - 3 * u) > 1e-6")
    return s.select("c_custkey", geo.point_in_polygon(F.col("x"), F.col("y"), F.col("polygon")).alias("inside"))


@query("mercator", "SELECT c_custkey, round(radians(c_custkey % 360 - 180), 8) AS x, round(ln(tan(radians(greatest(-85.051129, least(85.051129, c_nationkey * 8 - 95))) / 2 + 0.7853981633974483)), 8) AS y FROM customer")
def _(spark, d):
    m = geo.mercator((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_nationkey") * 8 - 95).cast("double"))
    return rounded(input_table(spark, d, "customer").select("c_custkey", m["x"].alias("x"), m["y"].alias("y")), 8)


@query("equal_earth", "WITH t AS (SELECT c_custkey, radians(c_custkey % 360 - 180) AS l, asin(sqrt(3) / 2 * sin(radians(c_nationkey * 7 - 84))) AS t FROM customer) SELECT c_custkey, round(2 * sqrt(3) * l * cos(t) / (3 * (9 * 0.003796 * pow(t, 8) + 7 * 0.000893 * pow(t, 6) + 3 * -0.081106 * t * t + 1.340264)), 8) AS x, round(t * (0.003796 * pow(t, 8) + 0.000893 * pow(t, 6) - 0.081106 * t * t + 1.340264), 8) AS y FROM t")
def _(spark, d):
    m = geo.equal_earth((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_nationkey") * 7 - 84).cast("double"))
    return rounded(input_table(spark, d, "customer").select("c_custkey", m["x"].alias("x"), m["y"].alias("y")), 8)


@query("stream_nb", "SELECT event_type AS class, count(*) AS n, round(sum(value), 4) AS s, round(sum(value * value), 3) AS ss FROM events GROUP BY 1")
def _(spark, d):
    schema = input_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    held = partial_fit.run_available(partial_fit.class_moments(stream, "event_type", "value"), f"nb_{uuid.uuid4().hex[:8]}")
    return held.select("class", "n", F.round("s", 4).alias("s"), F.round("ss", 3).alias("ss"))


@query("stream_minibatch_kmeans")
def _(spark, d):
    e = input_table(spark, d, "embeddings")
    m = partial_fit.MiniBatchKMeans([list(r["center"]) for r in _fixed(e).orderBy("cluster").collect()])
    for part in range(2):
        m.partial_fit(e.where(F.col("vec_id") % 2 == part), "vec_id", "embedding")
    return spark.createDataFrame([(i, n) for i, n in enumerate(m.counts)], "cluster int, n long")
