"""Queries over tables of numbers: statistics, charts, transformers, splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import scale
from tessel.operators import metrics, models, prep, split, stats
from tessel.plans.catalogue import query
from tessel.runtime import input_table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _unpivot_sql(table: str, columns: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS feature, {c}::DOUBLE AS value FROM {table}" for c in columns)


_HOLES = "(SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS l_discount FROM lineitem)"


def _holes(spark, d):
    li = input_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("l_tax"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("l_discount"))


def _summary_sql(source: str) -> str:
    return f"SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM ({source}) WHERE value IS NOT NULL GROUP BY feature"


@query("summary_lineitem", _summary_sql(_unpivot_sql("lineitem", NUMBERS)))
def _(spark, d):
    return rounded(stats.summary(input_table(spark, d, "lineitem"), NUMBERS))


@query("summary_with_missing", _summary_sql(_unpivot_sql(_HOLES, ["l_tax", "l_discount"])))
def _(spark, d):
    return rounded(stats.summary(_holes(spark, d), ["l_tax", "l_discount"]))


_AGG_SQL = {"count": "count(o_totalprice)::DOUBLE", "sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)", "min": "min(o_totalprice)", "max": "max(o_totalprice)"}
for _f, _e in _AGG_SQL.items():

    @query(f"agg_{_f}_by_category", f"SELECT (row_number() OVER (ORDER BY first) - 1)::DOUBLE AS x, category, round(y, 2) AS y FROM (SELECT o_orderpriority AS category, {_e} AS y, min(o_orderkey) AS first FROM orders GROUP BY 1)")
    def _(spark, d, f=_f):
        return rounded(stats.aggregate_by(input_table(spark, d, "orders"), "o_orderpriority", "o_totalprice", f, "o_orderkey"), 2)


_V = "l_extendedprice"
_STURGES = f"CASE WHEN count({_V}) <= 1 THEN 1 ELSE ceil(log2(count({_V}))) + 1 END"
_ROOT = f"pow(count({_V})::DOUBLE, -1.0 / 3)"
_IQR = f"(quantile_cont({_V}, 0.75) - quantile_cont({_V}, 0.25))"
for _name, _rule, _k in (
    ("hist_bins10", 10, "10"),
    ("hist_sturges", "sturges", _STURGES),
    ("hist_scott", "scott", f"ceil((max({_V}) - min({_V})) / (3.5 * stddev_pop({_V}) * {_ROOT}))"),
    ("hist_fd", "fd", f"ceil((max({_V}) - min({_V})) / (2 * {_IQR} * {_ROOT}))"),
):

    @query(
        _name,
        f"""WITH f AS (SELECT min({_V}) AS lo, max({_V}) AS hi, ({_k})::INTEGER AS k FROM lineitem),
        g AS (SELECT lo, (hi - lo) / k AS w, unnest(range(0, k)) AS bin FROM f),
        c AS (SELECT least(floor(({_V} - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS n FROM lineitem, f GROUP BY 1)
        SELECT g.bin::BIGINT AS bin, round(lo + (g.bin + 0.5) * w, 4) AS center, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.bin = g.bin""",
    )
    def _(spark, d, rule=_rule):
        return rounded(stats.histogram(input_table(spark, d, "lineitem"), _V, rule), 4)


_FENCES = "WITH q AS (SELECT l_returnflag AS category, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"


@query("boxplot_by_flag", f"{_FENCES} SELECT category, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN lo AND hi) AS whisker_lo, max(l_extendedprice) FILTER (l_extendedprice BETWEEN lo AND hi) AS whisker_hi, count(*) FILTER (l_extendedprice NOT BETWEEN lo AND hi) AS n_outliers FROM lineitem JOIN f ON category = l_returnflag GROUP BY category, q1, median, q3")
def _(spark, d):
    return rounded(stats.boxplot(input_table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("boxplot_outliers", _FENCES.replace("l_returnflag", "o_orderpriority").replace("l_extendedprice", "o_totalprice * o_totalprice").replace("lineitem", "orders") + " SELECT o_orderkey, category, o_totalprice * o_totalprice AS value FROM orders JOIN f ON category = o_orderpriority WHERE o_totalprice * o_totalprice NOT BETWEEN lo AND hi")
def _(spark, d):
    o = input_table(spark, d, "orders").withColumn("v", F.col("o_totalprice") * F.col("o_totalprice"))
    return stats.boxplot_outliers(o, "o_orderpriority", "v", "o_orderkey")


_STACK = """WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, o_orderstatus AS layer, sum(CASE WHEN o_orderpriority LIKE '1%' THEN -o_totalprice ELSE o_totalprice END) AS y FROM orders GROUP BY 1, 2),
g AS (SELECT x, layer, coalesce(y, 0.0) AS y FROM (SELECT DISTINCT x FROM s) CROSS JOIN (SELECT DISTINCT layer FROM s) LEFT JOIN s USING (x, layer)),
b AS (SELECT x, layer, y, CASE WHEN y >= 0 THEN coalesce(sum(greatest(y, 0)) OVER w, 0) ELSE coalesce(sum(least(y, 0)) OVER w, 0) END AS base FROM g WINDOW w AS (PARTITION BY x ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _monthly(spark, d):
    o = input_table(spark, d, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("x"), F.col("o_orderstatus").alias("layer"), F.when(F.col("o_orderpriority").startswith("1"), -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("y"))


@query("stack_by_month", f"{_STACK} SELECT x, layer, round(y, 2) AS y, round(base, 2) AS base, round(base + y, 2) AS top FROM b")
def _(spark, d):
    return rounded(stats.stack(_monthly(spark, d), "x", "layer", "y"), 2)


@query("fill_by_month", f"{_STACK}, t AS (SELECT x, layer, base, base + y AS top, last_value(base + y) OVER (PARTITION BY x ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM b) SELECT x, layer, round(CASE WHEN abs(l) > 1e-12 THEN base / l ELSE 0 END, 6) + 0.0 AS base, round(CASE WHEN abs(l) > 1e-12 THEN top / l ELSE 0 END, 6) + 0.0 AS top FROM t")
def _(spark, d):
    return rounded(stats.fill(_monthly(spark, d), "x", "layer", "y"))


@query("dodge_offsets", "SELECT layer, round((row_number() OVER (ORDER BY layer) - 1 - (count(*) OVER () - 1) / 2) * 0.8 / count(*) OVER (), 6) AS \"offset\" FROM (SELECT DISTINCT o_orderstatus AS layer FROM orders)")
def _(spark, d):
    return rounded(stats.dodge(input_table(spark, d, "orders"), "o_orderstatus"))


@query("pie_share_treemap_order", "WITH s AS (SELECT p_brand AS category, sum(p_retailprice) AS y FROM part GROUP BY 1) SELECT category, round(y / sum(y) OVER (), 8) AS share, row_number() OVER (ORDER BY round(y, 4) DESC, category) AS place FROM s")
def _(spark, d):
    p = input_table(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 4).alias("y"))
    return rounded(stats.shares(p, "p_brand", "y"), 8)


@query("data_bounds_padded", "SELECT min(l_extendedprice) - 0.05 * (max(l_extendedprice) - min(l_extendedprice)) AS lo, max(l_extendedprice) + 0.05 * (max(l_extendedprice) - min(l_extendedprice)) AS hi FROM lineitem")
def _(spark, d):
    return stats.data_bounds(input_table(spark, d, "lineitem"), "l_extendedprice")


@query("facet_bounds_free", "SELECT p_brand AS facet, min(p_size) - 0.05 * (max(p_size) - min(p_size)) AS lo, max(p_size) + 0.05 * (max(p_size) - min(p_size)) AS hi FROM part GROUP BY 1")
def _(spark, d):
    return stats.data_bounds(input_table(spark, d, "part"), "p_size", "p_brand")


@query(
    "loess_size_price",
    """WITH b AS (SELECT p_partkey AS id, p_retailprice AS x, p_size::DOUBLE AS y, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS r FROM part),
    k AS (SELECT greatest(2, least(count(*), ceil(0.3 * count(*))))::BIGINT AS k FROM b),
    n AS (SELECT * FROM (SELECT a.id, a.x, c.x AS xj, c.y AS yj, abs(a.x - c.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - c.x), c.r) AS p FROM b a, b c) WHERE p <= (SELECT k FROM k)),
    m AS (SELECT *, max(d) OVER (PARTITION BY id) AS m, xj - x AS u FROM n),
    w AS (SELECT id, x, u, yj, CASE WHEN m > 0 THEN pow(1 - pow(least(d / m, 1), 3), 3) ELSE 1 END AS w FROM m),
    s AS (SELECT id, x, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * yj) AS t0, sum(w * u * yj) AS t1 FROM w GROUP BY id, x)
    SELECT id, x, round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-9 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 6) AS fit FROM s""",
)
def _(spark, d):
    return stats.loess(input_table(spark, d, "part"), "p_partkey", "p_retailprice", "p_size").select("id", "x", F.round("fit", 6).alias("fit"))


_STEP = "WITH b AS (SELECT p_brand AS k, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), r AS (SELECT *, (hi - lo) / 5 AS raw, pow(10.0, floor(log10((hi - lo) / 5))) AS p FROM b), s AS (SELECT k, lo, hi, p * CASE WHEN raw / p >= sqrt(50) THEN 10 WHEN raw / p >= sqrt(10) THEN 5 WHEN raw / p >= sqrt(2) THEN 2 ELSE 1 END AS step FROM r)"


@query("nice_ticks", f"{_STEP} SELECT k, round(step, 6) AS step, round(floor(lo / step) * step, 6) AS nice_lo, round(ceil(hi / step) * step, 6) AS nice_hi, (floor(hi / step) - ceil(lo / step) + 1)::BIGINT AS n_ticks FROM s")
def _(spark, d):
    b = input_table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    n = scale.nice(F.col("lo"), F.col("hi"))
    return rounded(b.select("k", scale.tick_step(F.col("lo"), F.col("hi")).alias("step"), n["lo"].alias("nice_lo"), n["hi"].alias("nice_hi"), F.size(scale.ticks(F.col("lo"), F.col("hi"))).cast("long").alias("n_ticks")))


for _kind, _e in (("linear", "{}"), ("log", "ln({})"), ("sqrt", "sqrt({})"), ("symlog", "ln(1 + {})")):

    @query(f"scale_map_{_kind}", f"SELECT o_orderkey, round(({_e.format('o_totalprice')} - {_e.format('lo')}) / ({_e.format('hi')} - {_e.format('lo')}) * 100, 6) AS y FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
    def _(spark, d, kind=_kind):
        o = input_table(spark, d, "orders")
        b = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
        return rounded(o.crossJoin(F.broadcast(b)).select("o_orderkey", scale.scale_map(kind, F.col("o_totalprice"), F.col("lo"), F.col("hi"), 0.0, 100.0).alias("y")))


@query("format_number", "SELECT c_custkey, CASE WHEN abs(x) < 1e-12 THEN '0' WHEN abs(x) >= 1e9 THEN printf('%.1fB', x / 1e9) WHEN abs(x) >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN abs(x) >= 1e4 THEN format('{:,}', round_even(x, 0)::BIGINT) WHEN abs(x) >= 100 THEN printf('%.1f', x) WHEN abs(x) >= 1 THEN printf('%.2f', x) ELSE printf('%.4f', x) END AS label FROM (SELECT c_custkey, (c_custkey * c_custkey * 1024.0 + 0.25) / 256 AS x FROM customer)")
def _(spark, d):
    c = input_table(spark, d, "customer")
    return c.select("c_custkey", scale.format_number((F.col("c_custkey") * F.col("c_custkey") * 1024.0 + 0.25) / 256).alias("label"))


def _keyed(spark, d):
    o = input_table(spark, d, "orders")
    return o.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"), F.lit(7.0).alias("flat"))


_C = ["o_totalprice", "o_custkey", "flat"]
_KEYED = "(SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey, 7.0::DOUBLE AS flat FROM orders)"


def _scaled_sql(fit: str, expr: str) -> str:
    return f"SELECT o_orderkey, {', '.join(f'round({expr.format(c=c)}, 6) AS {c}' for c in _C)} FROM {_KEYED}, (SELECT {', '.join(fit.format(c=c) for c in _C)} FROM {_KEYED})"


@query("standard_scale", _scaled_sql("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}", "CASE WHEN s_{c} > 1e-12 THEN ({c} - m_{c}) / s_{c} ELSE {c} END"))
def _(spark, d):
    return rounded(prep.standard_scale(_keyed(spark, d), _C))


@query("inverse_standard", f"SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(o_custkey, 4) AS o_custkey, round(flat, 4) AS flat FROM {_KEYED}")
def _(spark, d):
    df = _keyed(spark, d)
    fit = prep.standard_fit(df, _C)
    return rounded(prep.standard_invert(prep.standard_scale(df, _C, fit), _C, fit), 4)


@query("minmax_scale", _scaled_sql("min({c}) AS a_{c}, max({c}) AS b_{c}", "CASE WHEN b_{c} - a_{c} > 1e-12 THEN ({c} - a_{c}) / (b_{c} - a_{c}) ELSE 0 END"))
def _(spark, d):
    return rounded(prep.minmax_scale(_keyed(spark, d), _C))


@query("robust_scale", _scaled_sql("quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r_{c}", "({c} - m_{c}) / CASE WHEN r_{c} > 1e-12 THEN r_{c} ELSE 1 END"))
def _(spark, d):
    return rounded(prep.robust_scale(_keyed(spark, d), _C))


for _n, _e in (("l1", "o_totalprice + o_custkey + flat"), ("l2", "sqrt(o_totalprice * o_totalprice + o_custkey * o_custkey + flat * flat)"), ("max", "greatest(o_totalprice, o_custkey, flat)")):

    @query(f"normalize_{_n}", f"SELECT o_orderkey, {', '.join(f'round({c} / ({_e}), 9) AS {c}' for c in _C)} FROM {_KEYED}")
    def _(spark, d, n=_n):
        return rounded(prep.normalize(_keyed(spark, d), _C, n), 9)


for _n, _e in (("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)"), ("mode", "(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM " + _HOLES + " WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"), ("constant", "-1.0")):
    _i = [f"coalesce({c}, ({_e.format(c=c)}))" if _n in ("mode", "constant") else f"coalesce({c}, (SELECT {_e.format(c=c)} FROM {_HOLES}))" for c in ("l_tax", "l_discount")]

    @query(f"impute_{_n}", f"SELECT l_linenumber, round(sum({_i[0]}), 4) AS tax, round(sum({_i[1]}), 4) AS discount, count(*) AS n FROM {_HOLES} GROUP BY 1")
    def _(spark, d, n=_n):
        i = prep.impute(_holes(spark, d), ["l_tax", "l_discount"], n, -1.0)
        return rounded(i.groupBy("l_linenumber").agg(F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"), F.count("*").alias("n")), 4)


@query("label_encode_first_seen", "SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1")
def _(spark, d):
    return prep.label_index(input_table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query("label_encode_sorted", "SELECT c_custkey, code FROM customer JOIN (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer GROUP BY 1) ON s = c_mktsegment")
def _(spark, d):
    c = input_table(spark, d, "customer")
    return prep.label_encode(c, "c_mktsegment", prep.label_index(c, "c_mktsegment")).select("c_custkey", "code")


for _n, _first in (("none", 0), ("first", 1), ("binary", 0)):

    @query(f"one_hot_{_n}", "SELECT s_suppkey, " + ", ".join(f"(s_suppkey % 4 = {i})::INTEGER::DOUBLE AS k_{i}" for i in range(_first, 4)) + " FROM supplier")
    def _(spark, d, n=_n):
        s = input_table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).cast("double").alias("k"))
        return prep.one_hot(s, "k", n)


@query("poly_degree2", "SELECT p_partkey, 1.0::DOUBLE AS bias, s AS s, r AS r, s * s AS s_x_s, s * r AS s_x_r, r * r AS r_x_r FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part)")
def _(spark, d):
    p = input_table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    return prep.polynomial(p, ["s", "r"])


@query("variance_threshold", f"SELECT feature, round(var_pop(value), 4) AS variance, var_pop(value) > 0.001 AS kept FROM ({_unpivot_sql('lineitem', NUMBERS)}) GROUP BY feature")
def _(spark, d):
    return rounded(prep.variances(input_table(spark, d, "lineitem"), NUMBERS, 0.001), 4)


_FC = f"""WITH u AS ({_unpivot_sql('lineitem', NUMBERS, 'l_returnflag AS t, ')}), p AS (SELECT feature, t, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM u GROUP BY 1, 2),
g AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2) AS b, sum(w) AS w FROM p GROUP BY 1), f AS (SELECT feature, (b / (k - 1)) / (w / (n - k)) AS f FROM g)"""


@query("f_classif", f"{_FC} SELECT feature, round(f, 5) AS f FROM f")
def _(spark, d):
    return rounded(prep.f_classif(input_table(spark, d, "lineitem"), NUMBERS, "l_returnflag"), 5)


@query("select_k_best", f"{_FC} SELECT feature, round(f, 5) AS f, row_number() OVER (ORDER BY f DESC, feature) AS place FROM f QUALIFY place <= 2")
def _(spark, d):
    return rounded(prep.select_k_best(prep.f_classif(input_table(spark, d, "lineitem"), NUMBERS, "l_returnflag"), 2), 5)


@query("feature_bins", "WITH e AS (SELECT list_distinct([" + ", ".join(f"quantile_cont(v, {i / 8})" for i in range(1, 8)) + f"]) AS e FROM (SELECT DISTINCT l_tax AS v FROM {_HOLES} WHERE l_tax IS NOT NULL)) SELECT CASE WHEN l_tax IS NULL THEN 0 ELSE len(list_filter(e, lambda x: x <= l_tax)) + 1 END AS bin, count(*) AS n FROM {_HOLES}, e GROUP BY 1")
def _(spark, d):
    return prep.quantile_bins(_holes(spark, d), "l_tax", 8).groupBy("bin").agg(F.count("*").alias("n"))


@query("pca_cov", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]))
def _(spark, d):
    return rounded(prep.covariance(input_table(spark, d, "lineitem"), NUMBERS), 4)


@query("pca_components")
def _(spark, d):
    return prep.pca(input_table(spark, d, "lineitem").select(*NUMBERS), NUMBERS, 2)


@query("class_weights_balanced", "SELECT quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 8) AS weight FROM labels GROUP BY 1")
def _(spark, d):
    return rounded(prep.class_weights(input_table(spark, d, "labels"), "quality"), 8)


_T = "greatest(least(round(count(*) OVER ({w}) * 0.2), count(*) OVER ({w}) - 1), 1)"


@query("holdout_split", f"SELECT event_id, row_number() OVER (ORDER BY event_id) <= {_T.format(w='')} AS is_test FROM events")
def _(spark, d):
    return split.holdout(input_table(spark, d, "events"), ["event_id"], 0.2).select("event_id", "is_test")


@query("stratified_split", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= {_T.format(w='PARTITION BY event_type')} AS is_test FROM events")
def _(spark, d):
    return split.holdout(input_table(spark, d, "events"), ["event_id"], 0.2, "event_type").select("event_id", "is_test")


@query("kfold", "SELECT event_id, least((row_number() OVER (ORDER BY event_id) - 1) // (count(*) OVER () // 7), 6) AS fold FROM events")
def _(spark, d):
    return split.k_fold(input_table(spark, d, "events"), ["event_id"], 7).select("event_id", "fold")


@query("repeated_kfold", "SELECT repeat, fold, CASE WHEN fold = 6 THEN n - 6 * (n // 7) ELSE n // 7 END AS n, 0::BIGINT AS twice FROM (SELECT count(*) AS n FROM events), (SELECT unnest([0, 1, 2])::BIGINT AS repeat), (SELECT unnest([0, 1, 2, 3, 4, 5, 6])::BIGINT AS fold)")
def _(spark, d):
    """Sizes of the folds, and how many of a fold's rows are in it more than once."""
    f = split.repeated_k_fold(input_table(spark, d, "events").select("event_id"), "event_id", 7, 3)
    once = f.groupBy("repeat", "fold", "event_id").agg(F.count("*").alias("c"))
    return once.groupBy("repeat", "fold").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 1).cast("long")).alias("twice"))


@query("stratified_kfold", "SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels")
def _(spark, d):
    return split.stratified_k_fold(input_table(spark, d, "labels"), ["doc_id"], 5, "quality").select("doc_id", "fold")


@query("group_kfold", "SELECT event_id, fold FROM events JOIN (SELECT user_id AS u, (row_number() OVER (ORDER BY min(event_id)) - 1) % 5 AS fold FROM events GROUP BY 1) ON u = user_id")
def _(spark, d):
    return split.group_k_fold(input_table(spark, d, "events"), "event_id", 5, "user_id").select("event_id", "fold")


@query("time_series_split", "SELECT fold, fold * c AS train_end, CASE WHEN fold = 5 THEN n ELSE (fold + 1) * c END AS test_end FROM (SELECT count(*) AS n, count(*) // 6 AS c, unnest([1, 2, 3, 4, 5])::BIGINT AS fold FROM events)")
def _(spark, d):
    return split.time_series_split(input_table(spark, d, "events"), ["ts", "event_id"], 5)


@query("fold_class_counts", "SELECT fold, quality, count(*) AS n FROM (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels) GROUP BY 1, 2")
def _(spark, d):
    return split.stratified_k_fold(input_table(spark, d, "labels"), ["doc_id"], 5, "quality").groupBy("fold", "quality").agg(F.count("*").alias("n"))


_PRED = "(SELECT doc_id, quality AS t, (n_chars > 1500)::INTEGER AS p, n_chars AS score, n_chars / (n_chars + 2000.0) AS prob FROM labels JOIN documents USING (doc_id))"


def _pred(spark, d):
    j = input_table(spark, d, "labels").join(input_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("t"), (F.col("n_chars") > 1500).cast("int").alias("p"), F.col("n_chars").alias("score"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("prob"))


_CM = f"WITH c AS (SELECT t::BIGINT AS t, p::BIGINT AS p, count(*) AS n FROM {_PRED} GROUP BY 1, 2), k AS (SELECT DISTINCT unnest([t, p]) AS k FROM c)"
_PC = f"{_CM}, g AS (SELECT k, coalesce(sum(n) FILTER (t = k AND p = k), 0) AS tp, coalesce(sum(n) FILTER (t = k), 0) AS s, coalesce(sum(n) FILTER (p = k), 0) AS m FROM k, c GROUP BY 1), r AS (SELECT k, CASE WHEN m > 0 THEN tp / m ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re, s FROM g), f AS (SELECT k, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, s FROM r)"


@query("confusion", f"{_CM} SELECT a.k AS t, b.k AS p, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.t = a.k AND c.p = b.k")
def _(spark, d):
    return metrics.confusion(_pred(spark, d), "t", "p")


@query("report", f"{_PC} SELECT k::VARCHAR AS class, round(pr, 8) AS precision, round(re, 8) AS recall, round(f1, 8) AS f1, s::BIGINT AS support FROM f UNION ALL SELECT 'macro', round(avg(pr), 8), round(avg(re), 8), round(avg(f1), 8), sum(s)::BIGINT FROM f UNION ALL SELECT 'weighted', round(sum(pr * s) / sum(s), 8), round(sum(re * s) / sum(s), 8), round(sum(f1 * s) / sum(s), 8), sum(s)::BIGINT FROM f")
def _(spark, d):
    return rounded(metrics.report(_pred(spark, d), "t", "p"), 8)


@query("accuracy_balanced_kappa", f"{_PC}, o AS (SELECT avg((t = p)::INTEGER) AS po FROM {_PRED}), e AS (SELECT sum(s * m) / pow(sum(s), 2) AS pe FROM g) SELECT round(po, 8) AS accuracy, (SELECT round(avg(re), 8) FROM f) AS balanced_accuracy, round((po - pe) / (1 - pe), 8) AS kappa FROM o, e")
def _(spark, d):
    return rounded(metrics.scores(_pred(spark, d), "t", "p"), 8)


@query("log_loss", f"SELECT round(-avg(CASE WHEN t = 1 THEN ln(prob) ELSE ln(1 - prob) END), 8) AS log_loss FROM {_PRED}")
def _(spark, d):
    return rounded(metrics.log_loss(_pred(spark, d), "t", "prob"), 8)


_ROC = f"WITH r AS (SELECT row_number() OVER w AS i, sum(t) OVER w AS tp, sum(1 - t) OVER w AS fp, sum(t) OVER () AS pp, sum(1 - t) OVER () AS nn FROM {_PRED} WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 1.0::DOUBLE AS pr UNION ALL SELECT i, fp / nn, tp / pp, tp / i FROM r)"


@query("roc_curve", f"{_ROC} SELECT i, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM c")
def _(spark, d):
    return rounded(metrics.roc(_pred(spark, d), "t", "score", "doc_id"), 9)


@query("roc_auc", f"{_ROC} SELECT round(sum(a), 8) AS auc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY i)) * (tpr + lag(tpr) OVER (ORDER BY i)) / 2 AS a FROM c)")
def _(spark, d):
    return rounded(metrics.auc(_pred(spark, d), "t", "score", "doc_id"), 8)


@query("pr_curve", f"{_ROC} SELECT i, round(tpr, 9) AS recall, round(pr, 9) AS precision FROM c")
def _(spark, d):
    return rounded(metrics.precision_recall(_pred(spark, d), "t", "score", "doc_id"), 9)


@query("avg_precision", f"{_ROC} SELECT round(sum(a), 8) AS average_precision FROM (SELECT (tpr - lag(tpr) OVER (ORDER BY i)) * (pr + lag(pr) OVER (ORDER BY i)) / 2 AS a FROM c)")
def _(spark, d):
    return rounded(metrics.average_precision(_pred(spark, d), "t", "score", "doc_id"), 8)


@query("regression_metrics", "WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS e FROM lineitem) SELECT round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2, round(1 - var_pop(e) / var_pop(y), 8) AS explained_variance, round(avg(abs(e / y)), 8) AS mape FROM e")
def _(spark, d):
    li = input_table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("p"))
    m = metrics.regression(li, "l_extendedprice", "p")
    digits = {"mse": 2, "rmse": 4, "mae": 4}
    return m.select(*(F.round(c, digits.get(c, 8)).alias(c) for c in m.columns))


@query("adjusted_rand", "WITH l AS (SELECT label AS a, vec_id % 10 AS b FROM embeddings), c AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM (SELECT count(*) AS n FROM l GROUP BY a, b)), i AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT count(*) AS n FROM l GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT count(*) AS n FROM l GROUP BY b)) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 8) AS ari FROM c, i, j")
def _(spark, d):
    e = input_table(spark, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("b"))
    return rounded(metrics.adjusted_rand(e, "label", "b"), 8)


@query("gaussian_nb", f"WITH u AS ({_unpivot_sql('lineitem', NUMBERS, 'l_returnflag AS class, ')}), g AS (SELECT class, feature, count(*) AS n, avg(value) AS mean, var_pop(value) AS var FROM u GROUP BY 1, 2) SELECT class, feature, round(n / sum(n) OVER (PARTITION BY feature), 8) AS prior, round(mean, 6) AS mean, round(var + 1e-9 * max(var) OVER (), 4) AS var FROM g")
def _(spark, d):
    m = models.gaussian_nb(input_table(spark, d, "lineitem"), NUMBERS, "l_returnflag")
    return m.select("class", "feature", F.round("prior", 8).alias("prior"), F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("bernoulli_nb", f"WITH u AS ({_unpivot_sql('lineitem', NUMBERS, 'l_returnflag AS class, ')}) SELECT class, feature, round((sum((value > 0.05)::INTEGER) + 1) / (count(*) + 2), 8) AS p FROM u GROUP BY 1, 2")
def _(spark, d):
    return rounded(models.bernoulli_nb(input_table(spark, d, "lineitem"), NUMBERS, "l_returnflag", 0.05), 8)


@query("ols_1d", "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 5) AS coef FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 5) FROM lineitem")
def _(spark, d):
    return rounded(models.least_squares(input_table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"), 5)


@query("ridge_1d", "WITH r AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1000) AS b, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem) SELECT 'l_quantity' AS term, round(b, 5) AS coef FROM r UNION ALL SELECT 'intercept', round(y - b * x, 5) FROM r")
def _(spark, d):
    return rounded(models.least_squares(input_table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 1000.0), 5)


@query("ols_2d", "WITH c AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, var_pop(l_tax) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_tax, l_extendedprice) AS q, avg(l_quantity) AS mx, avg(l_tax) AS mt, avg(l_extendedprice) AS my FROM lineitem), s AS (SELECT (p * c - b * q) / (a * c - b * b) AS u, (a * q - b * p) / (a * c - b * b) AS v, mx, mt, my FROM c) SELECT 'l_quantity' AS term, round(u, 4) AS coef FROM s UNION ALL SELECT 'l_tax', round(v, 4) FROM s UNION ALL SELECT 'intercept', round(my - u * mx - v * mt, 4) FROM s")
def _(spark, d):
    return rounded(models.least_squares(input_table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), 4)


@query("lasso")
def _(spark, d):
    return models.coordinate_descent(input_table(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_extendedprice", 10.0)


@query("logistic")
def _(spark, d):
    p = _pred(spark, d).select("t", F.log1p("score").alias("x"))
    return models.logistic(p, ["x"], "t")


@query("forest_accuracy")
def _(spark, d):
    o = input_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") > F.col("l_quantity") * 2000).cast("double").alias("y"))
    fitted = models.forest(o, ["l_quantity", "l_extendedprice"], "y", 10, 5)
    return metrics.scores(fitted.transform(o).select("y", "prediction"), "y", "prediction")


@query("grid_cross", "SELECT a, b FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem) CROSS JOIN (SELECT DISTINCT o_orderstatus AS b FROM orders)")
def _(spark, d):
    a = input_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a")).distinct()
    return a.crossJoin(F.broadcast(input_table(spark, d, "orders").select(F.col("o_orderstatus").alias("b")).distinct()))


@query("scene_diff", "SELECT coalesce(a.c_custkey, b.k) AS key, CASE WHEN b.k IS NULL THEN 'exit' WHEN a.c_custkey IS NULL THEN 'enter' ELSE 'update' END AS what FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) b ON a.c_custkey = b.k")
def _(spark, d):
    a = input_table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("a"))
    b = input_table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("key"), F.when(F.col("b").isNull(), "exit").when(F.col("a").isNull(), "enter").otherwise("update").alias("what"))
