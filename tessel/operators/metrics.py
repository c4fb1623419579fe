"""Metrics of predictions as aggregates. t is the true column, p the predicted one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.order import falling, running


def confusion(df: DataFrame, t: str, p: str) -> DataFrame:
    """(t, p, n) over all pairs of classes of either."""
    c = df.groupBy(F.col(t).cast("long").alias("t"), F.col(p).cast("long").alias("p")).agg(F.count("*").alias("n"))
    classes = c.select(F.explode(F.array("t", "p")).alias("t")).distinct()
    grid = classes.crossJoin(F.broadcast(classes.withColumnRenamed("t", "p")))
    return grid.join(c, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, t: str, p: str) -> DataFrame:
    """(class, precision, recall, f1, support); 0 where undefined."""
    c = confusion(df, t, p)
    sides = c.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit("t").alias("side")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("t") == F.col("p")).alias("hit"))
    g = sides.groupBy("x.class").agg(F.sum(F.when((F.col("x.side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.side") == "t", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("made"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.select("class", ratio(F.col("tp"), F.col("made")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), "support")
    pr = F.col("precision") + F.col("recall")
    return g.select("class", "precision", "recall", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0).alias("f1"), "support")


def report(df: DataFrame, t: str, p: str) -> DataFrame:
    """per_class() and rows for the macro and the weighted averages."""
    c = per_class(df, t, p)
    columns = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = c.agg(*(F.avg(x).alias(x) for x in columns), total.alias("support")).select(F.lit("macro").alias("class"), *columns, "support")
    weighted = c.agg(*((F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in columns), total.alias("support")).select(F.lit("weighted").alias("class"), *columns, "support")
    return c.withColumn("class", F.col("class").cast("string")).unionByName(macro).unionByName(weighted)


def scores(df: DataFrame, t: str, p: str) -> DataFrame:
    """accuracy, balanced accuracy and Cohen's kappa in one row."""
    acc = df.agg(F.coalesce(F.avg((F.abs(F.col(t) - F.col(p)) < 1e-6).cast("double")), F.lit(0.0)).alias("accuracy"))
    balanced = per_class(df, t, p).agg(F.avg("recall").alias("balanced_accuracy"))
    c = confusion(df, t, p)
    rows = c.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("d"))
    cols = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("b"))
    m = rows.join(cols, "k").agg(F.sum("a").alias("n"), F.sum("d").alias("d"), F.sum(F.col("a") * F.col("b")).alias("e"))
    po, pe = F.col("d") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    kappa = m.select(F.when(F.abs(1 - pe) < 1e-12, F.when(F.abs(1 - po) < 1e-12, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))
    return acc.crossJoin(balanced).crossJoin(kappa)


def log_loss(df: DataFrame, t: str, prob: str) -> DataFrame:
    """Binary: prob is that of class 1, clipped to 1e-15 and 1 less that."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(prob)))
    return df.agg((-F.avg(F.when(F.col(t) == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))


def _ranked(df: DataFrame, t: str, score: str, key: str) -> DataFrame:
    """(i, hit, tp, p, n): place by falling score and then key, whether the row is positive, and counts up to it and in all.
    Rows without a label are left out."""
    hit = (F.col(t) > 0.5).cast("long")
    r = running(df.where(F.col(t).isNotNull()).select(F.col(score).alias("s"), F.col(key).alias("k"), hit.alias("hit")), [falling("s"), "k"], {"i": F.lit(1).cast("long"), "tp": F.col("hit")})
    return r.select("i", "hit", "tp", F.col("tp_all").alias("p"), (F.col("i_all") - F.col("tp_all")).alias("n"))


def _part(a, b):
    return a / F.nullif(b, F.lit(0))


def roc(df: DataFrame, t: str, score: str, key: str) -> DataFrame:
    """(i, fpr, tpr) from (0, 0), one point a row by falling score and then key; ties aren't one point."""
    r = _ranked(df, t, score, key)
    points = r.select("i", _part(F.col("i") - F.col("tp"), F.col("n")).alias("fpr"), _part(F.col("tp"), F.col("p")).alias("tpr"))
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).union(points)


def auc(df: DataFrame, t: str, score: str, key: str) -> DataFrame:
    """Area under roc() by trapezoids: only a negative row moves to the right, by 1 / n at the height of that row."""
    r = _ranked(df, t, score, key)
    return r.agg(F.sum(F.when(F.col("hit") == 0, _part(F.col("tp"), F.col("p")) / F.col("n"))).alias("auc"))


def precision_recall(df: DataFrame, t: str, score: str, key: str) -> DataFrame:
    """(i, recall, precision) from (0, 1)."""
    r = _ranked(df, t, score, key).select("i", _part(F.col("tp"), F.col("p")).alias("recall"), (F.col("tp") / F.col("i")).alias("precision"))
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")).union(r)


def average_precision(df: DataFrame, t: str, score: str, key: str) -> DataFrame:
    """Area under precision_recall() by trapezoids: only a positive row moves to the right, by 1 / p."""
    here, before = F.col("tp") / F.col("i"), F.when(F.col("i") == 1, 1.0).otherwise((F.col("tp") - 1) / F.nullif(F.col("i") - 1, F.lit(0)))
    return _ranked(df, t, score, key).agg(F.sum(F.when(F.col("hit") == 1, (here + before) / 2 / F.col("p"))).alias("average_precision"))


def regression(df: DataFrame, t: str, p: str) -> DataFrame:
    """mse, rmse, mae, r2, explained_variance and mape (which skips a true 0) in one row."""
    y, q = F.col(t).cast("double"), F.col(p).cast("double")
    e = y - q
    g = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot"), F.var_pop(e).alias("ve"), F.var_pop(y).alias("vy"), F.avg(F.when(F.abs(y) >= 1e-15, F.abs(e / y))).alias("mape"))
    flat = F.when(F.col("res") < 1e-12, 1.0).otherwise(0.0)
    return g.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("tot") < 1e-12, flat).otherwise(1 - F.col("res") / F.col("tot")).alias("r2"), F.when(F.col("vy") < 1e-12, flat).otherwise(1 - F.col("ve") / F.col("vy")).alias("explained_variance"), F.coalesce("mape", F.lit(0.0)).alias("mape"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    two = lambda c: F.sum(c * (c - 1) / 2)
    cell = df.groupBy(a, b).count().agg(two(F.col("count")).alias("ij"), F.sum("count").alias("n"))
    left, right = (df.groupBy(x).count().agg(two(F.col("count")).alias(y)) for x, y in ((a, "i"), (b, "j")))
    m = cell.crossJoin(left).crossJoin(right)
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("i") + F.col("j")) / 2 - expected
    return m.select(F.when(F.abs(top) < 1e-15, 1.0).otherwise((F.col("ij") - expected) / top).alias("ari"))
