"""Descriptive statistics and the statistics behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.order import numbered
from tessel.runtime import cut, ship_package


def unpivot(df: DataFrame, columns: list[str], name: str = "feature", value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row for each column of each row."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns))
    return df.select(*(keep or []), F.explode(pairs).alias("_p")).select(*(keep or []), f"_p.{name}", f"_p.{value}")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def require_finite(df: DataFrame, columns: list[str], allow_nan: bool = False) -> DataFrame:
    """df, after one aggregate that raises if a column holds an infinity or, unless allowed, a null or NaN."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.coalesce(F.abs(x) == float("inf"), F.lit(False)) if allow_nan else ~finite(x)

    row = df.agg(*(F.sum(bad(c).cast("int")).alias(c) for c in columns)).first()
    wrong = [c for c in columns if row[c]]
    if wrong:
        raise ValueError(f"not finite: {', '.join(wrong)}")
    return df


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, std (sample; 0 of one value), min, q25, median, q75, max of each column's finite values."""
    v = F.col("value")
    quart = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = unpivot(df, columns).where(finite(v)).groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), quart.alias("q"), F.max(v).alias("max"))
    return out.select("feature", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


_AGG = {"count": lambda y: F.count(y).cast("double"), "sum": F.sum, "mean": F.avg, "median": lambda y: F.percentile(y, F.lit(0.5)), "min": F.min, "max": F.max}


def aggregate_by(df: DataFrame, category: str, value: str, func: str, order_by: str) -> DataFrame:
    """(x, category, y): func of each category; x counts categories by their first appearance in order_by."""
    g = df.groupBy(F.col(category).alias("category")).agg(_AGG[func](F.col(value)).alias("y"), F.min(order_by).alias("_first"))
    return g.select((F.row_number().over(Window.orderBy("_first")) - 1).cast("double").alias("x"), "category", "y")


def _bins(df: DataFrame, value: str, bins: Column) -> DataFrame:
    """Counts of equal-width bins with their centres, empty ones too. bins is an aggregate expression."""
    v = F.col(value).cast("double")
    fit = df.where(finite(v)).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), bins.cast("int").alias("k"))
    fit = fit.select("lo", "hi", F.when(F.col("hi") > F.col("lo"), F.greatest(F.col("k"), F.lit(1))).otherwise(1).alias("k")).where("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    index = F.when(width > 0, F.least(F.floor((v - F.col("lo")) / width), F.col("k") - 1)).otherwise(0).cast("int")
    counts = df.where(finite(v)).crossJoin(F.broadcast(fit)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    grid = fit.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select(F.col("bin").cast("long").alias("bin"), (F.col("lo") + (F.col("bin") + 0.5) * F.col("w")).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def sturges(v: Column) -> Column:
    n = F.count(v)
    return F.when(n <= 1, 1).otherwise(F.ceil(F.log2(n)) + 1)


def _by_width(v: Column, width: Column) -> Column:
    return F.when(width > 1e-12, F.ceil((F.max(v) - F.min(v)) / width)).otherwise(sturges(v))


def histogram(df: DataFrame, value: str, rule: str | int = "sturges") -> DataFrame:
    """rule: a number of bins, sturges, scott (3.5 population deviations) or fd (two quartile ranges; else sturges)."""
    v = F.col(value).cast("double")
    if isinstance(rule, int):
        return _bins(df, value, F.lit(rule) + 0 * F.count(v))
    if rule == "sturges":
        return _bins(df, value, sturges(v))
    root = F.pow(F.count(v).cast("double"), F.lit(-1.0 / 3))
    if rule == "scott":
        return _bins(df, value, _by_width(v, 3.5 * F.stddev_pop(v) * root))
    return _bins(df, value, _by_width(v, 2.0 * (F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))) * root))


def _fences(df: DataFrame, category: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    f = df.groupBy(F.col(category).alias("category")).agg(q.alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return f.select("category", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[0] - 1.5 * iqr).alias("lo"), (F.col("q")[2] + 1.5 * iqr).alias("hi"))


def boxplot(df: DataFrame, category: str, value: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 quartile ranges) and the number of outliers of each category."""
    v = F.col(value)
    j = df.join(F.broadcast(_fences(df, category, value)), df[category] == F.col("category"))
    inside = v.between(F.col("lo"), F.col("hi"))
    return j.groupBy("category", "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"), F.sum((~inside).cast("long")).alias("n_outliers"))


def boxplot_outliers(df: DataFrame, category: str, value: str, key: str) -> DataFrame:
    j = df.join(F.broadcast(_fences(df, category, value)), df[category] == F.col("category"))
    return j.where(~F.col(value).between(F.col("lo"), F.col("hi"))).select(key, "category", F.col(value).alias("value"))


def stack(df: DataFrame, x: str, layer: str, y: str) -> DataFrame:
    """(x, layer, y, base, top): layers over one another for each x, positive and negative apart; a missing y is 0."""
    sums = df.groupBy(F.col(x).alias("x"), F.col(layer).alias("layer")).agg(F.sum(y).alias("y"))
    grid = sums.select("x").distinct().crossJoin(F.broadcast(sums.select("layer").distinct()))
    full = grid.join(sums, ["x", "layer"], "left").select("x", "layer", F.coalesce("y", F.lit(0.0)).alias("y"))
    before = Window.partitionBy("x").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    up, down = (F.coalesce(F.sum(f(F.col("y"), F.lit(0.0))).over(before), F.lit(0.0)) for f in (F.greatest, F.least))
    base = F.when(F.col("y") >= 0, up).otherwise(down)
    return full.select("x", "layer", "y", base.alias("base"), (base + F.col("y")).alias("top"))


def fill(df: DataFrame, x: str, layer: str, y: str) -> DataFrame:
    """stack() divided by the top of the last layer of each x; 0 where that is 0."""
    s = stack(df, x, layer, y)
    top = F.last("top").over(Window.partitionBy("x").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    part = lambda c: F.when(F.abs(top) > 1e-12, F.col(c) / top).otherwise(0.0).alias(c)
    return s.select("x", "layer", part("base"), part("top"))


def dodge(df: DataFrame, layer: str, spacing: float = 1.0) -> DataFrame:
    """(layer, offset): layers side by side within 0.8 of the spacing."""
    layers = df.select(F.col(layer).alias("layer")).distinct()
    g, n = F.row_number().over(Window.orderBy("layer")) - 1, F.count("*").over(Window.partitionBy())
    return layers.select("layer", ((g - (n - 1) / 2) * 0.8 * spacing / n).alias("offset"))


def shares(df: DataFrame, category: str, value: str) -> DataFrame:
    """Each category's part of the total, and its place by value, largest first."""
    s = df.groupBy(F.col(category).alias("category")).agg(F.sum(value).alias("y"))
    return s.select("category", (F.col("y") / F.sum("y").over(Window.partitionBy())).alias("share"), F.row_number().over(Window.orderBy(F.desc("y"), "category")).cast("long").alias("place"))


def data_bounds(df: DataFrame, x: str, by: str | None = None, pad: float = 0.05) -> DataFrame:
    """lo and hi of x, widened by pad of the range on either side; for each value of by if given."""
    g = df.groupBy(F.col(by).alias("facet")) if by else df
    b = g.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"))
    return b.select(*(["facet"] if by else []), (F.col("a") - pad * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + pad * (F.col("b") - F.col("a"))).alias("hi"))


def _sums(batches):
    """One row of all distinct x in order: n rows of each, m of them with y, and the sum of y."""
    import numpy as np
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got).sort_by("x")
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(t.column(c), dtype="<f8").tobytes()], pa.binary()) for c in ("x", "n", "m", "y")], ["xs", "ns", "ms", "ys"])


def _edge(xs, at, d, side: int):
    """Where the x within d of at begin (-1) or end (1) by their computed differences, which x + d may miss by its rounding."""
    import numpy as np

    i = np.searchsorted(xs, at + side * d, side="right" if side > 0 else "left")
    inside = lambda j: (j >= 0) & (j < len(xs)) & (np.abs(xs[np.clip(j, 0, len(xs) - 1)] - at) <= d)
    while True:
        out, back = i if side > 0 else i - 1, i - 1 if side > 0 else i
        grow, shrink = inside(out), ~inside(back)
        if not (grow | shrink).any():
            return i
        i = i + side * np.where(grow, 1, np.where(shrink, -1, 0))


def _reach(xs, upto, at, own, k: int, side: int):
    """The least distance to an x on one side (-1: below, 1: above) within which k rows lie; infinite without one. Found by
    halving, for all of at together; own are their places among xs, upto the rows before each place."""
    import numpy as np

    last = own if side < 0 else len(xs) - 1 - own
    low, high = np.zeros_like(last), last + 1
    while (low < high).any():
        mid = (low + high) // 2
        d = np.abs(xs[own + side * np.minimum(mid, last)] - at)
        enough = upto[_edge(xs, at, d, 1)] - upto[_edge(xs, at, d, -1)] >= k
        open_ = low < high
        low, high = np.where(open_ & ~enough, mid + 1, low), np.where(open_ & enough, mid, high)
    return np.where(low <= last, np.abs(xs[own + side * np.minimum(low, last)] - at), np.inf)


def _fits(k: int):
    """(x, fit) for each x of a batch, beside the sums of all distinct x; null where the k nearest are of x itself."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        xs = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if xs is None:
                xs, ns, ms, ys = (np.frombuffer(batch.column(c)[0].as_buffer()) for c in ("xs", "ns", "ms", "ys"))
                upto = np.concatenate([[0.0], np.cumsum(ns)])
            at = batch.column("x").to_numpy(zero_copy_only=False)
            own = np.searchsorted(xs, at)
            reach = np.minimum(_reach(xs, upto, at, own, k, -1), _reach(xs, upto, at, own, k, 1))
            reach = np.where(np.isfinite(reach), reach, np.maximum(at - xs[0], xs[-1] - at))
            fit = np.full(len(at), np.nan)
            for r, (i, x, m) in enumerate(zip(own.tolist(), at.tolist(), reach.tolist(), strict=True)):
                if ns[i] >= k:
                    continue
                s = slice(int(np.searchsorted(xs, x - m)), int(np.searchsorted(xs, x + m, side="right")))
                u = xs[s] - x
                z = np.minimum(np.abs(u) / m, 1.0) if m > 0 else np.zeros_like(u)
                w = (1 - z * z * z) ** 3
                wn = w * ns[s]
                s0, s1, s2 = wn.sum(), wn @ u, (wn * u) @ u
                t0, t1 = w @ ys[s], (w * u) @ ys[s]
                det = s0 * s2 - s1 * s1
                if ms[s].any():
                    fit[r] = (s2 * t0 - s1 * t1) / det if abs(det) > 1e-9 else t0 / s0
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(fit, from_pandas=True)], ["x", "fit"])

    return run


def loess(df: DataFrame, key: str, x: str, y: str, bandwidth: float = 0.3) -> DataFrame:
    """Locally linear fit at each row from its k nearest rows by x, weighted by the cube of one less the cubed distance.

    A fit is the same for all rows of one x, and rows of one x weigh the same, so the rows become counts and sums of y by
    distinct x. All of these travel as one row, and each distinct x takes the sums over its window: no row meets another.
    Rows at the greatest distance weigh nothing, so only where k rows or more share an x do their places count: the fit is
    the mean of the first k by key. A row without x has no fit. Time grows with the square of the distinct x."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n = df.count()
    k = max(2, min(n, -int(-max(0.05, min(1.0, bandwidth)) * n // 1)))
    by = cut(rows.where(F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("n"), F.count("y").alias("m"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")), "loess")
    every = by.coalesce(1).mapInArrow(_sums, "xs binary, ns binary, ms binary, ys binary")
    parts = df.sparkSession.sparkContext.defaultParallelism
    fits = by.select("x").repartition(parts, "x").crossJoin(F.broadcast(every)).mapInArrow(_fits(k), "x double, fit double")
    many = by.where(F.col("n") >= k).select("x")
    first = numbered(rows.join(many, "x", "left_semi"), ["x", "id"], "r", by="x").where(F.col("r") < k)
    first = first.groupBy("x").agg((F.sum("y") / F.count("*")).alias("first"))
    fits = fits.join(first, "x", "left").select("x", F.coalesce("fit", "first").alias("fit"))
    return rows.select("id", "x").join(fits, "x", "left").select("id", "x", "fit")
