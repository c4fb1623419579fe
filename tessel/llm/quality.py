"""Quality rules: base rules, then robust multivariate outliers by minimum-covariance-determinant estimates.

Everything is DataFrame expressions. The statistics of a text are made in one pass without a shuffle. Each language and
source has a robust mean and covariance of four transformed statistics: from several starts (medians, all rows, and
elemental sets drawn by weight), concentration steps take the `half` of the rows that lie nearest by Mahalanobis distance
and estimate again from these, until the determinant falls no more; the start with the least determinant is kept, and one
reweighting step takes all rows that are no outliers under it. Texts are first counted into cells of a fine grid with the
sums of their vectors and products, so a step reads cells, not texts, and no task ever holds a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.runtime import cut, drop_table, ids_side

#: White space by which words are told apart, and the symbols that count.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
_X = ("x1", "x2", "x3", "x4")


@dataclass(frozen=True)
class QualityParams:
    """min_words, max_repeat: the base rules (repeat in hundredths). half: part of a group that its estimate rests on.
    consistency: half / P(chi2(6) <= the half quantile of chi2(4)), by which its covariance is too small; inner and
    reweighted: the 0.975 quantile of chi2(4) and the same factor for it. floor: least standard deviation of each
    statistic given those before it, which comes in only where the estimate is degenerate, as where most texts have the
    same value; the shortest text that passes the base rules may repeat three words once (12 in 100, x4 = log 13 = 4.28
    floors) where no other text repeats any, if all else is usual. elemental: starts from five cells drawn by weight.
    least: fall of the determinant's logarithm below which steps end. cutoff: squared distance beyond which a text is
    rejected (0.999 of chi2(4) lie below). group: rows from which on a language's source, and a language, have an estimate
    of their own (five a statistic); those with fewer rows take the language's, and that of all rows. bins: cells in a
    unit."""

    min_words: int = 50
    max_repeat: int = 50
    half: float = 0.75
    consistency: float = 1.4864
    inner: float = 11.1433
    reweighted: float = 1.0645
    floor: tuple[float, float, float, float] = (0.05, 0.6, 0.6, 0.6)
    elemental: int = 4
    least: float = 1e-3
    cutoff: float = 18.467
    group: int = 20
    bins: int = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(tri: Column) -> Column:
    """Words in windows of three that occur twice or more; tri: a hash of each window."""

    def repeated(pairs: Column) -> Column:
        hash_at = lambda i: F.get(pairs, i)["h"]
        return F.filter(pairs, lambda x, i: x["h"].eqNullSafe(hash_at(i - 1)) | x["h"].eqNullSafe(hash_at(i + 1)))

    pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.sort_array(F.transform(let(pairs, repeated), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), 0).otherwise(covered).cast("long")


def statistics(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text (null: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = documents.withColumns({"_words": words, "_lines": lines})
    w = F.col("_words")
    tri = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumns({"_tri": tri, "n_words": F.size(w).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    return df.withColumns(
        {
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("_tri")),
        }
    ).drop("_words", "_lines", "_tri")


def _vectors(stats: DataFrame, p: QualityParams) -> DataFrame:
    rate = lambda c: F.log1p(F.lit(100.0) * F.col(c) / F.col("n_words"))
    x = {"x1": F.log(F.col("word_chars") / F.col("n_words")), "x2": rate("n_symbols"), "x3": rate("n_dup_lines"), "x4": rate("n_repeat_words")}
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return stats.where("NOT base_failed").withColumns(x).withColumns({"g_lang": name("lang"), "g_source": name("source")})


_G, _S = ["g_lang", "g_source"], ["g_lang", "g_source", "start"]
_PAIRS = [(i, j) for i in range(1, 5) for j in range(1, i + 1)]
_M, _L = [f"m{i}" for i in range(1, 5)], [f"l{i}{j}" for i, j in _PAIRS]
#: Estimates of up to so many groups (16 numbers each) are broadcast after they were counted.
_GROUPS = 100_000


def _join(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(F.broadcast(per_group) if per_group.count() <= _GROUPS else per_group, keys)


def _distance(df: DataFrame, at: tuple[str, ...]) -> Column:
    """Squared Mahalanobis distance of the vector at by forward substitution in the Cholesky factor l11 ... l44."""
    out, z = F.lit(0.0), {}
    for i, x in enumerate(at, 1):
        left = F.col(x) - F.col(f"m{i}")
        for j in range(1, i):
            left = left - F.col(f"l{i}{j}") * z[j]
        z[i] = left / F.col(f"l{i}{i}")
        out = out + z[i] * z[i]
    return out


def _factor(df: DataFrame, keys: list[str], p: QualityParams) -> DataFrame:
    """keys, m, the Cholesky factor of the covariances c11 ... c44, and logdet; a pivot below a floor is that floor."""
    for j in range(1, 5):
        for i in range(j, 5):
            rest = F.col(f"c{i}{j}")
            for k in range(1, j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(p.floor[i - 1] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(2, 5)), F.log("l11")) * 2
    return df.select(*keys, *_M, *_L, logdet.alias("logdet"))


def _estimate(cells: DataFrame, keys: list[str], scale: float, p: QualityParams) -> DataFrame:
    """Means and covariances, times scale, of the rows in the cells of each group."""
    total = cells.groupBy(*keys).agg(F.sum("w").alias("w"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(1, 5)), *(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS))
    mean = total.select(*keys, "w", *(F.col(f"q{i}{j}") for i, j in _PAIRS), *((F.col(f"s{i}") / F.col("w")).alias(f"m{i}") for i in range(1, 5)))
    cov = [((F.col(f"q{i}{j}") / F.col("w") - F.col(f"m{i}") * F.col(f"m{j}")) * scale).alias(f"c{i}{j}") for i, j in _PAIRS]
    return _factor(mean.select(*keys, *_M, *cov), keys, p)


def _cells(vectors: DataFrame, p: QualityParams) -> DataFrame:
    """Cells of each group, of each language and of all rows ("*"): weight, sums of vectors and of products, means."""
    bins = [f"b{i}" for i in range(1, 5)]
    add = [F.col(x).alias(f"s{i}") for i, x in enumerate(_X, 1)] + [(F.col(_X[i - 1]) * F.col(_X[j - 1])).alias(f"q{i}{j}") for i, j in _PAIRS]
    one = vectors.select(*_G, *(F.floor(F.col(x) * p.bins).alias(b) for x, b in zip(_X, bins, strict=True)), F.lit(1).alias("w"), *add)
    sums = ["w", *(f"s{i}" for i in range(1, 5)), *(f"q{i}{j}" for i, j in _PAIRS)]
    one = cut(one.groupBy(*_G, *bins).agg(*(F.sum(c).alias(c) for c in sums)), "q-cells")
    level = F.explode(F.array(*(F.struct(a.alias("g_lang"), b.alias("g_source")) for a, b in ((F.col("g_lang"), F.col("g_source")), (F.col("g_lang"), F.lit("*")), (F.lit("*"), F.lit("*"))))))
    every = one.select(level.alias("g"), *bins, *sums).select("g.*", *bins, *sums).groupBy(*_G, *bins).agg(*(F.sum(c).alias(c) for c in sums))
    out = cut(every.select("*", *((F.col(f"s{i}") / F.col("w")).alias(x) for i, x in enumerate(_X, 1))), "q-levels")
    drop_table(one)
    return out


def _starts(cells: DataFrame, p: QualityParams) -> DataFrame:
    """Estimates to start from: 0 medians and quartiles, 1 all rows, then elemental ones."""
    at = [F.percentile(f"b{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("w")).alias(f"p{i}") for i in range(1, 5)]
    mid = cells.groupBy(*_G).agg(*at).select(*_G, F.lit(0).alias("start"), *(((F.col(f"p{i}")[1] + 0.5) / p.bins).alias(f"m{i}") for i in range(1, 5)), *((((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / (1.349 * p.bins)) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    whole = _estimate(cells, _G, 1.0, p).select(*_G, F.lit(1).alias("start"), *_M, *_L, "logdet")
    out = _factor(mid, _S, p).union(whole)
    if not p.elemental:
        return out
    # of exponential variables with the weights as rates, the least falls on a cell with a probability as its weight
    unit = lambda k: (F.pmod(F.xxhash64("start", F.lit(k), "b1", "b2", "b3", "b4"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    five = cells.withColumn("start", F.explode(F.sequence(F.lit(2), F.lit(1 + p.elemental)))).groupBy(*_S).agg(*(F.min(F.struct((-F.log(unit(k)) / F.col("w")).alias("race"), *_X)).alias(f"e{k}") for k in range(5)))
    mean = five.select("*", *((sum((F.col(f"e{k}.{x}") for k in range(1, 5)), F.col(f"e0.{x}")) / 5).alias(f"m{i}") for i, x in enumerate(_X, 1)))
    part = lambda k, i: F.col(f"e{k}.x{i}") - F.col(f"m{i}")
    cov = [(sum((part(k, i) * part(k, j) for k in range(1, 5)), part(0, i) * part(0, j)) / 5).alias(f"c{i}{j}") for i, j in _PAIRS]
    return out.union(_factor(mean.select(*_S, *_M, *cov), _S, p))


def _concentrate(cells: DataFrame, now: DataFrame, p: QualityParams) -> DataFrame:
    """The estimates from the nearest half of each group under those of now."""
    near = _join(cells, now, _G)
    near = near.select(*_S, "w", *(f"s{i}" for i in range(1, 5)), *(f"q{i}{j}" for i, j in _PAIRS), F.floor(F.log(_distance(near, _X) + 1e-6) * p.bins).alias("bin"))
    edge = near.groupBy(*_S).agg(F.ceil(F.percentile("bin", F.lit(p.half), F.col("w"))).alias("edge"))
    return _estimate(near.join(edge, _S).where("bin <= edge"), _S, p.consistency, p)


def estimates(vectors: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """(g_lang, g_source, m1 ... m4, l11 ... l44, raw, start) for each group of vectors, by that group's rows, its
    language's, or all. raw is the logarithm of the least determinant, start the start that led there."""
    p = params or QualityParams()
    cells = _cells(vectors, p)
    sizes = cells.groupBy(*_G).agg(F.sum("w").alias("rows"))
    own = cut(sizes.where((F.col("rows") >= p.group) | (F.col("g_lang") == "*")), "q-sizes")
    cells_of = _join(cells, own.select(*_G), _G)
    now = cut(_starts(cells_of, p).withColumn("moved", F.lit(True)), "q-estimate")
    names = [*_M, *_L, "logdet"]
    while not now.where("moved").isEmpty():
        new = _concentrate(cells_of, now.where("moved").select(*_S, *_M, *_L), p)
        both = now.join(new.select(*_S, *(F.col(c).alias(f"new_{c}") for c in names)), _S, "left")
        # the first step leaves the start, which may well be narrower, being no half of the rows
        better = F.col("moved") & ((F.col("new_logdet") < F.col("logdet") - p.least) | F.col("first"))
        both = both.withColumn("first", F.lit("first" not in now.columns))
        after = cut(both.select(*_S, *(F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names), F.coalesce(better, F.lit(False)).alias("moved"), F.lit(False).alias("first")), "q-estimate")
        drop_table(now)
        now = after
    least = now.groupBy(*_G).agg(F.min(F.struct("logdet", "start", *_M, *_L)).alias("x")).select(*_G, F.col("x.logdet").alias("raw"), "x.start", *(f"x.{c}" for c in [*_M, *_L]))
    least = cut(least, "q-least")
    inner = _join(cells_of, least, _G)
    again = _estimate(inner.where(_distance(inner, _X) <= p.inner).select(cells_of.columns), _G, p.reweighted, p).drop("logdet")
    known = cut(least.select(*_G, "raw", "start").join(again, _G), "q-known")
    every = sizes.where("g_source <> '*'").select(*_G)
    level = [(F.col("g_lang"), F.col("g_source"), 0), (F.col("g_lang"), F.lit("*"), 1), (F.lit("*"), F.lit("*"), 2)]
    wanted = every.select(*_G, F.explode(F.array(*(F.struct(a.alias("a"), b.alias("b"), F.lit(n).alias("n")) for a, b, n in level))).alias("x")).select(*_G, "x.*")
    found = wanted.join(known.withColumnsRenamed({"g_lang": "a", "g_source": "b"}), ["a", "b"])
    out = found.groupBy(*_G).agg(F.min(F.struct("n", *_M, *_L, "raw", "start")).alias("x")).select(*_G, *(f"x.{c}" for c in [*_M, *_L, "raw", "start"]))
    out = cut(out, "q-groups")
    for t in (cells, own, now, least, known):
        drop_table(t)
    return out


def judge(documents: DataFrame, params: QualityParams | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row.

    A null text has no word and fails. Null languages and sources are groups of their own. Rows with the same or no id
    are judged each. Other columns are ignored; an empty table gives an empty one.
    """
    p = params or QualityParams()
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = statistics(docs).drop("text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < p.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.max_repeat))
    stats = cut(stats, "q-stats")
    vectors = _vectors(stats, p)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    seen = _join(vectors, estimates(vectors, p).drop("raw", "start"), _G)
    seen = seen.select(*columns, (_distance(seen, _X) <= p.cutoff).alias("kept"))
    return seen.union(stats.where("base_failed").select(*columns, F.lit(False).alias("kept")))


def keep_good(documents: DataFrame, params: QualityParams | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows of documents that judge() keeps; of rows with one id, all go if one is rejected, and one without an id stays."""
    bad = cut(judge(documents, params, id_col).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct(), "q-bad")
    return documents.join(ids_side(bad), id_col, "left_anti")
