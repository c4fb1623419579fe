"""Tokens, n-grams and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.order import numbered
from tessel.runtime import cut


def tokenize(text: Column) -> Column:
    """Split at white space, other than letters and digits trimmed off both ends, lower case, empty ones dropped."""
    words = F.split(text, r"(?U)\s+")
    return F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: w != "")


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, joined by a space."""
    def of(n: int) -> Column:
        last = F.size(tokens) - n
        return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def term_counts(df: DataFrame, key: str, text: str, low: int = 1, high: int = 1, binary: bool = False) -> DataFrame:
    """(key, term, n)."""
    tokens = df.select(key, tokenize(F.col(text)).alias("_t"))
    terms = tokens.select(key, F.explode(ngrams(F.col("_t"), low, high) if (low, high) != (1, 1) else F.col("_t")).alias("term"))
    return terms.groupBy(key, "term").agg((F.lit(1) if binary else F.count("*")).cast("long").alias("n"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, idx) of terms in at least min_df and at most ceil(max_df * n_docs) documents; idx is alphabetical."""
    import math

    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= math.ceil(max_df * n_docs)))
    if max_features:
        v = v.orderBy(F.desc("total"), "term").limit(max_features)
    return numbered(v.select("term", "df"), ["term"], "idx")


def tfidf(counts: DataFrame, key: str, n_docs: int, smooth: bool = True, sublinear: bool = False, norm: str | None = "l2") -> DataFrame:
    """(key, term, weight): tf * (ln((n + s) / (df + s)) + 1), by the row's norm."""
    s = 1 if smooth else 0
    counts = cut(counts, "term-counts")
    df_ = counts.groupBy("term").agg(F.count("*").alias("df"))
    tf = F.col("n").cast("double") if not sublinear else 1 + F.log(F.col("n"))
    w = counts.join(df_, "term").select(key, "term", (tf * (F.log(F.lit(float(n_docs + s)) / (F.col("df") + s)) + 1)).alias("weight"))
    if not norm:
        return w
    every = Window.partitionBy(key)
    total = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(every)) if norm == "l2" else F.sum(F.abs("weight")).over(every)
    return w.select(key, "term", (F.col("weight") / total).alias("weight"))
