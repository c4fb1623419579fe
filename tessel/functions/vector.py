"""Functions of arrays of numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the product of norms is tiny."""
    d = norm(a) * norm(b)
    return F.when(d < 1e-12, 0.0).otherwise(dot(a, b) / d)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * squared_l2(a, b))


def poly(a: Column, b: Column, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> Column:
    return F.pow(gamma * dot(a, b) + coef0, F.lit(degree))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def soft_threshold(z: Column, gamma: float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - gamma, F.lit(0.0))


def gini(counts: Column) -> Column:
    return 1 - total(F.transform(counts, lambda c: F.pow(c / total(counts), F.lit(2.0))))


def entropy(counts: Column) -> Column:
    p = F.transform(F.filter(counts, lambda c: c > 0), lambda c: c / total(counts))
    return -total(F.transform(p, lambda x: x * F.log2(x)))


def quantize_int8(a: Column) -> Column:
    """struct(scale, q): symmetric, scale = max |x| / 127 (1 for zeros)."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int")))).alias("q"))


def dequantize_int8(x: Column) -> Column:
    return F.transform(x["q"], lambda q: q * x["scale"])


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    return F.when(n <= 1, 0.0).otherwise(2 * (F.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
