"""Scales, ticks and number formats, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(F.abs(hi - lo) < 1e-15, 0.5).otherwise((x - lo) / (hi - lo))


def scale_map(kind: str, x: Column, lo: Column, hi: Column, a: float = 0.0, b: float = 1.0, exponent: float = 2.0, constant: float = 1.0) -> Column:
    """x of the domain lo to hi in the range a to b: linear, log, sqrt, power or symlog; the middle if lo = hi."""
    turn = {
        "linear": lambda v: v,
        "log": F.log,
        "sqrt": lambda v: F.signum(v) * F.sqrt(F.abs(v)),
        "power": lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(exponent)),
        "symlog": lambda v: F.signum(v) * F.log1p(F.abs(v) / constant),
    }[kind]
    return a + _part(turn(x), turn(lo), turn(hi)) * (b - a)


def scale_invert_linear(y: Column, lo: Column, hi: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return lo + (y - a) / (b - a) * (hi - lo)


def band(index: Column, count: Column, a: float = 0.0, b: float = 1.0, padding: float = 0.1) -> Column:
    """Centre of a band."""
    return a + (index + 0.5) * (b - a) / count


def tick_step(lo: Column, hi: Column, count: int = 5) -> Column:
    """A step of 1, 2 or 5 times a power of ten for about count ticks."""
    raw = (hi - lo) / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    error = raw / power
    return power * F.when(error >= 50**0.5, 10.0).when(error >= 10**0.5, 5.0).when(error >= 2**0.5, 2.0).otherwise(1.0)


def ticks(lo: Column, hi: Column, count: int = 5) -> Column:
    step = tick_step(lo, hi, count)
    return F.transform(F.sequence(F.ceil(lo / step).cast("long"), F.floor(hi / step).cast("long")), lambda i: i * step)


def nice(lo: Column, hi: Column, count: int = 5) -> Column:
    step = tick_step(lo, hi, count)
    return F.struct((F.floor(lo / step) * step).alias("lo"), (F.ceil(hi / step) * step).alias("hi"))


def format_number(x: Column) -> Column:
    """Billions and millions by suffix, thousands with commas, fewer digits for larger numbers."""
    a = F.abs(x)
    text = F.format_string
    return (
        F.when(a < 1e-12, F.lit("0"))
        .when(a >= 1e9, text("%.1fB", x / 1e9))
        .when(a >= 1e6, text("%.1fM", x / 1e6))
        .when(a >= 1e4, F.format_number(x, 0))
        .when(a >= 100, text("%.1f", x))
        .when(a >= 1, text("%.2f", x))
        .otherwise(text("%.4f", x))
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB parts from 0 to 1."""
    lin = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances; 4.5 is enough for text, 7 for the stricter level."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
