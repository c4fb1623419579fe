"""Transformers with fit and transform apart, and their composition.

fit() is one aggregate whose row of parameters (a few numbers a column) comes to the driver; what it returns transforms any
table by literals, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12
Change = Callable[[DataFrame], dict[str, Column]]


@dataclass(frozen=True)
class Fitted:
    """columns: those that it reads. forward: its new columns by name, for a table. back: the same for the inverse."""

    columns: tuple[str, ...]
    forward: Change
    back: Change | None = None
    drop: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.forward(df)).drop(*self.drop)

    def inverse(self, df: DataFrame) -> DataFrame:
        if self.back is None:
            raise ValueError("this transformer has no inverse")
        return df.withColumns(self.back(df))


@dataclass(frozen=True)
class Linear:
    """Centre and scale of each column; a column whose scale is tiny is left as it is, or moved only, by `kind`.

    kind: "standard" (mean, population deviation; constant columns unchanged), "minmax" (constant: 0), or "robust" (median,
    interquartile range; constant: less the median). Nulls and NaN stay and don't count."""

    kind: str
    columns: tuple[str, ...]

    def fit(self, df: DataFrame) -> Fitted:
        valid = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        make = {
            "standard": lambda v: (F.avg(v), F.stddev_pop(v)),
            "minmax": lambda v: (F.min(v), F.max(v) - F.min(v)),
            "robust": lambda v: (F.percentile(v, 0.5), F.percentile(v, 0.75) - F.percentile(v, 0.25)),
        }[self.kind]
        got = df.agg(*(F.struct(*make(valid(c))).alias(f"p{i}") for i, c in enumerate(self.columns))).first()
        place = {c: (got[i][0] if got[i][0] is not None else 0.0, got[i][1] or 0.0) for i, c in enumerate(self.columns)}

        def one(c: str) -> Column:
            at, scale = place[c]
            if scale > TINY:
                return (F.col(c) - F.lit(at)) / F.lit(scale)
            return F.col(c).cast("double") if self.kind == "standard" else F.col(c) - F.lit(at)

        def undo(c: str) -> Column:
            at, scale = place[c]
            return F.col(c) * F.lit(scale) + F.lit(at) if scale > TINY else F.col(c) if self.kind == "standard" else F.col(c) + F.lit(at)

        return Fitted(self.columns, lambda _: {c: one(c) for c in self.columns}, lambda _: {c: undo(c) for c in self.columns})


@dataclass(frozen=True)
class Impute:
    """Missing values (null or NaN) become the column's mean, median, or value; 0 where a column has no other."""

    kind: str
    columns: tuple[str, ...]
    value: float = 0.0

    def fit(self, df: DataFrame) -> Fitted:
        valid = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        make = {"mean": F.avg, "median": lambda v: F.percentile(v, 0.5), "constant": lambda v: F.lit(self.value)}[self.kind]
        got = df.agg(*(make(valid(c)).alias(f"p{i}") for i, c in enumerate(self.columns))).first()
        fill = {c: got[i] if got[i] is not None else 0.0 for i, c in enumerate(self.columns)}
        return Fitted(self.columns, lambda _: {c: F.coalesce(valid(c), F.lit(fill[c])) for c in self.columns})


@dataclass(frozen=True)
class OneHot:
    """A column of 0 and 1 for each value, sorted, named column_value, in the column's place at the end of the table.

    drop: "none", "first", or "binary" (the first of two). unknown: "error" raises when such a row is read, "ignore"
    leaves zeros. most: more values than this are refused, as each makes a column."""

    columns: tuple[str, ...]
    drop: str = "none"
    unknown: str = "error"
    most: int = 1000

    def fit(self, df: DataFrame) -> Fitted:
        values = {}
        for c in self.columns:
            got = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(self.most + 1).collect()]
            if len(got) > self.most:
                raise ValueError(f"{c} has over {self.most} values")
            values[c] = sorted(got)

        def forward(_: DataFrame) -> dict[str, Column]:
            out = {}
            for c, all_ in values.items():
                unseen = F.col(c).isNull() | ~F.col(c).isin(all_)
                for v in all_[1 if self.drop == "first" or (self.drop == "binary" and len(all_) == 2) else 0 :]:
                    hit = F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
                    name = f"{c}_{int(v) if isinstance(v, float) else v}"
                    out[name] = F.when(unseen, F.raise_error(F.concat(F.lit(f"{c}: unknown value "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("double")).otherwise(hit) if self.unknown == "error" else hit
            return out

        return Fitted(self.columns, forward, drop=self.columns)


@dataclass(frozen=True)
class FittedPipeline:
    steps: tuple[Fitted, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for step in reversed(self.steps):
            df = step.inverse(df)
        return df


@dataclass(frozen=True)
class Pipeline:
    """Steps fitted one after the other, each on what those before it make of the table. The last one may be a model:
    whatever has fit(df) and then transform(df)."""

    steps: tuple = field(default_factory=tuple)

    def fit(self, df: DataFrame) -> FittedPipeline:
        done = []
        for step in self.steps:
            done.append(step.fit(df))
            df = done[-1].transform(df)
        return FittedPipeline(tuple(done))


@dataclass(frozen=True)
class ColumnTransformer:
    """Transformers, each with its columns; the result has what they make in their order, and no other column but keep."""

    steps: tuple
    keep: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> FittedColumns:
        return FittedColumns(tuple(s.fit(df) for s in self.steps), self.keep)


@dataclass(frozen=True)
class FittedColumns:
    steps: tuple[Fitted, ...]
    keep: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        made = [(n, c) for s in self.steps for n, c in s.forward(df).items()]
        return df.select(*self.keep, *(c.alias(n) for n, c in made))
