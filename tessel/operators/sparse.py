"""Sparse matrices as triplets (row, col, value), and reshaping between long and wide.

A row or a column that is all zero has no triplet. Everything is a join or an aggregate on row or col, but for
distances, which take blocks of rows; no matrix is held.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import blocks
from tessel.operators.prep import TINY


def triplets(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row, col, value) of the cells that aren't zero; col counts from 0. Nulls are zeros."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns))))
    return df.select(F.col(key).alias("row"), cells.alias("x")).select("row", "x.*").where("value <> 0")


def merged(cells: DataFrame, by_row: bool = False) -> DataFrame:
    """Triplets with the values of one cell added up. by_row: dealt by row alone, for what gathers a row's cells next, so
    that cells are shuffled once."""
    return (cells.repartition("row") if by_row else cells).groupBy("row", "col").agg(F.sum("value").alias("value"))


def dense(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each row that has a cell, with a column for each name; what has no cell is 0."""
    return cells.groupBy("row").agg(*(F.coalesce(F.sum(F.when(F.col("col") == i, F.col("value"))), F.lit(0.0)).alias(c) for i, c in enumerate(columns)))


def density(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """(nnz, density) of a matrix of so many rows and columns."""
    return cells.agg(F.count("*").alias("nnz")).select("nnz", (F.col("nnz") / F.lit(float(max(1, rows * columns)))).alias("density"))


def times_vector(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, y): the matrix times a vector (col, x)."""
    return cells.join(vector, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


class _Cells:
    """Rows of a block of cells in a task: places and values by column, and each row's own sums."""

    def __init__(self, batch, i: int, side: str) -> None:
        get = lambda c: batch.column(side + c)[i]
        self.b, self.n, self.row = get("b").as_py(), get("n").as_py(), get("row").values
        self.at, self.x = get("at").values.to_numpy(), np.frombuffer(get("x").as_buffer(), dtype="<f8")
        kinds = get("col").values.dictionary_encode()
        self.kinds, codes = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(zero_copy_only=False)
        self.codes, place = codes, np.repeat(np.arange(self.n), np.diff(self.at))
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(self.kinds)))
        self.columns = {k: (place[o], self.x[o]) for k, o in zip(self.kinds, np.split(order, ends[:-1]), strict=True)}
        self.squares, self.sums = (np.bincount(place, v, self.n) for v in (self.x * self.x, np.abs(self.x)))

    def cells(self, i: int) -> dict:
        s = slice(self.at[i], self.at[i + 1])
        return dict(zip((self.kinds[c] for c in self.codes[s]), self.x[s], strict=True))


def _apart(a: dict, b: dict) -> float:
    return float(sum((a.get(k, 0.0) - b.get(k, 0.0)) ** 2 for k in a.keys() | b.keys()))


def _distances(batches):
    """Pairs of a block with a block that share a column, out of one product a shared column."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    was: dict[str, _Cells] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            for side in ("", "r_"):
                if side not in was or was[side].b != batch.column(side + "b")[i].as_py():
                    was[side] = _Cells(batch, i, side)
            q, t = was[""], was["r_"]
            dot, less, share = np.zeros((q.n, t.n)), np.zeros((q.n, t.n)), np.zeros((q.n, t.n), dtype=bool)
            for k, (p, x) in q.columns.items():
                if k in t.columns:
                    r, y = t.columns[k]
                    at, x = (p[:, None], r[None]), x[:, None]
                    dot[at] += x * y
                    less[at] += np.abs(x - y) - np.abs(x) - np.abs(y)
                    share[at] = True
            p, r = np.nonzero(share)
            rows, others = q.row.take(pa.array(p)), t.row.take(pa.array(r))
            other = pa.compute.fill_null(pa.compute.not_equal(rows, others), False)
            if not pa.compute.all(other).as_py():
                keep = other.to_numpy(zero_copy_only=False)
                p, r, rows, others = p[keep], r[keep], rows.filter(other), others.filter(other)
            both, dot = q.squares[p] + t.squares[r], dot[p, r]
            l2 = np.maximum(both - 2 * dot, 0)
            for s in np.flatnonzero(l2 <= 1e-6 * both).tolist():
                l2[s] = _apart(q.cells(p[s]), t.cells(r[s]))
            norm = np.sqrt(q.squares[p]) * np.sqrt(t.squares[r])
            cosine = np.where(norm > TINY, 1 - dot / np.where(norm > TINY, norm, 1.0), 1.0)
            yield pa.RecordBatch.from_arrays([rows, others, *map(pa.array, (dot, np.sqrt(l2), q.sums[p] + t.sums[r] + less[p, r], cosine))], ["q", "t", "dot", "l2", "l1", "cosine"])


def distances(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(q, t, dot, l2, l1, cosine) of each row q of queries and each other row t of cells that share a column.

    Sums over shared columns, with each row's own norms, give all of them: only cells that meet are multiplied. Rows are
    gathered and packed in blocks, and a block meets a block in one task, which sends out finished pairs: they are neither
    joined nor summed by key, so nothing of their number is shuffled or written."""
    kinds = dict(queries.dtypes)["row"], dict(cells.dtypes)["row"]
    met = blocks.crossed(blocks.of_cells(cells, "cells"), blocks.of_cells(queries, "queries"))
    names = ("b", "n", "row", "at", "col", "x")
    met = met.select(*(F.col(f"r_{c}").alias(c) for c in names), *(F.col(c).alias(f"r_{c}") for c in names))
    return met.mapInArrow(_distances, f"q {kinds[0]}, t {kinds[1]}, dot double, l2 double, l1 double, cosine double")


def scale(cells: DataFrame, rows: int) -> DataFrame:
    """Values by their column's population deviation over all rows, zeros included; nothing is centred, and a column that
    hardly varies has no cell left."""
    n = F.lit(float(rows))
    fit = cells.groupBy("col").agg(F.sqrt(F.greatest(F.sum(F.col("value") ** 2) / n - (F.sum("value") / n) ** 2, F.lit(0.0))).alias("std"))
    return cells.join(fit, "col").where(F.col("std") > TINY).select("row", "col", (F.col("value") / F.col("std")).alias("value"))


def gather(df: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """Rows by a list of keys (pos, key): in its order, repeated as often as it names them."""
    return positions.join(df, key).select("pos", *df.columns)


def masked(df: DataFrame, columns: list[str], mask: list[bool], keep: list[str] | None = None) -> DataFrame:
    """The columns whose mask is true, after those of keep."""
    if len(columns) != len(mask):
        raise ValueError("a mask has one value for each column")
    return df.select(*(keep or []), *(c for c, m in zip(columns, mask, strict=True) if m))


def flipped(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x and y change places."""
    return df.select(*((F.col(y).alias(x) if c == x else F.col(x).alias(y) if c == y else F.col(c)) for c in df.columns))


def layers(df: DataFrame, category: str, group: str, value: str, groups: list, how=F.sum) -> DataFrame:
    """One row a category and a column for each of groups, as grouped bars are drawn; nothing there is 0."""
    return df.groupBy(category).agg(*(F.coalesce(how(F.when(F.col(group) == g, F.col(value))), F.lit(0)).alias(str(g)) for g in groups))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n, classes): rows of each class (the whole part of target), and how many classes there are."""
    n = df.groupBy(F.col(target).cast("int").alias("class")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.count("*").alias("classes"))))


def custom_weights(df: DataFrame, target: str, weights: dict[int, float], to: str = "weight") -> DataFrame:
    """df with each row's weight by its class; a class without one has 1."""
    pick: Column = reduce(lambda out, x: F.when(F.col(target).cast("int") == x[0], F.lit(float(x[1]))).otherwise(out), weights.items(), F.lit(1.0))
    return df.withColumn(to, pick)
