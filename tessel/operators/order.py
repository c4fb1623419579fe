"""Places and running sums of rows in an order, without a window that holds all rows or all rows of one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.runtime import cut


def falling(c: Column | str) -> Column:
    """An order from the largest number down; null and NaN stay where a rising order has them."""
    return -(F.col(c) if isinstance(c, str) else c).cast("double")


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column], by: str | None = None) -> DataFrame:
    """df with, for each name of sums, the sum of its expression over the rows up to and including each, in rising order,
    and as <name>_all the sum over all rows; both among rows of an equal `by` if that is given (null is a group, too).

    Rows are dealt by range of (by, order) and written, so a group that holds most rows is spread over many tasks. A window
    holds one group's rows of one range; the sums of the ranges before come from a table of one row a group and range.
    Rows equal in the whole order are in one range and in no stated order; columns of any name may be there."""
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    group = F.struct(F.col(by) if by else F.lit(0)).alias("g")
    values = [e.alias(f"v{i}") for i, e in enumerate(sums.values())]
    names, places = list(sums), [f"o{i}" for i in range(len(order))]
    d = df.select(F.struct("*").alias("row"), group, *keys, *values).repartitionByRange("g", *places)
    d = cut(d.withColumn("part", F.spark_partition_id()), "running")
    ranges = d.groupBy("g", "part").agg(*(F.sum(f"v{i}").alias(f"t{i}") for i in range(len(names))))
    before, every = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    ranges = ranges.select("g", "part", *(F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(len(names))), *(F.sum(f"t{i}").over(every).alias(f"a{i}") for i in range(len(names))))
    upto = Window.partitionBy("g", "part").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"s{i}": F.coalesce(F.sum(f"v{i}").over(upto), F.lit(0)) for i in range(len(names))}).join(ranges, ["g", "part"])
    out = [c for i, n in enumerate(names) for c in ((F.col(f"b{i}") + F.col(f"s{i}")).alias(n), F.coalesce(f"a{i}", F.lit(0)).alias(f"{n}_all"))]
    return d.select("row.*", *out)


def numbered(df: DataFrame, order: list[Column | str], name: str = "row", by: str | None = None) -> DataFrame:
    """df with the place of each row in order, from 0; within by if given."""
    d = running(df, order, {name: F.lit(1).cast("long")}, by)
    return d.drop(f"{name}_all").withColumn(name, F.col(name) - 1)
