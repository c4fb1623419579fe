"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "type string, coordinates string"


def read_csv(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Columns of numbers with row_id; a cell that isn't one is NaN. A target of other than numbers gets codes by first
    appearance in target_code. The header is needed; short rows are filled with NaN."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c.lower(): c for c in raw.columns}
    goal = names.get(target.lower()) if target else None
    if target and not goal:
        raise ValueError(f"no column {target}")
    numbers = [c for c in raw.columns if c != goal]
    df = raw.select(F.monotonically_increasing_id().alias("row_id"), *(F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(float("nan"))).alias(c) for c in numbers), *([F.col(goal)] if goal else []))
    if goal and df.where(F.col(goal).isNotNull() & F.expr(f"try_cast(`{goal}` AS double)").isNull()).limit(1).count():
        from tessel.operators.prep import label_encode, label_index

        return label_encode(df, goal, label_index(df, goal, "row_id")).withColumnRenamed("code", "target_code")
    return df.withColumn(goal, F.col(goal).cast("double")) if goal else df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(type, coordinates, properties) of each feature of a collection, a feature or a bare geometry; coordinates as
    JSON. A GeometryCollection keeps its first member; a feature without a geometry raises."""
    geometry = f"struct<type:string,coordinates:string,geometries:array<struct<{GEOMETRY.replace(' string', ':string')}>>>".replace(", ", ",")
    schema = f"type string, coordinates string, geometries array<struct<type:string,coordinates:string>>, geometry {geometry}, properties map<string,string>, features array<struct<geometry:{geometry},properties:map<string,string>>>"
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    one = F.struct(F.when(F.col("j.type") == "Feature", F.col("j.geometry")).otherwise(F.struct("j.type", "j.coordinates", "j.geometries")).alias("geometry"), F.col("j.properties").alias("properties"))
    f = j.select(F.explode(F.when(F.col("j.type") == "FeatureCollection", F.col("j.features")).otherwise(F.array(one))).alias("f"))
    g = F.when(F.col("f.geometry.type") == "GeometryCollection", F.struct(F.col("f.geometry.geometries")[0]["type"].alias("type"), F.col("f.geometry.geometries")[0]["coordinates"].alias("coordinates"))).otherwise(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")))
    kind = F.coalesce(g["type"], F.raise_error(F.lit("a feature has no geometry")))
    return f.select(kind.alias("type"), g["coordinates"].alias("coordinates"), F.col("f.properties").alias("properties"))


def polygon(coordinates):
    """A Polygon's coordinates as array<array<struct<x, y>>>."""
    return F.transform(F.from_json(coordinates, "array<array<array<double>>>"), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_rows(spark: SparkSession, path: str, start: int, end: int, key: str = "row_id") -> DataFrame:
    """Rows start to end - 1 by key; the range reaches the scan."""
    return spark.read.parquet(path).where((F.col(key) >= start) & (F.col(key) < end))
