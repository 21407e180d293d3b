"""Meter tables and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwater.config import ColumnNames
from fieldwater.functions.geo import oriented

RING = "array<struct<x: double, y: double>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet folder or CSV file by its ending. CSV takes the schema as given, nothing is inferred."""
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def read_readings(spark: SparkSession, path: str, names: ColumnNames = ColumnNames()) -> DataFrame:
    """Daily readings as (site_no string, datetime timestamp, value double)."""
    raw = _read(spark, path, f"`{names.site_id_readings}` string, `{names.timestamp}` timestamp, `{names.reading}` double")
    return raw.select(
        F.col(names.site_id_readings).cast("string").alias("site_no"),
        F.col(names.timestamp).cast("timestamp").alias("datetime"),
        F.col(names.reading).cast("double").alias("value"),
    )


def read_sites(spark: SparkSession, path: str, names: ColumnNames = ColumnNames()) -> DataFrame:
    """Meter sites, one row per site and year."""
    schema = (
        f"`{names.site_id_sites}` string, `{names.year}` int, `{names.crop}` string, `{names.state}` string, "
        f"`{names.acres}` double, `{names.lat}` double, `{names.lon}` double"
    )
    return _read(spark, path, schema).select(
        F.col(names.site_id_sites).cast("string").alias("site_no"),
        F.col(names.year).cast("int").alias("Year"),
        F.col(names.crop).alias("crop"),
        F.col(names.state).alias("State"),
        F.col(names.acres).cast("double").alias("acres"),
        F.col(names.lat).cast("double").alias("lat_dd"),
        F.col(names.lon).cast("double").alias("long_dd"),
    )


def read_annual(spark: SparkSession, path: str, names: ColumnNames = ColumnNames()) -> DataFrame:
    """Annual readings as (crop, Year, AF_Acre, lat_dd, long_dd)."""
    schema = (
        f"`{names.annual_crop}` string, `{names.annual_year}` int, `{names.target}` double, "
        f"`{names.annual_lat}` double, `{names.annual_lon}` double"
    )
    return _read(spark, path, schema).select(
        F.col(f"`{names.annual_crop}`").alias("crop"),
        F.col(names.annual_year).cast("int").alias("Year"),
        F.col(names.target).cast("double").alias("AF_Acre"),
        F.col(names.annual_lat).cast("double").alias("lat_dd"),
        F.col(names.annual_lon).cast("double").alias("long_dd"),
    )


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """A polygon table: attributes and a ``ring`` column, checked for its type.

    The column holds one ring, or the oriented rings of all parts and holes.
    A table of ``parts`` (arrays of an outer ring followed by its holes) is turned into the latter.
    """
    table = spark.read.parquet(path)
    if "parts" in table.columns and "ring" not in table.columns:
        table = table.withColumn("ring", oriented(F.col("parts"))).drop("parts")
    kind = table.schema["ring"].dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    depth = table.schema["ring"].dataType.simpleString().count("array<")
    if depth not in (1, 2) or not isinstance(kind, T.StructType) or kind.names != ["x", "y"]:
        raise ValueError(f"{path}: ring must be {RING} or an array of it")
    return table


def write_csv(df: DataFrame, path: str) -> str:
    """Result table as CSV with a header; one file per task, never gathered into one."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_months(df: DataFrame, path: str) -> str:
    """Predictor or prediction table as Parquet, partitioned by year and month.

    Rows are first dealt by month and a hash of the cell, so a month is spread
    over several files and no task writes a whole month.
    """
    dealt = df.repartition("year", "month", F.pmod(F.xxhash64("row", "col"), F.lit(64)))
    dealt.write.mode("overwrite").partitionBy("year", "month").parquet(path)
    return path
