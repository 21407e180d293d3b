"""Grids on disk: partitioned cell tables, grid placements and the product catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.functions.scalar import nodata_to_null, null_to_nodata
from fieldwater.operators.grid import GridSpec

CELL_SCHEMA = "row int, col int, value double, dataset string, year int, month int"


def read_cells(
    spark: SparkSession,
    path: str,
    datasets: Sequence[str] = (),
    years: Sequence[int] = (),
    months: Sequence[int] = (),
    nodata: float = codes.NODATA,
) -> DataFrame:
    """Cells of a partitioned cell table, sentinels turned into NULL.

    Dataset, year and month are partition columns, so the filters prune
    folders before anything is read.
    """
    cells = spark.read.schema(CELL_SCHEMA).parquet(path)
    for name, wanted in (("dataset", datasets), ("year", years), ("month", months)):
        if wanted:
            cells = cells.where(F.col(name).isin(list(wanted)))
    return cells.withColumn("value", nodata_to_null(F.col("value"), nodata))


def write_cells(cells: DataFrame, path: str, spec: GridSpec | None = None, name: str = "grid", mode: str = "overwrite") -> str:
    """Write cells partitioned by dataset, year and month, NULL as the sentinel, with the placement beside them.

    Rows are dealt by partition and a hash of the cell: many files of even
    size per month rather than one task per month.
    """
    nodata = spec.nodata if spec else codes.NODATA
    keys = ["dataset", "year", "month"]
    shaped = cells.select("row", "col", null_to_nodata(F.col("value"), nodata).alias("value"), *keys)
    dealt = shaped.repartition(*keys, F.pmod(F.xxhash64("row", "col"), F.lit(64)))
    dealt.write.mode(mode).partitionBy(*keys).parquet(path)
    if spec:
        spec.save_row(cells.sparkSession, name).write.mode("overwrite").parquet(f"{path}_spec")
    return path


def read_spec(spark: SparkSession, path: str) -> GridSpec:
    row = spark.read.parquet(f"{path}_spec").first().asDict()
    row.pop("grid")
    return GridSpec(**row)


def read_specs(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, GridSpec]:
    """The placement of each named product: the stored row of its own name, else the row that holds for the whole table."""
    stored = {}
    for row in spark.read.parquet(f"{path}_spec").toLocalIterator():
        held = row.asDict()
        name = held.pop("grid")
        stored[name] = GridSpec(**held)
    common = next(iter(stored.values())) if len(stored) == 1 else stored.get("grid")
    missing = [n for n in names if n not in stored and common is None]
    if missing:
        raise ValueError(f"no placement is stored for {', '.join(missing)}")
    return {n: stored.get(n) or common for n in names}


def write_specs(spark: SparkSession, path: str, specs: dict[str, GridSpec]) -> None:
    """Store placements by product beside a cell table; the name "grid" holds for all others."""
    rows = [spec.save_row(spark, name) for name, spec in specs.items()]
    reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(f"{path}_spec")


def catalogue(spark: SparkSession) -> DataFrame:
    """Remote products: dataset, collection, band, reducer, scale, and the collection used from April 2015 on."""
    fields = "dataset string, collection string, band string, reducer string, scale double, later_collection string"
    return spark.createDataFrame(codes.REMOTE_PRODUCTS, fields)


def collection_for(year: Column, month: Column) -> Column:
    """Collection of a catalogue row for a month: the later one starts in April 2015."""
    late = codes.in_later_collection(year, month)
    return F.when(late & F.col("later_collection").isNotNull(), F.col("later_collection")).otherwise(F.col("collection"))


def pick_largest(files: DataFrame, keys: Sequence[str] = ("dataset", "year", "month")) -> DataFrame:
    """One file per key from a listing (dataset, year, month, path, size): the largest, the last path among equals."""
    best = F.max(F.struct("size", "path"))
    return files.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.path").alias("path"), F.col("_b.size").alias("size"))


def check_products(names: Sequence[str]) -> None:
    """Refuse predictor names the catalogue does not know."""
    unknown = sorted(set(names) - set(codes.known_products()))
    if unknown:
        raise ValueError(f"unknown predictors: {', '.join(unknown)}")


def with_fallbacks(cells: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Give a product the cells of its stand-in for the years before its first."""
    out = cells
    for name, (stand_in, first_year) in codes.FALLBACK_PRODUCTS.items():
        if name in datasets:
            early = cells.where((F.col("dataset") == stand_in) & (F.col("year") < first_year)).withColumn("dataset", F.lit(name))
            out = out.where((F.col("dataset") != name) | (F.col("year") >= first_year)).unionByName(early)
    return out


def prune_products(datasets: Sequence[str], dropped: Sequence[str]) -> list[str]:
    """Predictors left after dropping attributes, in their given order."""
    return [d for d in datasets if d not in set(dropped)]
