"""Comparison of two gridded monthly models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.functions.sizing import attach, measured

CELL_MONTH = ("year", "month", "row", "col")


def match_models(older: DataFrame, newer: DataFrame, keys: Sequence[str] = CELL_MONTH) -> DataFrame:
    """Cells of the newer model with the older value beside it; the older one is masked to them.

    Both sides are equi-joined on the cell and month, on the same grid (align
    by coordinates first).
    """
    o = older.select(*keys, F.col("value").alias("older"))
    n = newer.where(F.col("value").isNotNull()).select(*keys, F.col("value").alias("newer"))
    return n.join(o, list(keys), "left")


def monthly_model_totals(matched: DataFrame) -> DataFrame:
    """Totals of both models per year and month, skipping missing cells."""
    return matched.groupBy("year", "month").agg(
        F.coalesce(F.sum("older"), F.lit(0.0)).alias("older"), F.coalesce(F.sum("newer"), F.lit(0.0)).alias("newer")
    )


def cell_differences(matched: DataFrame) -> DataFrame:
    """Newer minus older per cell and month; missing where either is."""
    return matched.withColumn("difference", F.col("newer") - F.col("older"))


def season_totals(matched: DataFrame, keys: Sequence[str] = ("year", "row", "col")) -> DataFrame:
    """Season totals per cell of both models and of their difference.

    The season of a year is the set of months that year has. A cell with any
    missing month is missing. The months of a year are a handful of rows.
    """
    season = measured(matched.groupBy("year").agg(F.count_distinct("month").alias("_months")))
    totals = matched.groupBy(*keys).agg(
        F.sum("older").alias("older"),
        F.count("older").alias("_n_older"),
        F.sum("newer").alias("newer"),
        F.count("newer").alias("_n_newer"),
    )
    whole = attach(totals, season, ["year"])
    older = F.when(F.col("_n_older") == F.col("_months"), F.col("older"))
    newer = F.when(F.col("_n_newer") == F.col("_months"), F.col("newer"))
    return whole.select(*keys, older.alias("older"), newer.alias("newer"), (newer - older).alias("difference"))


def mean_month_comparison(totals: DataFrame, skip_months: Sequence[int] = (10,)) -> DataFrame:
    """Mean of the yearly totals per month, their difference, and its size in percent of the older model."""
    kept = totals.where(~F.col("month").isin(list(skip_months)))
    means = kept.groupBy("month").agg(F.avg("older").alias("older"), F.avg("newer").alias("newer"))
    difference = F.col("older") - F.col("newer")
    return means.withColumns(
        {"difference": difference, "difference_percent": F.abs(F.try_divide(difference * 100, F.col("older")))}
    )
