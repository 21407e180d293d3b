"""Regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwater.functions.sizing import attach, measured


def _squared(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def metric_columns(actual: str = "Actual_GW", predicted: str = "Pred_GW") -> dict[str, Column]:
    """R2, MAE, RMSE and RMSE in percent of the mean, all from mergeable one-pass aggregates.

    The total sum of squares is n times the population variance, which Spark
    merges stably across partitions. R2 is NULL without variance, the
    percentage is NULL at mean zero.
    """
    y, p = F.col(actual), F.col(predicted)
    complete = y.isNotNull() & p.isNotNull()
    y = F.when(complete, y)
    rmse = F.sqrt(F.avg(_squared(y, p)))
    return {
        "r2": 1 - F.try_divide(F.sum(_squared(y, p)), F.var_pop(y) * F.count(y)),
        "mae": F.avg(F.abs(y - p)),
        "rmse": rmse,
        "nrmse": F.try_divide(rmse * 100, F.avg(y)),
    }


def metrics(
    predictions: DataFrame,
    by: Sequence[str] = (),
    actual: str = "Actual_GW",
    predicted: str = "Pred_GW",
    precision: int | None = 3,
) -> DataFrame:
    """Metrics per group (of everything when no group is named)."""
    made = metric_columns(actual, predicted)
    shaped = [(c if precision is None else F.round(c, precision)).alias(n) for n, c in made.items()]
    return predictions.groupBy(*by).agg(*shaped)


def split_metrics(
    predictions: DataFrame,
    split_col: str = "DATA",
    crop_col: str | None = "crop",
    year_col: str | None = "Year",
    actual: str = "Actual_GW",
    predicted: str = "Pred_GW",
    precision: int = 3,
) -> DataFrame:
    """Metrics of every split overall, per crop and per year in one pass over the predictions."""
    extra = [c for c in (crop_col, year_col) if c]
    sets = [[F.col(split_col)], *[[F.col(split_col), F.col(c)] for c in extra]]
    made = metric_columns(actual, predicted)
    keys = [F.col(split_col), *[F.col(c) for c in extra]]
    grouped = predictions.groupingSets(sets, *keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.round(c, precision).alias(n) for n, c in made.items()]
    )
    return grouped


def standardized_residuals(
    predictions: DataFrame, error: str = "Error_GW", by: str = "DATA", months: Sequence[int] | None = None, month: str = "Month"
) -> DataFrame:
    """Error over the standard deviation of the errors of its split, within the given months.

    The deviation is aggregated and attached; a split is never gathered into one window.
    """
    rows = predictions.where(F.col(month).isin(list(months))) if months else predictions
    spread = measured(rows.groupBy(by).agg(F.stddev_samp(error).alias("_sd")))
    return attach(rows, spread, [by]).withColumn("Std_Residuals", F.try_divide(F.col(error), F.col("_sd"))).drop("_sd")


def actual_ranges(predictions: DataFrame, actual: str = "Actual_GW", by: str = "DATA") -> DataFrame:
    return predictions.groupBy(by).agg(F.min(actual).alias("min_actual"), F.max(actual).alias("max_actual"))
