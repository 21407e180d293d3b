"""Statistics of water use by crop, month, year and region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.functions.sizing import attach, measured
from fieldwater.operators.clean import mask_outside_season, recode_crop
from fieldwater.operators.quantiles import quantiles

CROPS = tuple(codes.CROP_BY_CODE.values())


def crop_use(water: DataFrame, cover: DataFrame, first_month: int = 4, last_month: int = 9) -> DataFrame:
    """Long table (year, month, crop, value) of the months in range: water use by cell joined to its class.

    Neither side is broadcast: a cover repeated for its years is many times the size its files tell.
    """
    wanted = water.where(F.col("month").between(first_month, last_month) & F.col("value").isNotNull())
    classes = cover.where((F.col("value").isNotNull()) & (F.col("value") != codes.MISSING_CODE)).select(
        "year", "row", "col", recode_crop(F.col("value")).alias("crop")
    )
    return wanted.join(classes.hint("merge"), ["year", "row", "col"]).select("year", "month", "crop", "value")


def crop_month_spread(use: DataFrame, year_round: str = codes.YEAR_ROUND_CROP) -> DataFrame:
    """Mean and sample deviation by crop and month, within the season of the crop, in calendar order."""
    grouped = use.groupBy("crop", "month").agg(F.avg("value").alias("mean_use"), F.stddev_samp("value").alias("sd_use"))
    in_season = {
        c: mask_outside_season(F.col(c), F.col("crop"), F.col("month"), year_round) for c in ("mean_use", "sd_use")
    }
    return grouped.withColumns(in_season).na.drop("any", subset=["mean_use", "sd_use"])


def crop_month_means(use: DataFrame, keys: Sequence[str] = ("crop", "month"), value: str = "value") -> DataFrame:
    return use.groupBy(*keys).agg(F.avg(value).alias(value))


def crop_counts(cover: DataFrame) -> DataFrame:
    """Cells of each known crop per year."""
    known = cover.where(F.col("value").isin(list(codes.CROP_BY_CODE)))
    named = known.select("year", recode_crop(F.col("value")).alias("crop"))
    return named.groupBy("year", "crop").agg(F.count(F.lit(1)).alias("cells"))


def mean_crop_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("crop").agg(F.avg("cells").alias("cells"))


def region_shares(
    zoned: DataFrame, crops: Sequence[str] = CROPS, keys: Sequence[str] = ("region", "year"), crop: str = "crop"
) -> DataFrame:
    """Percentage of each listed crop among the listed crops of a region and year, one column per crop.

    A crop the region does not have is missing, not 0. Conditional counts in
    one aggregation: no separate pass to find the pivot values.
    """
    counted = zoned.groupBy(*keys).agg(*[F.count_if(F.col(crop) == c).alias(c) for c in crops])
    total = sum((F.col(f"`{c}`") for c in crops), F.lit(0))
    shares = {c: F.try_divide(F.nullif(F.col(f"`{c}`"), F.lit(0)) * 100.0, F.col("Total")) for c in crops}
    return counted.withColumn("Total", total).withColumns(shares)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers by group: quartiles, whiskers (extreme values inside the fences), outlier count."""
    quartiles = measured(quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "med", "q3"]))
    rows = attach(df.where(F.col(value).isNotNull()).select(*keys, value), quartiles, list(keys))
    span = (F.col("q3") - F.col("q1")) * reach
    inside = F.col(value).between(F.col("q1") - span, F.col("q3") + span)
    return rows.groupBy(*keys).agg(
        F.min("q1").alias("q1"),
        F.min("med").alias("med"),
        F.min("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def kernel_density(
    df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, points: int = 200
) -> DataFrame:
    """Gaussian density by group on an even grid, with Scott's bandwidth n^(-1/5) * deviation.

    Equal values are merged first. Each remaining value is spread over the
    fixed grid and summed on the map side, so only groups x points rows move.
    """
    rows = df.where(F.col(value).isNotNull())
    merged = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    shape = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"))
    width = F.pow(F.col("_n"), F.lit(-0.2)) * F.col("_sd")
    shape = measured(shape.select(*keys, "_n", width.alias("_h")).where(F.col("_h") > 0))
    step = (high - low) / (points - 1)
    spread = attach(merged, shape, list(keys)).select(
        *keys, value, "_c", "_n", "_h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")
    )
    at = F.col("_i") * step + low
    z = (at - F.col(value)) / F.col("_h")
    height = F.exp(-z * z / 2) / (F.col("_h") * (2 * 3.141592653589793) ** 0.5) * F.col("_c") / F.col("_n")
    return (
        spread.groupBy(*keys, "_i")
        .agg(F.sum(height).alias("density"))
        .select(*keys, (F.col("_i") * step + low).alias("at"), "density")
    )
