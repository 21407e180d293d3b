"""Upper-fence outlier removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.functions.scalar import lookup
from fieldwater.functions.sizing import attach, measured
from fieldwater.operators.clean import clean_rows, keep_known_crops
from fieldwater.operators.quantiles import quantiles

KEEP_ALL, GLOBAL, BY_CROP, BY_YEAR, FIXED_LIMIT = range(5)


@dataclass(frozen=True)
class Fence:
    """How far above the upper quartile a reading may lie, in interquartile ranges."""

    reach: float = 1.5


def flag_outliers(
    df: DataFrame,
    target: str,
    crop_col: str,
    year_col: str,
    operation: int = BY_CROP,
    fence: Fence = Fence(),
    flag: str = "is_outlier",
) -> DataFrame:
    """Flag readings above the upper limit of their group.

    1 = one limit for all rows, 2 = by crop, 3 = by year, 4 = fixed limit of
    the crop, 0 = nothing is flagged. A missing target is never flagged and
    takes no part in the quartiles.
    """
    if operation == KEEP_ALL:
        return df.withColumn(flag, F.lit(False))
    if operation == FIXED_LIMIT:
        limit = lookup(codes.YEARLY_LIMIT, F.col(crop_col))
        return df.withColumn(flag, F.coalesce(F.col(target) > limit, F.lit(False)))
    keys = {GLOBAL: [], BY_CROP: [crop_col], BY_YEAR: [year_col]}[operation]
    quartiles = quantiles(df, keys, target, [0.25, 0.75], ["_q1", "_q3"])
    limits = measured(quartiles.select(*keys, (F.col("_q3") + fence.reach * (F.col("_q3") - F.col("_q1"))).alias("_max")))
    compared = attach(df, limits, keys, "left")
    return compared.withColumn(flag, F.coalesce(F.col(target) > F.col("_max"), F.lit(False))).drop("_max")


def remove_outliers(
    df: DataFrame,
    target: str,
    crop_col: str,
    year_col: str,
    operation: int = BY_CROP,
    fence: Fence = Fence(),
    crops=codes.MODEL_CROPS,
) -> DataFrame:
    """Keep the modelled crops, drop rows with missing values, then drop outliers."""
    kept = clean_rows(keep_known_crops(df, crop_col, crops) if crops else df)
    flagged = flag_outliers(kept, target, crop_col, year_col, operation, fence)
    return flagged.where(~F.col("is_outlier")).drop("is_outlier")


def outlier_audit(flagged: DataFrame, group_col: str, flag: str = "is_outlier") -> DataFrame:
    """Kept and flagged rows per group."""
    return flagged.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(flag)).alias("flagged"),
    )
