"""Meter readings: monthly totals, profiles, weights, disaggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.functions import codes
from fieldwater.functions.scalar import contains_text, one_of
from fieldwater.functions.sizing import attach, measured
from fieldwater.operators.clean import clean_rows, collapse_label, normalize_category
from fieldwater.operators.outliers import BY_CROP, Fence, remove_outliers


def with_year_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"Year": F.year(ts), "Month": F.month(ts)})


def valid_readings(readings: DataFrame, ts: str = "datetime", value: str = "value", years: Sequence[int] = ()) -> DataFrame:
    """Finite, non-negative readings of the requested years (all years when none are given)."""
    rows = readings
    if years:
        rows = rows.where(F.year(ts).isin(list(years)))
    return clean_rows(rows).where(F.col(value) >= 0)


def monthly_totals(
    readings: DataFrame, site: str = "site_no", ts: str = "datetime", value: str = "value", years: Sequence[int] = ()
) -> DataFrame:
    """Total per site and month. A month without readings yields no row."""
    rows = with_year_month(valid_readings(readings, ts, value, years), ts)
    return rows.groupBy(site, "Year", "Month").agg(F.sum(value).alias(value))


def monthly_means(
    readings: DataFrame, site: str = "site_no", ts: str = "datetime", value: str = "value", years: Sequence[int] = ()
) -> DataFrame:
    """Mean per site and month."""
    rows = with_year_month(valid_readings(readings, ts, value, years), ts)
    return rows.groupBy(site, "Year", "Month").agg(F.avg(value).alias(value))


def climatology(site_months: DataFrame, value: str = "value") -> DataFrame:
    """Mean of the site-month means per calendar month; every site-month weighs the same."""
    return site_months.groupBy("Month").agg(F.avg(value).alias(value))


def use_per_area(
    totals: DataFrame, sites: DataFrame, keys: Sequence[str], value: str = "value", area: str = "acres", out: str = "AF_Acre"
) -> DataFrame:
    """Join totals to sites with positive area and divide. Repeated site rows multiply the totals."""
    positive = sites.where(F.col(area) > 0)
    joined = totals.join(positive, list(keys))
    return joined.withColumn(out, F.col(value) / F.col(area))


def aquaculture_profile(
    readings: DataFrame,
    sites: DataFrame,
    years: Sequence[int] = (2018, 2019, 2020),
    state: str | None = "MS",
    crop_text: str = "fish",
) -> DataFrame:
    """Mean monthly use of aquaculture sites over the given years: (Month, value)."""
    wanted = sites.where(contains_text(F.col("crop"), crop_text) & F.col("Year").isin(list(years)))
    if state:
        wanted = wanted.where(F.col("State") == state)
    means = monthly_means(readings, years=years)
    return climatology(means.join(wanted.select("site_no", "Year"), ["site_no", "Year"]))


def profile_constants(spark, profiles=codes.MONTHLY_PROFILE) -> DataFrame:
    """The fixed profiles as rows (crop, month, use)."""
    rows = [(c, m + 1, v) for c, values in profiles.items() for m, v in enumerate(values)]
    return spark.createDataFrame(rows, "crop string, month int, use double")


def monthly_weights(profile: DataFrame, crop: str = "crop", month: str = "month", use: str = "use") -> DataFrame:
    """Share of each month in its crop's yearly use: (crop, month, weight). Missing months weigh 0.

    A profile has at most twelve rows per crop, so its window stays tiny.
    """
    total = F.sum(use).over(W.partitionBy(crop))
    share = F.coalesce(F.try_divide(F.coalesce(F.col(use), F.lit(0.0)), total), F.lit(0.0))
    return profile.select(crop, month, share.alias("weight"))


def disaggregate(
    annual: DataFrame,
    weights: DataFrame,
    value: str = "AF_Acre",
    crop: str = "crop",
    month: str = "month",
    out_month: str = "Month",
) -> DataFrame:
    """Spread a yearly value over the months: twelve rows per input row.

    The weights of a crop are folded into one row before the join, so the
    annual table is joined one-to-one and expanded in place. Rows of crops
    without a profile are dropped.
    """
    table = weights.groupBy(crop).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(month).cast("int"), F.col("weight")))).alias("_w")
    )
    joined = attach(annual, measured(table), [crop])
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias(out_month)
    spread = joined.select("*", months)
    weight = F.coalesce(F.try_element_at("_w", F.col(out_month)), F.lit(0.0))
    return spread.withColumn(value, F.col(value) * weight).drop("_w")


def group_means(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """(group, mean_<column>, ...): one row per group, for the columns the table has."""
    return df.groupBy(group).agg(*[F.avg(f"`{c}`").alias(f"mean_{c}") for c in columns if c in df.columns])


def relative_to_group(
    df: DataFrame, columns: Sequence[str], group: str, prefix: str = "Relative_", means: DataFrame | None = None
) -> DataFrame:
    """Divide each column by its mean in the group. Means are aggregated, never windowed.

    With ``means`` (of ``group_means``) the given ones hold, as a model's map
    cells need the means of its training rows; a group they lack has no ratio.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    known = group_means(df, present, group) if means is None else means.select(group, *[f"mean_{c}" for c in present])
    joined = attach(df, measured(known), [group], "inner" if means is None else "left")
    ratios = {f"{prefix}{c}": F.try_divide(F.col(f"`{c}`"), F.col(f"`mean_{c}`")) for c in present}
    return joined.withColumns(ratios).drop(*[f"mean_{c}" for c in present])


def relative_et(df: DataFrame, crop: str = "crop", means: DataFrame | None = None) -> DataFrame:
    return relative_to_group(df, codes.ET_PRODUCTS, crop, means=means)


def monthly_estimates(
    annual: DataFrame, weights: DataFrame, operation: int = BY_CROP, fence: Fence = Fence()
) -> DataFrame:
    """Annual readings (crop, Year, AF_Acre, lat_dd, long_dd) to monthly rows after outlier removal."""
    labelled = annual.withColumn("crop", collapse_label(F.col("crop")))
    kept = remove_outliers(labelled, "AF_Acre", "crop", "Year", operation, fence)
    return disaggregate(kept, weights).na.drop("any")


def monthly_use(
    readings: DataFrame,
    sites: DataFrame,
    annual: DataFrame | None = None,
    years: Sequence[int] = (),
    states: Sequence[str] = (),
    outlier_operation: int = BY_CROP,
) -> DataFrame:
    """The monthly water-use table: metered sites (``RT``) and disaggregated annual readings (``VMP``)."""
    wanted = sites
    if states:
        wanted = wanted.where(one_of(F.col("State"), states, ignore_case=True))
    if years:
        wanted = wanted.where(F.col("Year").isin(list(years)))
    named = wanted.withColumn("crop", normalize_category(F.col("crop")))
    totals = monthly_totals(readings, years=years)
    metered = use_per_area(totals, named, ["site_no", "Year"]).withColumn("Data", F.lit("RT"))
    if annual is None:
        return metered
    profile = profile_constants(readings.sparkSession).unionByName(
        aquaculture_profile(readings, sites).select(
            F.lit("Fish Culture").alias("crop"), F.col("Month").alias("month"), F.col("value").alias("use")
        )
    )
    estimates = monthly_estimates(annual, monthly_weights(profile), outlier_operation)
    return metered.unionByName(estimates.withColumn("Data", F.lit("VMP")), allowMissingColumns=True)
