"""Scoring every grid cell of every month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.functions.sizing import dealt
from fieldwater.operators.clean import depth_to_volume, impute_remembering, mask_missing_class, recode_crop, soil_group_to_infiltration
from fieldwater.operators.features import MONTHS, MinMaxScaler, assemble, indicator_name, one_hot
from fieldwater.operators.grid import GridSpec, coarse_sum, with_coordinates

CELL_MONTH = ("year", "month", "row", "col")


def predictor_frame(
    cover: DataFrame,
    spec: GridSpec,
    predictors: DataFrame,
    datasets: Sequence[str],
    months: Sequence[int],
    soil_to_rate: bool = True,
    coordinates: tuple[str, str] = ("lon", "lat"),
) -> DataFrame:
    """One row per cell and month: class, coordinates and every predictor as a column.

    ``class_missing`` marks the cells without a class, which are not scored
    whichever predictors a model uses.

    ``predictors`` is the long table (dataset, year, month, row, col, value)
    already on the target grid. One pivot per kind of product (monthly,
    yearly, static) serves all months. A cell's monthly values meet it as one
    list a year and are taken apart where the months are made, so the product
    of cells and months is never shuffled; cells are dealt by their count.
    """
    months = [int(m) for m in months]
    cells = cover.select("year", "row", "col", F.col("value").alias("_class"))
    out = with_coordinates(cells, spec, names=coordinates)
    # What does not change with the month is joined before cells are multiplied by months.
    frame_rows = cover.count() * len(months)
    keys_of = {"static": [], "yearly": ["year"], "monthly": ["year", "month"]}
    for kind, keys in keys_of.items():
        names = [d for d in datasets if codes.temporal_kind(d) == kind]
        if names:
            on = [*keys, "row", "col"]
            long = predictors.where(F.col("dataset").isin(names))
            if kind == "monthly":
                long = long.where(F.col("month").isin(months))
            cell = [k for k in on if k != "month"]
            long, out = (dealt(df, cell, frame_rows) for df in (long, out))
            wide = long.groupBy(*on).pivot("dataset", names).agg(F.first("value", ignorenulls=True))
            if kind == "monthly":
                wide = wide.groupBy(*cell).agg(F.collect_list(F.struct("month", *names)).alias("_months"))
            out = out.join(wide.hint("merge"), cell, "left")
    out = out.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    if "_months" in out.columns:
        own = F.get(F.filter("_months", lambda m: m["month"] == F.col("month")), 0)
        monthly = [d for d in datasets if codes.temporal_kind(d) == "monthly"]
        rest = [c for c in out.columns if c not in (*CELL_MONTH, "_months")]
        out = out.withColumn("_own", own).select(*CELL_MONTH, *rest, *[F.col("_own")[d].alias(d) for d in monthly])
    out = out.withColumn("crop", recode_crop(F.col("_class"))).drop("_class")
    masked = mask_missing_class(out, "crop", datasets[0]).withColumn("class_missing", F.col("crop").isNull())
    return soil_group_to_infiltration(masked) if soil_to_rate else masked


def score_cells(
    model: Model,
    cells: DataFrame,
    columns: Sequence[str],
    crops: Sequence,
    target: str,
    scaler: MinMaxScaler | None = None,
    crop_col: str = "crop",
    month_col: str | None = "month",
    volume_units: bool = True,
    variants: Sequence[str] = codes.OTHER_VARIANTS,
    other_classes: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Predicted use per cell and month; missing where the cell had a missing predictor.

    ``columns`` are the model's features before encoding (class and month
    excluded); ``other_classes`` holds the vocabularies of further encoded columns. A cell of class "Other" is scored once per variant crop and
    takes the mean, by extra narrow model passes over just those cells: no
    cell is ever shuffled. The absolute value is taken before unscaling.
    """
    filled = impute_remembering(cells, columns)
    vocabularies = {crop_col: list(crops), **{c: list(v) for c, v in (other_classes or {}).items()}}
    if "class_missing" in cells.columns:
        filled = filled.withColumn("any_missing", F.col("any_missing") | F.col("class_missing"))
    for name in other_classes or {}:
        filled = filled.withColumn("any_missing", F.col("any_missing") | F.col(name).isNull())
    if month_col:
        vocabularies[month_col] = list(MONTHS)
    encoded = one_hot(filled, vocabularies, drop=False)
    names = [*columns, *[indicator_name(c, v) for c, values in vocabularies.items() for v in values]]
    if scaler is not None:
        encoded = scaler.transform(encoded)
    is_other = F.coalesce(F.col(crop_col) == codes.OTHER_CROP, F.lit(False))
    plain = model.transform(assemble(encoded.where(~is_other), names)).withColumn("_use", F.abs("prediction"))
    kept_columns = [c for c in cells.columns if c not in set(columns)]
    plain = plain.select(*kept_columns, "any_missing", "_use")

    other = encoded.where(is_other)
    shares = []
    for i, crop in enumerate(variants):
        name = indicator_name(crop_col, crop)
        kept = F.col(f"`{name}`")
        other = other.withColumn("_held", kept).withColumn(name, F.lit(1.0))
        other = assemble(other, names, f"_f{i}").withColumn(name, F.col("_held")).drop("_held")
        other = model.copy({model.featuresCol: f"_f{i}", model.predictionCol: f"_p{i}"}).transform(other)
        shares.append(F.abs(f"_p{i}"))
    mean = sum(shares[1:], shares[0]) / len(shares)
    both = plain.unionByName(other.withColumn("_use", mean).select(*kept_columns, "any_missing", "_use"))

    use = F.col("_use") if scaler is None else scaler.unscale(target, F.col("_use"))
    if volume_units:
        use = depth_to_volume(use)
    return both.withColumn("value", F.when(~F.col("any_missing"), use)).drop("_use", "any_missing")


def score_maps(scored: DataFrame, factor: int = 10) -> tuple[DataFrame, DataFrame]:
    """The fine map and its block sums."""
    fine = scored.select(*CELL_MONTH, "value")
    return fine, coarse_sum(fine, factor, ["year", "month"])
