"""Row cleaning, category rules, recodes and unit changes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.functions.scalar import contains_text, double_columns, finite_or_null, lookup


def infinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL."""
    return df.withColumns({c: finite_or_null(F.col(c)) for c in double_columns(df)})


def clean_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop every row with a missing, NaN or infinite value."""
    return infinite_to_null(df).na.drop("any", subset=list(subset) if subset else None)


def normalize_category(
    value: Column, rules: Mapping[str, str] = codes.CROP_BY_SUBSTRING
) -> Column:
    """Replace a label by the category of the first rule whose text it contains; others stay."""
    chain = F
    for text, category in rules.items():
        chain = chain.when(contains_text(value, text), F.lit(category))
    return chain.otherwise(value)


def collapse_label(value: Column, text: str = "Soybean", label: str = "Soybeans") -> Column:
    """Trim a label, or collapse it when it contains ``text``."""
    return F.when(value.contains(text), F.lit(label)).otherwise(F.trim(value))


def order_columns(df: DataFrame, names: Sequence[str] | None = None, alphabetical: bool = False) -> DataFrame:
    """Select columns in the given order (alphabetical by default); absent names become NULL columns."""
    wanted = sorted(names or df.columns) if names is None or alphabetical else list(names)
    present = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in present else F.lit(None).cast("double").alias(c) for c in wanted])


def drop_attributes(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def recode_crop(code: Column, missing_label: str | None = None) -> Column:
    """Crop name of a land-cover code: missing for 0, "Other" for codes outside the book."""
    named = lookup(codes.CROP_BY_CODE, code.cast("int"), F.lit(codes.OTHER_CROP))
    missing = F.lit(missing_label).cast("string")
    return F.when(code.isNull() | (code == codes.MISSING_CODE), missing).otherwise(named)


def crop_coefficient(crop: Column, strict: bool = True) -> Column:
    """Crop coefficient. An unknown crop is an error, or NULL when not strict."""
    found = lookup(codes.CROP_COEFFICIENT, crop)
    if not strict:
        return found
    message = F.concat(F.lit("no crop coefficient for "), crop)
    return F.when(crop.isNull() | found.isNotNull(), found).otherwise(F.raise_error(message).cast("double"))


def effective_precipitation(precipitation: Column, infiltration: Column) -> Column:
    return precipitation - infiltration


def soil_group_to_infiltration(df: DataFrame, group_col: str = "SWB_HSG", drop_group: bool = True) -> DataFrame:
    """Add ``INF_RATE`` from the soil group; dual groups 5..8 fold onto 1..4, unknown groups give NULL."""
    if group_col not in df.columns:
        return df
    group = F.col(group_col).cast("int")
    folded = F.when(group <= 4, group).otherwise(group - 4)
    out = df.withColumn("INF_RATE", lookup(codes.INFILTRATION_BY_GROUP, folded))
    return out.drop(group_col) if drop_group else out


def to_millimetres(df: DataFrame, target: str = "AF_Acre") -> DataFrame:
    """Feet to mm for the target, inches to mm for soil-water predictors and effective precipitation."""
    factors = {}
    for name in df.columns:
        if name == target:
            factors[name] = codes.FEET_TO_MM
        elif name == "EFF_PPT" or (name.startswith("SWB") and name != "SWB_HSG"):
            factors[name] = codes.INCH_TO_MM
    return df.withColumns({c: F.col(c) * k for c, k in factors.items()})


def depth_to_volume(depth_mm: Column) -> Column:
    """m3 of a depth in mm on a 100 m cell."""
    return depth_mm * codes.MM_TO_M3_PER_HECTARE_CELL


def depth_to_comparison_units(depth_mm: Column) -> Column:
    """Comparison units of a depth in mm on a 1 km cell."""
    return depth_mm * codes.MM_PER_KM2_TO_COMPARISON


def keep_known_crops(df: DataFrame, crop_col: str, crops: Sequence[str] = codes.MODEL_CROPS) -> DataFrame:
    return df.where(F.col(crop_col).isin(list(crops)))


def mask_missing_class(df: DataFrame, class_col: str, predictor: str) -> DataFrame:
    """Null a predictor where the crop class is missing, so the cell is not scored."""
    return df.withColumn(predictor, F.when(F.col(class_col).isNotNull(), F.col(predictor)))


def mask_outside_season(value: Column, crop: Column, month: Column, year_round: str = codes.YEAR_ROUND_CROP) -> Column:
    """Null a value outside the growing season, except for the crop reported all year."""
    return F.when((crop == year_round) | month.isin(list(codes.GROWING_MONTHS)), value)


def impute_remembering(df: DataFrame, columns: Sequence[str], fill: float = 0.0, flag: str = "any_missing") -> DataFrame:
    """Fill missing, NaN and infinite predictors and flag the rows where any was filled."""
    cleaned = {c: finite_or_null(F.col(c).cast("double")) for c in columns}
    missing = F.lit(False)
    for value in cleaned.values():
        missing = missing | value.isNull()
    return df.withColumns({flag: missing, **{c: F.coalesce(v, F.lit(fill)) for c, v in cleaned.items()}})
