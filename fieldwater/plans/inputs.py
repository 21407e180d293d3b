"""From monthly rows to model inputs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.operators.clean import (
    clean_rows,
    crop_coefficient,
    effective_precipitation,
    keep_known_crops,
    order_columns,
    soil_group_to_infiltration,
    to_millimetres,
)
from fieldwater.operators.features import MONTHS, MinMaxScaler, indicator_name, one_hot, vocabulary
from fieldwater.operators.grid import GridSpec, sample_predictors
from fieldwater.operators.metering import relative_et
from fieldwater.operators.nearest import link_to_fields
from fieldwater.operators.outliers import Fence, remove_outliers
from fieldwater.operators.split import TRAIN, split_train_test


def prepare(
    rows: DataFrame,
    cells: DataFrame,
    specs: dict[str, GridSpec],
    datasets: Sequence[str],
    key: str,
    fields: DataFrame | None = None,
    x: str = "long_dd",
    y: str = "lat_dd",
    sub_columns: Sequence[str] | None = None,
    crop_coefficients: bool = False,
    relative: bool = False,
    effective: tuple[str, str] | None = None,
    plane: str | None = None,
) -> DataFrame:
    """Link rows to fields, sample every predictor, and add the optional derived predictors.

    ``effective`` names the precipitation and infiltration columns, ``plane``
    the projection that distances to fields are measured in. Columns come back
    in alphabetical order.
    """
    out = rows.select(key, *sub_columns) if sub_columns else rows
    if fields is not None:
        out = link_to_fields(out, fields, x=x, y=y, plane=plane)
    out = sample_predictors(out, cells, specs, x, y, key, datasets)
    return order_columns(derive(out, crop_coefficients, relative, effective))


def derive(
    rows: DataFrame,
    crop_coefficients: bool = False,
    relative: bool = False,
    effective: tuple[str, str] | None = None,
    means: DataFrame | None = None,
) -> DataFrame:
    """The optional derived predictors. Map cells are given the crop ``means`` of the training rows."""
    out = rows
    if crop_coefficients:
        out = out.withColumn("CC", crop_coefficient(F.col("crop")))
    if relative:
        out = relative_et(out, means=means)
    if effective and all(c in out.columns for c in effective):
        out = out.withColumn("EFF_PPT", effective_precipitation(F.col(effective[0]), F.col(effective[1])))
    return out


@dataclass
class ModelInputs:
    """Encoded (and scaled) rows with their split, the feature names, and what is needed to encode others alike."""

    rows: DataFrame
    columns: list[str]
    base_columns: list[str]
    vocabularies: dict[str, list]
    scaler: MinMaxScaler | None
    target: str


def model_inputs(
    rows: DataFrame,
    key: str,
    target: str = "AF_Acre",
    crop_col: str = "crop",
    year_col: str = "Year",
    drop: Sequence[str] = (),
    years: Sequence[int] = (),
    outlier_operation: int = 0,
    fence_reach: float = 1.5,
    split_strategy: int = 2,
    test_size: float = 0.2,
    test_years: Sequence[int] | bool | None = True,
    seed: int = 42,
    scaling: bool = False,
    encode_crop: bool = True,
    soil_to_rate: bool = True,
) -> ModelInputs:
    """Drop attributes, clean, select years, remove outliers, convert units, split, encode and scale.

    The vocabularies and the scaler are fixed on the training rows. Year, crop
    and month stay beside the encoded columns for later grouping.
    """
    droppable = [c for c in drop if c not in (crop_col, year_col, key)]
    kept = clean_rows(rows.drop(*droppable))
    if years:
        kept = kept.where(F.col(year_col).isin(list(years)))
    kept = keep_known_crops(kept, crop_col, codes.MODEL_CROPS)
    kept = remove_outliers(kept, target, crop_col, year_col, outlier_operation, Fence(fence_reach))
    kept = to_millimetres(kept, target)
    if soil_to_rate:
        kept = soil_group_to_infiltration(kept)
    # The split, the vocabularies and the scaler each read the cleaned rows again.
    kept = kept.persist()
    parted = split_train_test(
        kept, key, split_strategy, test_size, test_years, year_col, crop_col, seed
    )
    train = parted.where(F.col("DATA") == TRAIN)
    vocabularies: dict[str, list] = {}
    if encode_crop and crop_col not in drop:
        vocabularies[crop_col] = vocabulary(train, crop_col)
    if not soil_to_rate and "SWB_HSG" in parted.columns:
        vocabularies["SWB_HSG"] = vocabulary(train, "SWB_HSG")
    vocabularies["Month"] = list(MONTHS)
    encoded = one_hot(parted, vocabularies, drop=False)
    apart = {key, target, year_col, crop_col, "DATA", "Month", *vocabularies}
    base = sorted(c for c in kept.columns if c not in apart)
    columns = sorted([*base, *[indicator_name(c, v) for c, values in vocabularies.items() for v in values]])
    scaler = None
    if scaling:
        scaler = MinMaxScaler.fit(encoded.where(F.col("DATA") == TRAIN), [*columns, target])
        encoded = scaler.transform(encoded)
    return ModelInputs(encoded, columns, base, vocabularies, scaler, target)
