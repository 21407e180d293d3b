"""Settings of an end-to-end run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnNames:
    """Column names of the input tables; inputs are renamed to the library's own names on read."""

    site_id_sites: str = "Site_numbe"
    site_id_readings: str = "site_no"
    year: str = "Year"
    crop: str = "crop"
    state: str = "State"
    acres: str = "combined_a"
    lat: str = "lat_dd"
    lon: str = "long_dd"
    timestamp: str = "datetime"
    reading: str = "value"
    annual_crop: str = "Crop(s)"
    annual_year: str = "ReportYear"
    annual_lat: str = "Latitude"
    annual_lon: str = "Longitude"
    permit: str = "PermitNumb"
    target: str = "AF_Acre"


@dataclass(frozen=True)
class RunConfig:
    """What a run reads, how it cleans, splits, tunes and predicts, and where stages are kept."""

    # Inputs: table paths (Parquet folders, or CSV files for the meter tables).
    readings: str = ""
    sites: str = ""
    annual: str = ""
    fields: str = ""
    cells: str = ""
    land_cover: str = ""
    irrigation: str = ""
    hydrography: str = ""
    map_extent: str = ""
    older_model: str = ""
    output: str = ""
    model_dir: str = ""
    columns: ColumnNames = field(default_factory=ColumnNames)

    # Row selection.
    states: tuple[str, ...] = ()
    train_years: tuple[int, ...] = ()
    predict_years: tuple[int, ...] = ()
    first_month: int = 1
    last_month: int = 12
    use_sub_columns: bool = True
    sub_columns: tuple[str, ...] = ("Year", "Month", "AF_Acre", "lat_dd", "long_dd", "crop", "State", "Data")
    drop_attributes: tuple[str, ...] = ("Year", "PermitNumb", "State", "Data")

    # Predictors.
    predictors: tuple[str, ...] = ()
    crop_coefficient: bool = False
    relative_et: bool = False
    effective_precipitation: bool = False
    soil_group_to_infiltration: bool = True

    # Outliers: the annual table and the model rows are treated separately.
    annual_outlier_operation: int = 2
    model_outlier_operation: int = 0

    # Split and tuning.
    split_strategy: int = 2
    test_size: float = 0.2
    test_years: tuple[int, ...] = (2020,)
    scaling: bool = True
    model: str = "DRF"
    per_crop_models: bool = False
    randomized_search: bool = False
    search_draws: int = 10
    folds: int = 5
    repeats: int = 3
    stratified_folds: bool = True
    seed: int = 1234
    parallelism: int = 4
    parameter_grid: dict | None = None

    # Outputs.
    volume_units: bool = True
    compare_models: bool = False
    partial_dependence: tuple[str, ...] = ()

    # Reuse of finished stages.
    reuse_monthly: bool = False
    reuse_prepared: bool = False
    reuse_model: bool = False
    reuse_extent: bool = False
    reuse_predictors: bool = False
    reuse_scores: bool = False
