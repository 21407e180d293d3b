"""The end-to-end plan: meters to a tuned model, model to maps, maps to comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.config import RunConfig
from fieldwater.functions import codes
from fieldwater.functions.geo import centroid_of, reproject, rings_of
from fieldwater.operators import compare, grid, polygons, regrid
from fieldwater.operators.clean import to_millimetres
from fieldwater.operators.evaluate import split_metrics
from fieldwater.operators.explain import partial_dependence
from fieldwater.operators.features import assemble, vocabulary
from fieldwater.operators.grid import GridSpec
from fieldwater.operators.metering import group_means, monthly_use
from fieldwater.operators.scoring import predictor_frame, score_cells, score_maps
from fieldwater.operators.split import TRAIN
from fieldwater.operators.tuning import SearchResult, per_crop_models, predict_per_crop, prediction_table, search
from fieldwater.plans.inputs import ModelInputs, derive, model_inputs, prepare
from fieldwater.sources import rasters, stages, tables

KEY = "row_id"


@dataclass
class Inputs:
    """Opened input tables. Optional ones may be None."""

    readings: DataFrame
    sites: DataFrame
    annual: DataFrame | None
    fields: DataFrame | None
    cells: DataFrame
    specs: dict[str, GridSpec]
    land_cover: DataFrame | None = None
    irrigation: DataFrame | None = None
    hydrography: DataFrame | None = None
    map_extent: DataFrame | None = None
    cover_grid: GridSpec | None = None
    mask_grid: GridSpec | None = None


def open_inputs(spark: SparkSession, conf: RunConfig) -> Inputs:
    """Open every table a configuration names. Nothing is read yet."""
    rings = lambda path: tables.read_rings(spark, path) if path else None
    grids = lambda path: rasters.read_cells(spark, path) if path else None
    rasters.check_products(conf.predictors)
    return Inputs(
        readings=tables.read_readings(spark, conf.readings, conf.columns),
        sites=tables.read_sites(spark, conf.sites, conf.columns),
        annual=tables.read_annual(spark, conf.annual, conf.columns) if conf.annual else None,
        fields=rings(conf.fields),
        cells=rasters.with_fallbacks(rasters.read_cells(spark, conf.cells), conf.predictors),
        specs=rasters.read_specs(spark, conf.cells, conf.predictors),
        land_cover=grids(conf.land_cover),
        irrigation=grids(conf.irrigation),
        hydrography=rings(conf.hydrography),
        map_extent=rings(conf.map_extent),
        cover_grid=rasters.read_spec(spark, conf.land_cover) if conf.land_cover else None,
        mask_grid=rasters.read_spec(spark, conf.irrigation) if conf.irrigation else None,
    )


# Wells, fields and predictors come in longitude and latitude; lengths and areas are taken in this projection.
PLANE = "albers"


def field_centroids(fields: DataFrame, permit: str = "PermitNumb", year: str = "Year") -> DataFrame:
    """Fields to (year, permit, long_dd, lat_dd): the centroid of the projected rings, in degrees again."""

    def flat(p):
        x, y = reproject(p["x"], p["y"], "lonlat", PLANE)
        return F.struct(x.alias("x"), y.alias("y"))

    # Exploded out of an array of one, so that vertices are projected once and not again for every term.
    planar = F.transform(rings_of(fields, "ring"), lambda ring: F.transform(ring, flat))
    rings = fields.select(year, permit, F.explode(F.array(planar)).alias("_rings"))
    lon, lat = reproject(*centroid_of(F.col("_rings")), PLANE, "lonlat")
    return rings.select(F.col(year), F.col(permit), lon.alias("long_dd"), lat.alias("lat_dd"))


def effective_columns(conf: RunConfig) -> tuple[str, str] | None:
    return ("SWB_PPT", "SWB_INF") if conf.effective_precipitation else None


def training_rows(spark: SparkSession, conf: RunConfig, inputs: Inputs) -> DataFrame:
    """Monthly use table, then prepared rows; both are stages that can be reused."""

    def build_monthly() -> DataFrame:
        return monthly_use(
            inputs.readings, inputs.sites, inputs.annual, (), conf.states, conf.annual_outlier_operation
        )

    monthly = stages.stage(spark, f"{conf.output}/monthly", build_monthly, conf.reuse_monthly)

    def build_prepared() -> DataFrame:
        kept = monthly.select(*conf.sub_columns) if conf.use_sub_columns else monthly
        # A content hash with a count of copies names each row the same way on every run.
        rows = kept.withColumn(KEY, F.sha2(F.to_json(F.struct(*kept.columns)), 256))
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
        copies = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")
        rows = rows.select(*[c for c in rows.columns if c != "_n"], copies)
        rows = rows.withColumn(KEY, F.concat_ws("-", KEY, "_i")).drop("_i")
        centroids = field_centroids(inputs.fields) if inputs.fields is not None else None
        return prepare(
            rows, inputs.cells, inputs.specs, conf.predictors, KEY, centroids,
            crop_coefficients=conf.crop_coefficient, relative=conf.relative_et,
            effective=effective_columns(conf), plane=PLANE,
        )

    return stages.stage(spark, f"{conf.output}/prepared", build_prepared, conf.reuse_prepared)


def encode(rows: DataFrame, conf: RunConfig) -> ModelInputs:
    return model_inputs(
        rows, KEY, drop=conf.drop_attributes, years=conf.train_years, outlier_operation=conf.model_outlier_operation,
        split_strategy=conf.split_strategy, test_size=conf.test_size, test_years=conf.test_years, seed=conf.seed,
        scaling=conf.scaling, encode_crop=not conf.per_crop_models, soil_to_rate=conf.soil_group_to_infiltration,
    )


@dataclass
class Trained:
    inputs: ModelInputs
    model: Model | dict[str, Model]
    found: SearchResult | None
    predictions: DataFrame
    metrics: DataFrame


def train(spark: SparkSession, conf: RunConfig, rows: DataFrame) -> Trained:
    """Tune on the training split (or load the saved model), predict both splits, and measure them."""
    made = encode(rows, conf)
    vectors = assemble(made.rows.withColumn("label", F.col(made.target)), made.columns).persist()
    training = vectors.where(F.col("DATA") == TRAIN)
    # Any test year given means that splits and folds are stratified by year, else by crop.
    strata = ["Year" if conf.test_years else "crop"] if conf.stratified_folds else []

    def fit(part: DataFrame, folds_by=strata) -> SearchResult:
        return search(
            part, conf.model, KEY, folds=conf.folds, repeats=conf.repeats, strata=folds_by, grid=conf.parameter_grid,
            draws=conf.search_draws if conf.randomized_search else None, seed=conf.seed, parallelism=conf.parallelism,
        )

    found, model_path = None, f"{conf.model_dir or conf.output}/model-{conf.model}"
    if conf.per_crop_models:
        model = per_crop_models(training, vocabulary(training, "crop"), lambda part: fit(part, []).model)
        scored = predict_per_crop(model, vectors)
        predict: Callable = lambda rows_: scored
        table = prediction_table(_Scored(predict), vectors, made.scaler, made.target, made.columns)
    else:
        if conf.reuse_model:
            model = stages.load_model(conf.model, model_path)
        else:
            found = fit(training)
            model = found.model
            stages.save_model(model, model_path)
        table = prediction_table(model, vectors, made.scaler, made.target, made.columns)
    if made.scaler is not None:
        stages.save_scaler(made.scaler, spark, f"{model_path}-scaler")
    predictions = stages.stage(spark, f"{conf.output}/predictions", lambda: table)
    measured = split_metrics(predictions)
    tables.write_csv(measured, f"{conf.output}/metrics.csv")
    for feature in conf.partial_dependence:
        curve = partial_dependence(model, training, made.columns, feature)
        tables.write_csv(curve, f"{conf.output}/dependence-{feature}.csv")
    return Trained(made, model, found, predictions, measured)


class _Scored:
    """Stands where a model is expected when the rows are scored already."""

    def __init__(self, transform):
        self.transform = transform


def _named(shapes: DataFrame) -> DataFrame:
    """Polygons with an id made of their content, the same when a lost task runs again; repeated polygons count once."""
    keys = [c for c in ("year",) if c in shapes.columns]
    return shapes.withColumn("_id", F.md5(F.to_json("ring"))).dropDuplicates(["_id", *keys])


def map_extent(spark: SparkSession, conf: RunConfig, inputs: Inputs, target: GridSpec) -> DataFrame:
    """Yearly class cells inside the map extent: land cover of the most area, corrected, clipped.

    All years are one table; fields burn per year, hydrography once.
    """

    def build() -> DataFrame:
        years = list(conf.predict_years)
        wanted = lambda df: df.where(F.col("year").isin(years)) if years else df
        cover = regrid.area_regrid(wanted(inputs.land_cover), inputs.cover_grid, target, "mode", ["year"])
        mask = regrid.area_regrid(wanted(inputs.irrigation), inputs.mask_grid, target, "mode", ["year"])
        fields = _named(inputs.fields.withColumnRenamed("Year", "year"))
        burned = polygons.burn(fields, target, "_id", keys=["year"])
        water = polygons.burn(_named(inputs.hydrography), target, "_id")
        fixed = grid.correct_land_cover_cells(cover, water, mask, burned, ["year"])
        if inputs.map_extent is None:
            return fixed
        return polygons.clip(fixed, _named(inputs.map_extent), target, "_id")

    return stages.stage(spark, f"{conf.output}/extent", build, conf.reuse_extent, ["year"])


def predict_maps(
    spark: SparkSession, conf: RunConfig, inputs: Inputs, trained: Trained, target: GridSpec
) -> tuple[DataFrame, DataFrame]:
    """Fine and coarse maps of every requested month, in one job each."""
    extent = map_extent(spark, conf, inputs, target)
    predictors = rasters.prune_products(conf.predictors, conf.drop_attributes)
    months = range(conf.first_month, conf.last_month + 1)

    def build_predictors() -> DataFrame:
        parts = []
        for name in predictors:
            keys = {"monthly": ["dataset", "year", "month"], "yearly": ["dataset", "year"], "static": ["dataset"]}
            kept = keys[codes.temporal_kind(name)]
            moved = regrid.regrid(inputs.cells.where(F.col("dataset") == name), inputs.specs[name], target, "near", kept)
            parts.append(moved)
        long = parts[0]
        for part in parts[1:]:
            long = long.unionByName(part, allowMissingColumns=True)
        frame = predictor_frame(
            extent, target, long, predictors, list(months), conf.soil_group_to_infiltration, ("long_dd", "lat_dd")
        )
        means = spark.read.parquet(f"{conf.output}/crop-means") if conf.relative_et else None
        derived = derive(frame, conf.crop_coefficient, conf.relative_et, effective_columns(conf), means)
        # Training rows were converted too, so the model sees the same units.
        return to_millimetres(derived, trained.inputs.target)

    frame = stages.stage(spark, f"{conf.output}/predictors", build_predictors, conf.reuse_predictors, ["year", "month"])

    def build_scores() -> DataFrame:
        made = trained.inputs
        apart = {c: v for c, v in made.vocabularies.items() if c not in ("crop", "Month")}
        crops = made.vocabularies.get("crop", [])
        return score_cells(
            trained.model, frame, made.base_columns, crops, made.target, made.scaler, month_col="Month",
            volume_units=conf.volume_units, other_classes=apart,
        )

    scored = stages.stage(spark, f"{conf.output}/scores", build_scores, conf.reuse_scores, ["year", "month"])
    fine, coarse = score_maps(scored)
    for name, cells, spec in (("fine", fine, target), ("coarse", coarse, target.coarser(10))):
        rasters.write_cells(cells.withColumn("dataset", F.lit("use")), f"{conf.output}/map-{name}", spec, name)
    return fine, coarse


def compare_maps(spark: SparkSession, conf: RunConfig, coarse: DataFrame, coarse_grid: GridSpec) -> DataFrame:
    """Align an older model to the coarse map by coordinates and write totals, differences and season totals."""
    older_grid = rasters.read_spec(spark, conf.older_model)
    older = rasters.read_cells(spark, conf.older_model)
    aligned = regrid.regrid(older, older_grid, coarse_grid, "near", ["year", "month"])
    newer = coarse
    if not conf.volume_units:
        newer = coarse.withColumn("value", F.col("value") * codes.MM_PER_KM2_TO_COMPARISON)
    matched = stages.stage(spark, f"{conf.output}/matched", lambda: compare.match_models(aligned, newer))
    totals = compare.monthly_model_totals(matched)
    tables.write_csv(totals.orderBy("year", "month"), f"{conf.output}/model-totals.csv")
    compare.cell_differences(matched).write.mode("overwrite").partitionBy("year", "month").parquet(f"{conf.output}/differences")
    compare.season_totals(matched).write.mode("overwrite").partitionBy("year").parquet(f"{conf.output}/season-totals")
    return compare.mean_month_comparison(totals)


def run(spark: SparkSession, conf: RunConfig, target: GridSpec | None = None) -> Trained:
    """Everything a configuration asks for."""
    inputs = open_inputs(spark, conf)
    rows = training_rows(spark, conf, inputs)
    if conf.relative_et:
        # What the model's ratios are relative to; the map's cells are given the same.
        stages.stage(spark, f"{conf.output}/crop-means", lambda: group_means(rows, codes.ET_PRODUCTS, "crop"))
    trained = train(spark, conf, rows)
    if inputs.land_cover is not None:
        if target is None or conf.per_crop_models:
            raise ValueError("a map needs a target grid and one model for all crops")
        _, coarse = predict_maps(spark, conf, inputs, trained, target)
        if conf.compare_models:
            compare_maps(spark, conf, coarse, target.coarser(10))
    return trained
