"""Plans stay inside Spark's fast paths, and the end-to-end run works on small tables."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fieldwater import RunConfig
from fieldwater.functions.sizing import measured
from fieldwater.operators import grid, nearest
from fieldwater.operators.grid import GridSpec
from fieldwater.plans import domain
from fieldwater.plans.run import run
from fieldwater.sources import rasters, stages

NO_PYTHON = [
    "monthly_estimates", "relative", "outlier_by_crop", "composite", "composite_catalogue", "nearest_field", "point_sample",
    "burn_sum", "zonal_share", "landcover_fix", "crop_use", "season_total", "holdout", "kfold", "regrid_cubic", "focal_mean", "metrics",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_nested_loops(spark, sf, name):
    plan = plan_of(queries()[name](spark, sf))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    plan = plan_of(grid.composite(domain.cube(spark, sf).where(F.col("flag") == "A"), "sum"))
    assert "l_tax" not in plan.split("== Physical Plan ==")[1]
    assert "EqualTo(l_returnflag,A)" in plan


def test_large_sides_are_not_broadcast(spark):
    few, many = measured(spark.range(10), 20), measured(spark.range(30), 20)
    probe = spark.range(100)
    assert "ResolvedHint" in plan_of(probe.join(few, "id")) or "rightHint=(strategy=broadcast)" in plan_of(probe.join(few, "id"))
    assert "strategy=broadcast" not in plan_of(probe.join(many, "id"))


def test_nearest_shuffles_when_targets_are_many(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(0)
    fields = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((300, 2)))], "f int, x double, y double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((50, 2)))], "p int, x double, y double")
    made = nearest.nearest(points, fields, "f")
    assert "strategy=broadcast" not in plan_of(made).split("== Analyzed")[0]
    want = {p.p: min((((f.x - p.x) ** 2 + (f.y - p.y) ** 2), f.f) for f in fields.collect())[1] for p in points.collect()}
    assert {r.p: r.f for r in made.collect()} == want


def test_partitions_are_pruned(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0, d, y, 1) for d in "ab" for y in (2014, 2015)] + [(0, 1, None, "a", 2014, 1)], rasters.CELL_SCHEMA)
    spec = GridSpec(0, 1, 1, 1, 1, 2)
    path = rasters.write_cells(cells, str(tmp_path / "cells"), spec, "g")
    back = rasters.read_cells(spark, path, ["a"], [2014])
    assert sorted((r["col"], r["value"]) for r in back.collect()) == [(0, 1.0), (1, None)]
    assert "PartitionFilters: [isnotnull(year" in plan_of(back) or "dataset" in plan_of(back).split("PartitionFilters")[1]
    assert spark.read.parquet(path).where("col = 1").first()["value"] == -32767.0
    assert rasters.read_spec(spark, path) == spec


def test_stage_reuse(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert stages.stage(spark, path, lambda: spark.range(3)).count() == 3
    assert stages.stage(spark, path, lambda: spark.range(9), reuse=True).count() == 3
    assert stages.stage(spark, path, lambda: spark.range(9)).count() == 9


def test_catalogue(spark):
    products = rasters.catalogue(spark)
    assert products.count() == 15
    smap = products.where("dataset = 'SMOS_SMAP'")
    picked = [smap.select(rasters.collection_for(F.lit(y), F.lit(m))).first()[0] for y, m in ((2015, 3), (2015, 4), (2014, 12))]
    assert "SMAP10KM" in picked[1] and picked[0] == picked[2] != picked[1]
    with pytest.raises(ValueError):
        rasters.check_products(["SSEBop", "EEMETRIC"])
    assert rasters.prune_products(["PPT", "RO"], ["RO"]) == ["PPT"]


def _ring(x0, y0, x1, y1):
    return [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A small made-up district written in the input formats."""
    root = str(tmp_path_factory.mktemp("district"))
    rng = np.random.default_rng(11)
    crops = ["Rice", "Corn", "Cotton", "Soybeans", "Fish pond"]
    sites, readings, annual = [], [], []
    for i in range(40):
        lon, lat = float(rng.random()), float(rng.random())
        for year in (2018, 2019):
            sites.append((str(i), year, crops[i % 5], "MS" if i % 2 else "AR", 10.0 + i, lat, lon))
            for month in range(4, 10):
                readings.append((str(i), datetime(year, month, 3), float(rng.random() * 20 + 5 * (i % 5))))
        annual.append((crops[i % 4], 2018 + i % 2, float(1 + rng.random()), lat, lon))
    ring = "array<struct<x: double, y: double>>"
    spark.createDataFrame(sites, "Site_numbe string, Year int, crop string, State string, combined_a double, lat_dd double, long_dd double").write.parquet(f"{root}/sites")
    spark.createDataFrame(readings, "site_no string, datetime timestamp, value double").write.option("header", True).csv(f"{root}/readings.csv")
    spark.createDataFrame(annual, "`Crop(s)` string, ReportYear int, AF_Acre double, Latitude double, Longitude double").write.parquet(f"{root}/annual")
    fields = [(y, f"P{i}", _ring(float(x), float(v), float(x + 0.1), float(v + 0.1))) for y in (2018, 2019) for i, (x, v) in enumerate(rng.random((15, 2)) * 0.9)]
    spark.createDataFrame(fields, f"Year int, PermitNumb string, ring {ring}").write.parquet(f"{root}/fields")
    spark.createDataFrame([(_ring(-1.0, -1.0, 0.02, 0.02),)], f"ring {ring}").write.parquet(f"{root}/water")
    spark.createDataFrame([(_ring(0.0, 0.0, 1.0, 1.0),)], f"ring {ring}").write.parquet(f"{root}/extent")
    spec = GridSpec(0, 1, 0.05, 0.05, 20, 20)
    cells = [
        (r, c, float(rng.random() * 100), d, y, m)
        for d in ("SSEBop", "ppt") for y in (2018, 2019) for m in range(1, 13) for r in range(20) for c in range(20)
    ] + [(r, c, float(1 + (r + c) % 8), "SWB_HSG", None, None) for r in range(20) for c in range(20)]
    rasters.write_cells(spark.createDataFrame(cells, rasters.CELL_SCHEMA), f"{root}/cells", spec)
    codes = [0, 1, 2, 3, 5, 7, 83, 92, 111]
    cover = [(r, c, float(codes[int(rng.integers(9))]), "CDL", y, None) for y in (2018, 2019) for r in range(20) for c in range(20)]
    mask = [(r, c, float((r + c) % 3 > 0), "MASK", y, None) for y in (2018, 2019) for r in range(20) for c in range(20)]
    rasters.write_cells(spark.createDataFrame(cover, rasters.CELL_SCHEMA), f"{root}/cover", spec)
    rasters.write_cells(spark.createDataFrame(mask, rasters.CELL_SCHEMA), f"{root}/mask", spec)
    older = [(r, c, 50.0, "old", y, m) for y in (2018, 2019) for m in (5, 6) for r in range(20) for c in range(20)]
    rasters.write_cells(spark.createDataFrame(older, rasters.CELL_SCHEMA), f"{root}/older", spec)
    return root


def test_end_to_end(spark, world, tmp_path):
    conf = RunConfig(
        readings=f"{world}/readings.csv", sites=f"{world}/sites", annual=f"{world}/annual", fields=f"{world}/fields",
        cells=f"{world}/cells", land_cover=f"{world}/cover", irrigation=f"{world}/mask", hydrography=f"{world}/water",
        map_extent=f"{world}/extent", older_model=f"{world}/older", output=str(tmp_path), predictors=("SSEBop", "ppt", "SWB_HSG"),
        train_years=(2018, 2019), predict_years=(2018, 2019), first_month=5, last_month=6, model="DT", folds=2, repeats=1,
        parameter_grid={"maxDepth": [3]}, compare_models=True, relative_et=True, partial_dependence=("ppt",),
    )
    trained = run(spark, conf, GridSpec(0, 1, 0.05, 0.05, 20, 20))
    n_rows = trained.predictions.count()
    assert n_rows == trained.inputs.rows.count() > 400
    assert {r.DATA for r in trained.metrics.collect()} == {"TRAIN", "TEST"}
    fine = rasters.read_cells(spark, f"{tmp_path}/map-fine")
    assert fine.groupBy("year", "month").count().count() == 4
    assert fine.where("value > 0").count() > 100
    assert fine.where("value is null").count() > 0
    totals = spark.read.option("header", True).csv(f"{tmp_path}/model-totals.csv")
    assert totals.count() == 4
    again = run(spark, RunConfig(**{**conf.__dict__, "reuse_monthly": True, "reuse_prepared": True, "reuse_model": True, "compare_models": False, "land_cover": ""}))
    assert again.predictions.count() == n_rows  # the second run replaced the first one's table


def test_end_to_end_per_crop(spark, world, tmp_path):
    conf = RunConfig(
        readings=f"{world}/readings.csv", sites=f"{world}/sites", cells=f"{world}/cells", output=str(tmp_path),
        predictors=("SSEBop", "SWB_HSG"), model="LR", folds=2, repeats=1, per_crop_models=True, scaling=False,
        soil_group_to_infiltration=False, split_strategy=1, test_years=(2019,),
    )
    trained = run(spark, conf)
    assert set(trained.model) == {"Rice", "Corn", "Cotton", "Soybeans", "Fish Culture"}
    assert {r.DATA for r in trained.predictions.where("Year = 2019").select("DATA").distinct().collect()} == {"TEST"}
