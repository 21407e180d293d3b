"""Edges that once lost rows, looped or reused unfinished work."""

import os

import pytest
from pyspark.sql import functions as F

from fieldwater.operators import grid
from fieldwater.operators.features import MinMaxScaler
from fieldwater.plans.domain import scratch
from fieldwater.sources import rasters, stages

CUBE = "dataset string, row int, col int, year int, month int, ts int, value double"


def test_every_product_is_reduced_or_refused(spark):
    rows = [(d, 0, 0, 2015, m, k, float(k + m)) for d in ("MOD16", "SMOS_SMAP", "PPT", "TMAX") for m in (3, 4) for k in (1, 2, 3)]
    made = grid.composite_by_catalogue(spark.createDataFrame(rows, CUBE), rasters.catalogue(spark)).collect()
    assert {r.dataset for r in made} == {"MOD16", "SMOS_SMAP", "PPT", "TMAX", "DEF_SMAP"}
    got = {(r.dataset, r.month): r.value for r in made}
    assert got["DEF_SMAP", 3] == pytest.approx(0.1 * 15 - 15) and got["TMAX", 4] == 6.0 and got["SMOS_SMAP", 3] == 2.0
    for name in ("SSEBop", "DEF_SMAP", None):
        with pytest.raises(ValueError, match="no rule reduces"):
            grid.composite_by_catalogue(spark.createDataFrame([(name, *rows[0][1:])], CUBE), rasters.catalogue(spark))
    odd = rasters.catalogue(spark).withColumn("reducer", F.lit("cube_root"))
    with pytest.raises(ValueError, match="unknown reducer"):
        grid.composite_by_catalogue(spark.createDataFrame(rows, CUBE), odd)


def test_later_collection_holds_from_the_rows_own_month(spark):
    first, later = next((p[1], p[5]) for p in rasters.codes.REMOTE_PRODUCTS if p[0] == "SMOS_SMAP")
    rows = [("SMOS_SMAP", 0, 0, y, m, k, float(10 * k + (c == later)), c) for y, m in ((2015, 3), (2015, 4), (2016, 1)) for k in (1, 3) for c in (first, later)]
    cube = spark.createDataFrame(rows, CUBE + ", collection string")
    made = grid.composite_by_catalogue(cube.withColumn("value", F.col("value") * F.when(F.col("collection") == later, 2).otherwise(1)), rasters.catalogue(spark))
    assert {(r.year, r.month): r.value for r in made.where("dataset = 'SMOS_SMAP'").collect()} == {(2015, 3): 20.0, (2015, 4): 40.0, (2016, 1): 40.0}


def test_a_scaler_of_many_features_comes_back_whole(spark):
    path = scratch(spark, "scaler")
    limits = {f"f{k}": (float(k), float(k + 1)) for k in range(10_050)}
    stages.save_scaler(MinMaxScaler(limits), spark, path)
    assert stages.load_scaler(spark, path).limits == limits
    doubled = MinMaxScaler({"a": (0.0, 1.0)}).table(spark)
    with pytest.raises(ValueError, match="more than once"):
        MinMaxScaler.from_table(doubled.unionByName(doubled))


def test_a_stage_counts_only_with_its_marker(spark):
    path, built = scratch(spark, "stage"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert not stages.exists(spark, path)
    stages.stage(spark, path, build, reuse=True)
    stages.stage(spark, path, build, reuse=True)
    assert len(built) == 1 and stages.exists(spark, path)
    os.remove(f"{path}/_SUCCESS")
    assert stages.stage(spark, path, build, reuse=True).count() == 3 and len(built) == 2


def test_fold_scores_are_averaged_over_the_folds_that_have_them():
    from fieldwater.operators.tuning import fold_means

    whole = {f"{p}_{s}": 2.0 for p in ("train", "validation") for s in ("r2", "rmse", "mae")}
    empty = {k: (None if k == "validation_r2" else v) for k, v in whole.items() if k not in ("validation_rmse", "validation_mae")}
    assert fold_means([empty, {k: 4.0 for k in whole}, whole])["validation_rmse"] == 3.0
    assert fold_means([empty, whole])["validation_r2"] == 2.0
    with pytest.raises(ValueError, match="validation"):
        fold_means([empty, empty])


def test_relative_values_of_map_cells_use_the_training_means(spark):
    from fieldwater.operators.metering import group_means, relative_et

    wells = spark.createDataFrame([("Rice", 2.0), ("Rice", 4.0), ("Corn", 10.0)], "crop string, SSEBop double")
    cells = spark.createDataFrame([("Rice", 6.0), ("Corn", None), ("Peanuts", 1.0), (None, 1.0)], "crop string, SSEBop double")
    means = group_means(wells, ["SSEBop", "OpenET"], "crop")
    got = {r.crop: r.Relative_SSEBop for r in relative_et(cells, means=means).collect()}
    assert got == {"Rice": 2.0, "Corn": None, "Peanuts": None, None: None}


def test_rows_without_a_model_stay_without_a_prediction(spark):
    from fieldwater.operators import features, tuning
    from fieldwater.plans.model_queries import _linear

    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), (None, 1.0, 1.0)], "crop string, x double, label double")
    ready = features.assemble(rows, ["x"])
    models = tuning.per_crop_models(ready, ["a"], _linear)
    got = sorted((r.crop or "", r.prediction is None) for r in tuning.predict_per_crop(models, ready).collect())
    assert got == [("", True), ("a", False), ("a", False), ("b", True)]


def test_cells_without_a_class_are_never_scored(spark):
    from fieldwater.operators import features, scoring
    from fieldwater.plans.model_queries import _linear

    train = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, label double").withColumn("crop", F.lit("Rice"))
    crops = ["Rice"]
    model = _linear(features.assemble(features.one_hot(train, {"crop": crops}, drop=False), ["x", "crop_Rice"]))
    cells = spark.createDataFrame([(0, 0, 2020, 1, "Rice", 5.0, False), (0, 1, 2020, 1, None, 5.0, True)], "row int, col int, year int, month int, crop string, x double, class_missing boolean")
    got = {r.col: r.value for r in scoring.score_cells(model, cells, ["x"], crops, "label", month_col=None, variants=["Rice"]).collect()}
    assert got[1] is None and got[0] == pytest.approx(50.0)


def test_placements_of_products(spark):
    path = scratch(spark, "cells")
    common, own = grid.GridSpec(0, 1, 0.1, 0.1, 10, 10), grid.GridSpec(0, 5e6, 1e3, 1e3, 50, 50, "albers")
    rasters.write_specs(spark, path, {"grid": common, "PPT": own})
    assert rasters.read_specs(spark, path, ["PPT", "TMIN"]) == {"PPT": own, "TMIN": common}
    rasters.write_specs(spark, path, {"PPT": own, "VPD": common})
    with pytest.raises(ValueError, match="TMIN"):
        rasters.read_specs(spark, path, ["PPT", "TMIN"])


def test_dependence_on_a_feature_with_missing_values(spark):
    from fieldwater.operators import explain, features
    from fieldwater.plans.model_queries import _linear

    rows = spark.createDataFrame([(float(k), 2.0 * k) for k in range(5)], "x double, label double")
    model = _linear(features.assemble(rows, ["x"]))
    gaps = rows.unionByName(spark.createDataFrame([(None, 0.0)], "x double, label double"))
    assert explain.partial_dependence(model, gaps, ["x"], "x", points=6).count() == 5
    ends = sorted(r["at"] for r in explain.partial_dependence(model, gaps, ["x"], "x", points=5, low=0.0, high=1.0).collect())
    assert ends == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_days_are_summed_from_their_last_update(spark):
    import datetime

    from fieldwater.streaming import meters

    day = lambda k: datetime.date(2020, 1, k)
    rows = [("a", day(1), 1.0, 0), ("a", day(1), 3.0, 1), ("a", day(2), 5.0, 0), ("b", day(1), 2.0, 1)]
    made = meters.monthly_totals_so_far(spark.createDataFrame(rows, "site string, day date, value double, batch int"))
    assert {r.site: r.value for r in made.collect()} == {"a": 8.0, "b": 2.0}


def test_shuffles_start_from_partitions_that_fit():
    from fieldwater.session import initial_partitions

    assert initial_partitions(0) == 200 and initial_partitions(10**12) == 7451 and initial_partitions(10**18) == 200_000
