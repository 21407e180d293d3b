from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldwater.functions import codes, scalar
from fieldwater.operators import clean, metering, outliers, split
from fieldwater.operators.features import MinMaxScaler, one_hot, undo_one_hot
from fieldwater.operators.quantiles import quantiles

NAN, INF = float("nan"), float("inf")


def column(df, name):
    return [r[name] for r in df.collect()]


def test_clean_rows(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "v double")
    assert column(clean.clean_rows(df), "v") == [1.0]


def test_categories(spark):
    df = spark.createDataFrame([("Rice/Soybeans",), ("Duck habitat",), ("SOYBEANS late",), ("Soybean",), (None,)], "c string")
    made = df.select(clean.normalize_category(F.col("c")).alias("c"))
    assert column(made, "c") == ["Rice", "Fish Culture", "Soybeans", "Soybean", None]
    df = spark.createDataFrame([("Soybean ",), (" Corn ",)], "c string")
    assert column(df.select(clean.collapse_label(F.col("c")).alias("c")), "c") == ["Soybeans", "Corn"]


def test_soil_groups(spark):
    df = spark.createDataFrame([(1,), (5,), (7,), (8,), (-9999,), (None,), (9,)], "SWB_HSG int")
    assert column(clean.soil_group_to_infiltration(df), "INF_RATE") == [7.62, 7.62, 2.54, 0.635, 4.1275, None, None]


def test_units(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0)], "AF_Acre double, SWB_IRR double, SWB_HSG double, EFF_PPT double")
    row = clean.to_millimetres(df).first()
    assert (row.AF_Acre, row.SWB_IRR, row.SWB_HSG, row.EFF_PPT) == pytest.approx((304.8, 50.8, 3, 25.4))
    assert df.select(clean.depth_to_volume(F.lit(12.5))).first()[0] == 125


def test_crop_coefficient(spark):
    df = spark.createDataFrame([("Rice",), (None,)], "c string")
    assert column(df.select(clean.crop_coefficient(F.col("c")).alias("k")), "k") == [1.2, None]
    bad = spark.createDataFrame([("Barley",)], "c string")
    assert column(bad.select(clean.crop_coefficient(F.col("c"), strict=False).alias("k")), "k") == [None]
    with pytest.raises(Exception, match="no crop coefficient"):
        bad.select(clean.crop_coefficient(F.col("c"))).collect()


def test_recode(spark):
    df = spark.createDataFrame([(1,), (92,), (0,), (7,), (None,)], "c int")
    assert column(df.select(clean.recode_crop(F.col("c")).alias("k")), "k") == ["Corn", "Fish Culture", None, "Other", None]


def test_impute_keeps_the_mask(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, NAN, 2.0), (3, 1.0, -INF), (4, None, None)], "i int, a double, b double")
    rows = clean.impute_remembering(df, ["a", "b"]).orderBy("i").collect()
    assert [r.any_missing for r in rows] == [False, True, True, True]
    assert [(r.a, r.b) for r in rows] == [(1.0, 2.0), (0.0, 2.0), (1.0, 0.0), (0.0, 0.0)]


def test_order_columns(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert clean.order_columns(df).columns == ["a", "b"]
    assert clean.order_columns(df, ["b", "z", "a"]).first().asDict() == {"b": 1, "z": None, "a": 2}


def test_unknown_condition_passes_through(spark):
    df = spark.createDataFrame([(None, "RT"), ("MS", "RT"), (None, "VMP")], "State string, Data string")
    cond = scalar.is_true((F.col("State") == "MS") | (F.col("Data") == "VMP"))
    assert df.where(~cond).count() == 1 and df.where(cond).count() == 2


def test_season_calendar(spark):
    years = spark.createDataFrame([(2015,)], "year int")
    made = sorted((r.year, r.month) for r in scalar.season_months(years, 10, 9).collect())
    assert made == [(2014, 10), (2014, 11), (2014, 12)] + [(2015, m) for m in range(1, 10)]
    made = sorted((r.year, r.month) for r in scalar.season_months(years, 4, 9).collect())
    assert made == [(2015, m) for m in range(4, 10)]


def test_nodata(spark):
    df = spark.createDataFrame([(-32767.0,), (-32766.99,), (5.0,), (NAN,), (None,)], "v double")
    assert column(df.select(scalar.nodata_to_null(F.col("v")).alias("v")), "v") == [None, None, 5.0, None, None]
    assert column(df.select(scalar.null_to_nodata(F.col("v")).alias("v")), "v")[-2:] == [-32767.0, -32767.0]


def test_decode_days(spark):
    row = spark.range(1).select(scalar.decode_days_since(F.lit(31), "2000-01-01").alias("d")).first()
    assert str(row.d) == "2000-02-01"


# ---------------------------------------------------------------- metering


def _readings(spark, rows):
    return spark.createDataFrame([(s, datetime(*d), v) for s, d, v in rows], "site_no string, datetime timestamp, value double")


def test_climatology_weighs_site_months_equally(spark):
    readings = _readings(spark, [("a", (2018, 1, 5), 1.0), *[("b", (2018, 1, 1 + i), 3.0) for i in range(20)]])
    made = metering.climatology(metering.monthly_means(readings)).collect()
    assert [(r.Month, r.value) for r in made] == [(1, 2.0)]


def test_monthly_totals_skip_gaps_and_bad_readings(spark):
    readings = _readings(spark, [("a", (2018, 1, 1), 1.0), ("a", (2018, 1, 2), -5.0), ("a", (2018, 3, 1), 2.0), ("a", (2018, 2, 1), NAN)])
    made = sorted((r.Month, r.value) for r in metering.monthly_totals(readings).collect())
    assert made == [(1, 1.0), (3, 2.0)]


def test_constant_weights(spark):
    made = metering.monthly_weights(metering.profile_constants(spark)).collect()
    corn = {r.month: r.weight for r in made if r.crop == "Corn"}
    assert corn[7] == pytest.approx(0.349208, abs=1e-6) and corn[1] == 0
    for crop in codes.MONTHLY_PROFILE:
        assert sum(r.weight for r in made if r.crop == crop) == pytest.approx(1)


def test_disaggregate(spark):
    annual = spark.createDataFrame([("x", 8.0), ("none", 1.0)], "crop string, AF_Acre double")
    weights = spark.createDataFrame([("x", 4, 0.25), ("x", 5, 0.75)], "crop string, month int, weight double")
    made = {r.Month: r.AF_Acre for r in metering.disaggregate(annual, weights).collect()}
    assert len(made) == 12 and made[4] == 2 and made[5] == 6 and sum(made.values()) == 8


def test_monthly_use_joins_both_sources(spark):
    readings = _readings(spark, [("1", (2019, 5, 1), 4.0), ("1", (2019, 5, 2), 6.0), ("2", (2019, 6, 1), 9.0), ("3", (2019, 6, 1), 9.0)])
    sites = spark.createDataFrame(
        [("1", 2019, "Fish pond", "MS", 2.0, 34.0, -91.0), ("2", 2019, "rice", "AR", 3.0, 34.0, -91.0), ("3", 2019, "corn", "AR", 0.0, 34.0, -91.0)],
        "site_no string, Year int, crop string, State string, acres double, lat_dd double, long_dd double",
    )
    annual = spark.createDataFrame([("Corn ", 2018, 2.0, 33.0, -90.0), ("Hay", 2018, 2.0, 33.0, -90.0)], "crop string, Year int, AF_Acre double, lat_dd double, long_dd double")
    rows = metering.monthly_use(readings, sites, annual).collect()
    metered = {r.site_no: (r.crop, r.AF_Acre) for r in rows if r.Data == "RT"}
    assert metered == {"1": ("Fish Culture", 5.0), "2": ("Rice", 3.0)}
    spread = [r for r in rows if r.Data == "VMP"]
    assert len(spread) == 12 and sum(r.AF_Acre for r in spread) == pytest.approx(2.0) and spread[0].State is None
    only_ms = metering.monthly_use(readings, sites, None, states=["ms"]).collect()
    assert [r.site_no for r in only_ms] == ["1"]


def test_relative_et_ignores_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "crop string, SSEBop double")
    made = {(r.crop, r.SSEBop): r.Relative_SSEBop for r in metering.relative_et(df).collect()}
    assert made == {("a", 1.0): 0.5, ("a", 3.0): 1.5, ("a", None): None, ("b", 5.0): 1.0}


# ---------------------------------------------------------------- outliers, quantiles, splits


def test_fence(spark):
    df = spark.createDataFrame([("Rice", 2018, float(v)) for v in (1, 2, 3, 4, 100)] + [("Rice", 2018, NAN)], "crop string, y int, v double")
    for op in (outliers.GLOBAL, outliers.BY_CROP, outliers.BY_YEAR, outliers.FIXED_LIMIT):
        assert sorted(column(outliers.remove_outliers(df, "v", "crop", "y", op), "v")) == [1, 2, 3, 4]
    assert outliers.remove_outliers(df, "v", "crop", "y", outliers.KEEP_ALL).count() == 5


@pytest.mark.parametrize("accuracy", [50, 500, 10_000])
def test_quantiles_whatever_the_bracket(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.gamma(2, 50, 900), 1)] + [("cold", float(v)) for v in rng.normal(size=77)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs, names = [0.0, 0.25, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e"]
    made = {r.g: [r[n] for n in names] for r in quantiles(df, ["g"], "v", probs, names, accuracy=accuracy).collect()}
    for group in ("hot", "cold", None):
        want = np.quantile([v for g, v in rows if g == group], probs)
        assert made[group] == pytest.approx(list(want))


def test_quantile_of_one_repeated_value(spark):
    df = spark.createDataFrame([(7.0,)] * 300 + [(1.0,)] * 10, "v double")
    assert quantiles(df, [], "v", [0.5], ["m"], accuracy=50).first().m == 7.0
    assert quantiles(df.where("v > 100"), [], "v", [0.5], ["m"]).first().m is None


@pytest.mark.parametrize("accuracy", [50, 10_000])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_of_extreme_values(spark, accuracy, keys):
    """Infinities, NaN, a heavy tail and a span beyond the largest double: for one hot group and for all rows."""
    rows = [("hot", v) for v in [INF] * 3 + [-INF] * 2 + [NAN] * 9 + [1.7e308, -1.7e308] + [10.0**k for k in range(-150, 150)]]
    df = spark.createDataFrame([*rows, ("hot", None)], "g string, v double")
    finite = sorted(v for _, v in rows if v == v)
    probs, names = [0.0, 0.004, 0.3, 0.5, 0.995, 1.0], list("abcdef")
    made = quantiles(df, keys, "v", probs, names, accuracy=accuracy).select(*names).first()
    for p, got in zip(probs, made):
        at = (len(finite) - 1) * p
        lo, hi = finite[int(at)], finite[min(len(finite) - 1, int(at) + (at > int(at)))]
        if at == int(at) or abs(lo) == INF:
            assert got == lo
        else:
            assert got == (hi if abs(hi) == INF else pytest.approx(lo + (at - int(at)) * (hi - lo)))


def test_ratio_split_sizes(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(18)], "id int, s string")
    parted = split.split_ratio(df, ["s"], "id", 0.2, seed=1)
    assert {(r.s, r["count"]) for r in parted.where("DATA = 'TEST'").groupBy("s").count().collect()} == {("a", 2), ("b", 3)}
    assert parted.count() == 18


def test_folds_are_balanced_and_cover(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(100)], "id int, s string")
    folded = split.repeated_folds(df, "id", 5, 2, ["s"]).collect()
    for name in ("fold_0", "fold_1"):
        for s in "ab":
            sizes = [sum(1 for r in folded if r.s == s and r[name] == f) for f in range(5)]
            assert max(sizes) - min(sizes) <= 1
    assert len(folded) == 100


def test_sample_keeps_small_groups(spark):
    df = spark.createDataFrame([(i, "big" if i < 50 else "small") for i in range(53)], "id int, g string")
    made = {r.g: r["count"] for r in split.sample_per_group(df, ["g"], "id", 10).groupBy("g").count().collect()}
    assert made == {"big": 10, "small": 3}


def test_scaler(spark):
    train = spark.createDataFrame([(2.0, 5.0), (4.0, 5.0)], "a double, k double")
    test = spark.createDataFrame([(6.0, 5.0)], "a double, k double")
    scaler = MinMaxScaler.fit(train, ["a", "k"])
    assert tuple(scaler.transform(test).first()) == (2.0, 0.0)
    assert tuple(scaler.inverse(scaler.transform(test)).first()) == (6.0, 5.0)
    assert test.select(scaler.unscale_error("a", F.lit(0.5))).first()[0] == 1.0


def test_one_hot_has_a_fixed_vocabulary(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,)], "c string")
    coded = one_hot(df, {"c": ["a", "b"]})
    assert coded.columns == ["c_a", "c_b"]
    assert [tuple(r) for r in coded.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    assert column(coded.select(undo_one_hot(coded, "c", ["a", "b"]).alias("c")), "c") == ["a", None, None]
