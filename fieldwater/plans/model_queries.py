"""Driver-table queries: model inputs, fits, metrics, explanations, map scoring."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from fieldwater.functions import codes
from fieldwater.functions.sizing import attach, measured
from fieldwater.operators import estimators, evaluate, explain, features, grid, scoring, split, tuning
from fieldwater.operators.clean import recode_crop
from fieldwater.operators.neighbours import NeighboursRegressor
from fieldwater.plans import domain
from fieldwater.plans.domain import VIEW as V
from fieldwater.plans.inputs import model_inputs as make_inputs
from fieldwater.plans.inputs import prepare
from fieldwater.plans.registry import query
from fieldwater.session import cut_lineage
from fieldwater.sources import stages


def r(column, digits: int):
    return F.round(column, digits)


def _labelled(spark, d):
    """Annual readings with one feature: the month."""
    rows = domain.annual(spark, d).select("id", "crop", "status", "yr", F.col("mon").cast("double").alias("m"), F.col("wu").alias("label"))
    return features.assemble(rows, ["m"])


def _linear(df):
    return LinearRegression(solver="normal", regParam=0.0, labelCol="label").fit(df)


CROP_CODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FIT = f"(select regr_slope(wu, mon) as a, regr_intercept(wu, mon) as b from {V['annual']} f)"


# ---------------------------------------------------------------- inputs


@query("prepared_rows", f"""
    with m as (select r, c, yr, mon, avg(val) as v from {V['cube']} q group by 1, 2, 3, 4),
    a as (select o.id, o.crop, o.yr, o.mon, o.wu, cast(floor(p.x / 2.0) as int) as c, cast(floor((100.0 - p.y) / 2.5) as int) as r
          from {V['annual']} o join {V['point']} p on o.site = p.pid),
    j as (select a.*, m.v as et, s.cls as soil from a left join m on a.r = m.r and a.c = m.c and a.yr = m.yr and a.mon = m.mon
          left join {V['cell']} s on a.r = s.r and a.c = s.c)
    select id, round(et, 6) as et, round(et / avg(et) over (partition by crop), 6) as rel, cast(soil as double) as soil,
      case crop when '1-URGENT' then 1.2e0 when '2-HIGH' then 0e0 when '3-MEDIUM' then 1.15e0 when '4-NOT SPECIFIED' then 1.15e0 else 1.2e0 end as cc,
      round(et - soil, 6) as eff from j""")
def prepared_rows(spark, d):
    """Sampled predictors with crop coefficient, relative evapotranspiration and effective precipitation."""
    spec = domain.cell_spec(spark, d)
    crop = F.col("crop")
    named = (
        F.when(crop == "1-URGENT", "Rice").when(crop == "2-HIGH", "Fish Culture").when(crop == "3-MEDIUM", "Soybeans")
        .when(crop == "4-NOT SPECIFIED", "Peanuts").otherwise("Corn")
    )
    places = domain.points(spark, d).select(F.col("pid").alias("site"), "x", "y")
    rows = domain.annual(spark, d).select(
        "id", "site", named.alias("crop"), F.col("yr").alias("Year"), F.col("mon").alias("Month"), F.col("wu").alias("AF_Acre")
    ).join(places, "site")
    cube = domain.cube(spark, d)
    monthly = grid.composite(cube, "mean")
    blank = F.lit(None).cast("int")
    static = domain.parts(spark, d).select("row", "col", blank.alias("year"), blank.alias("month"), F.col("cls").cast("double").alias("value"))
    cells = (
        monthly.withColumn("dataset", F.lit("SSEBop"))
        .unionByName(monthly.withColumn("dataset", F.lit("SWB_PPT")))
        .unionByName(static.withColumn("dataset", F.lit("SWB_AWC")))
    )
    specs = dict.fromkeys(["SSEBop", "SWB_PPT", "SWB_AWC"], spec)
    made = prepare(
        rows, cells, specs, list(specs), "id", x="x", y="y", crop_coefficients=True, relative=True,
        effective=("SWB_PPT", "SWB_AWC"),
    )
    return made.select(
        "id", r(F.col("SSEBop"), 6).alias("et"), r(F.col("Relative_SSEBop"), 6).alias("rel"), F.col("SWB_AWC").alias("soil"),
        F.col("CC").alias("cc"), r(F.col("EFF_PPT"), 6).alias("eff"),
    )


@query("model_inputs", f"""
    with a as (select id, yr, mon, wu * 304.8 as y, case crop when '1-URGENT' then 'Rice' when '2-HIGH' then 'Fish Culture'
                when '3-MEDIUM' then 'Soybeans' when '5-LOW' then 'Corn' end as crop, cast(site as double) as s from {V['annual']} o),
    f as (select crop, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from a where crop is not null group by crop),
    k as (select a.*, row_number() over (partition by yr order by md5(concat('42|', cast(id as varchar))), id) as k, count(*) over (partition by yr) as n
          from a join f on a.crop = f.crop where y <= f.q3 + 0.2 * (f.q3 - f.q1)),
    t as (select *, k <= ceil(n * 0.2) as held from k),
    l as (select min(y) as ylo, max(y) as yhi, min(s) as slo, max(s) as shi from t where not held)
    select id, case when held then 'TEST' else 'TRAIN' end as split, round((y - ylo) / (yhi - ylo), 8) as target,
      round((s - slo) / (shi - slo), 8) as site, cast(case when crop = 'Rice' then 1 else 0 end as double) as rice,
      cast(case when mon = 4 then 1 else 0 end as double) as april from t cross join l""")
def model_inputs(spark, d):
    crop = F.col("crop")
    named = (
        F.when(crop == "1-URGENT", "Rice").when(crop == "2-HIGH", "Fish Culture").when(crop == "3-MEDIUM", "Soybeans")
        .when(crop == "5-LOW", "Corn").otherwise("Peanuts")
    )
    rows = domain.annual(spark, d).select(
        "id", named.alias("crop"), F.col("yr").alias("Year"), F.col("mon").alias("Month"), F.col("wu").alias("AF_Acre"),
        F.col("site").cast("double").alias("s"),
    )
    made = make_inputs(
        rows, "id", outlier_operation=2, fence_reach=0.2, split_strategy=2, test_size=0.2, test_years=(2020,), seed=42, scaling=True
    )
    return made.rows.select(
        "id", F.col("DATA").alias("split"), r(F.col("AF_Acre"), 8).alias("target"), r(F.col("s"), 8).alias("site"),
        F.col("crop_Rice").alias("rice"), F.col("Month_4").alias("april"),
    )


# ---------------------------------------------------------------- fits with an exact answer


@query("linear_fit", f"""
    select status as g, round(regr_slope(wu, mon), 4) as slope, round(regr_intercept(wu, mon), 3) as icpt from {V['annual']} a group by 1""")
def linear_fit(spark, d):
    """One model per class; each fit is distributed."""
    rows = _labelled(spark, d).persist()
    models = tuning.per_crop_models(rows, features.vocabulary(rows, "status"), _linear, "status")
    table = [(g, float(m.coefficients[0]), float(m.intercept)) for g, m in models.items()]
    fitted = spark.createDataFrame(table, "g string, slope double, icpt double")
    rows.unpersist()
    return fitted.select("g", r(F.col("slope"), 4).alias("slope"), r(F.col("icpt"), 3).alias("icpt"))


@query("per_crop_predictions", f"""
    with f as (select status, regr_slope(wu, mon) as a, regr_intercept(wu, mon) as b from {V['annual']} a group by 1)
    select a.id, round(f.a * a.mon + f.b, 3) as p from {V['annual']} a join f on a.status = f.status""")
def per_crop_predictions(spark, d):
    rows = _labelled(spark, d)
    models = tuning.per_crop_models(rows, features.vocabulary(rows, "status"), _linear, "status")
    return tuning.predict_per_crop(models, rows, "status").select("id", r(F.col("prediction"), 3).alias("p"))


@query("prediction_table", f"""
    select id, crop, round(abs(a * mon + b), 3) as pred, round(wu, 3) as actual, round(wu - abs(a * mon + b), 3) as error
    from {V['annual']} x cross join {FIT} f""")
def prediction_table(spark, d):
    """Fit on scaled columns, predict, and put target and features back in their units."""
    rows = domain.annual(spark, d).select("id", "crop", F.col("mon").cast("double").alias("m"), F.col("wu").alias("label"))
    scaler = features.MinMaxScaler.fit(rows, ["m", "label"])
    scaled = features.assemble(scaler.transform(rows), ["m"])
    made = tuning.prediction_table(_linear(scaled), scaled, scaler, "label", ["m"])
    return made.select(
        "id", "crop", r(F.col("Pred_GW"), 3).alias("pred"), r(F.col("Actual_GW"), 3).alias("actual"), r(F.col("Error_GW"), 3).alias("error")
    )


@query("model_round_trip", f"""
    select id, round(abs(a * mon + b), 3) as p from {V['annual']} x cross join {FIT} f""")
def model_round_trip(spark, d):
    """Save model and scaler, load both, predict."""
    rows = domain.annual(spark, d).select("id", F.col("mon").cast("double").alias("m"), F.col("wu").alias("label"))
    scaler = features.MinMaxScaler.fit(rows, ["m", "label"])
    scaled = features.assemble(scaler.transform(rows), ["m"])
    path = domain.scratch(spark, "model")
    stages.save_scaler(scaler, spark, f"{path}-scaler")
    stages.save_model(_linear(scaled), path)
    again, limits = stages.load_model("LR", path), stages.load_scaler(spark, f"{path}-scaler")
    return again.transform(scaled).select("id", r(limits.unscale("label", F.abs("prediction")), 3).alias("p"))


@query("neighbours", f"""
    select pid, round(avg(bal), 4) as p from (select q.pid, t.bal, row_number() over (partition by q.pid
      order by abs(q.x - t.x) + abs(q.y - t.y), t.bal) as k from {V['point']} q cross join {V['point']} t) n
    where k <= 7 group by pid""")
def neighbours(spark, d):
    rows = features.assemble(domain.points(spark, d).withColumnRenamed("bal", "label"), ["x", "y"])
    model = NeighboursRegressor(k=7, p=1.0).fit(rows)
    return model.transform(rows).select("pid", r(F.col("prediction"), 4).alias("p"))


# ---------------------------------------------------------------- metrics

RESIDUALS = f"""(select id, crop, yr, mon, wu as y, m as p from (select *, avg(wu) over (partition by yr) as m from {V['annual']} a) t)"""


def _predictions(spark, d):
    """The yearly mean as the prediction."""
    rows = domain.annual(spark, d)
    means = measured(rows.groupBy("yr").agg(F.avg("wu").alias("Pred_GW")))
    joined = attach(rows.withColumnRenamed("wu", "Actual_GW"), means, ["yr"])
    return joined.withColumn("Error_GW", F.col("Actual_GW") - F.col("Pred_GW"))


@query("metrics", f"""
    select crop, round(1 - sum((y - p) * (y - p)) / sum((y - ym) * (y - ym)), 6) as r2, round(avg(abs(y - p)), 4) as mae,
      round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(100 * sqrt(avg((y - p) * (y - p))) / avg(y), 6) as nrmse
    from (select *, avg(y) over (partition by crop) as ym from {RESIDUALS} q) m group by crop""")
def metrics(spark, d):
    made = evaluate.metrics(_predictions(spark, d), ["crop"], precision=None)
    return made.select("crop", r(F.col("r2"), 6).alias("r2"), r(F.col("mae"), 4).alias("mae"), r(F.col("rmse"), 4).alias("rmse"), r(F.col("nrmse"), 6).alias("nrmse"))


@query("split_metrics", f"""
    with q as (select *, case when yr in (1996, 2000) then 'TEST' else 'TRAIN' end as split from {RESIDUALS} z),
    g as (select split, cast(null as varchar) as crop, cast(null as int) as yr, y, p from q union all
      select split, crop, null, y, p from q union all select split, null, yr, y, p from q),
    h as (select *, avg(y) over (partition by split, crop, yr) as ym from g)
    select split, crop, yr, count(*) as n_rows, round(avg(abs(y - p)), 2) as mae, round(sqrt(avg((y - p) * (y - p))), 2) as rmse,
      round(1 - sum((y - p) * (y - p)) / sum((y - ym) * (y - ym)), 2) as r2
    from h group by 1, 2, 3""")
def split_metrics(spark, d):
    parted = split.split_years(_predictions(spark, d), (1996, 2000), "yr")
    made = evaluate.split_metrics(parted, "DATA", "crop", "yr", precision=2)
    return made.select(F.col("DATA").alias("split"), "crop", "yr", "n_rows", "mae", "rmse", "r2")


@query("std_residual", f"""
    select id, round((y - p) / stddev_samp(y - p) over (partition by crop), 6) as z from {RESIDUALS} q where mon between 4 and 9""")
def std_residual(spark, d):
    made = evaluate.standardized_residuals(_predictions(spark, d), by="crop", months=codes.GROWING_MONTHS, month="mon")
    return made.select("id", r(F.col("Std_Residuals"), 6).alias("z"))


@query("split_ranges", f"""
    select case when yr in (1996, 2000) then 'TEST' else 'TRAIN' end as split, min(wu) as min_actual, max(wu) as max_actual
    from {V['annual']} a group by 1""")
def split_ranges(spark, d):
    parted = split.split_years(domain.annual(spark, d).withColumnRenamed("wu", "Actual_GW"), (1996, 2000), "yr")
    return evaluate.actual_ranges(parted).withColumnRenamed("DATA", "split")


# ---------------------------------------------------------------- explanations


@query("partial_dependence", f"""
    with q as (select quantile_cont(site, 0.05) as lo, quantile_cont(site, 0.95) as hi from {V['annual']} a),
    f as (select regr_slope(wu, site) as a, regr_intercept(wu, site) as b from {V['annual']} a)
    select cast(i as int) as i, round(lo + (hi - lo) * i / 99, 4) as at, round(a * (lo + (hi - lo) * i / 99) + b, 2) as response
    from q cross join f cross join (select unnest(generate_series(0, 99)) as i) g""")
def partial_dependence(spark, d):
    rows = domain.annual(spark, d).select("id", F.col("site").cast("double").alias("s"), F.col("wu").alias("label"))
    model = _linear(features.assemble(rows, ["s"]))
    made = explain.partial_dependence(model, rows, ["s"], "s")
    ends = made.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.round((F.col("at") - lo) / ((hi - lo) / 99)).cast("int")
    return made.select(place.alias("i"), r(F.col("at"), 4).alias("at"), r(F.col("response"), 2).alias("response"))


@query("permutation_importance", f"""
    with a as (select id, mon, wu from {V['annual']} x),
    o as (select r, id, mon, wu, row_number() over (partition by r order by md5(concat('1-', r, 'a|', cast(id as varchar))), id) as k from a, (values (0), (1)) t(r)),
    q as (select r, mon, row_number() over (partition by r order by md5(concat('1-', r, 'b|', cast(id as varchar))), id) as k from a, (values (0), (1)) t(r)),
    e as (select o.r, 100 * sqrt(avg(power(wu - (f.a * q.mon + f.b), 2))) / avg(wu) as worse, 100 * sqrt(avg(power(wu - (f.a * o.mon + f.b), 2))) / avg(wu) as plain
      from o join q on o.r = q.r and o.k = q.k cross join {FIT} f group by o.r)
    select 'm' as feature, round(avg(worse - plain), 6) as importance, round(stddev_samp(worse - plain), 6) as sd from e
    union all select 'constant', 0e0, 0e0""")
def permutation_importance(spark, d):
    """A real feature and a constant one; the constant scores exactly 0."""
    rows = domain.annual(spark, d).select(
        "id", F.col("mon").cast("double").alias("m"), F.lit(1.0).alias("constant"), F.col("wu").alias("label")
    )
    model = _linear(features.assemble(rows, ["m", "constant"]))
    scores = explain.permutation_importance(model, rows, ["m", "constant"], "id", repeats=2)
    made = explain.permutation_summary(scores)
    return made.select("feature", r(F.col("importance"), 6).alias("importance"), r(F.col("sd"), 6).alias("sd"))


# ---------------------------------------------------------------- tuned models
#
# Trees of depth 1 on the month have an exact answer in SQL: of the splits between
# months, the one with the least variance left. Forests without sampling repeat it.


def stump_sql(name: str, rows: str) -> str:
    """Common table expressions ending in ``name`` (g, t, lo, hi): the best split of ``rows`` (g, mon, y, w) for every g."""
    return f"""
    {name}_m as (select g, mon, sum(w) as n, sum(w * y) as s from {rows} group by g, mon),
    {name}_s as (select g, mon as t, sum(n) over (partition by g order by mon) as nl, sum(s) over (partition by g order by mon) as sl,
      sum(n) over (partition by g) as nt, sum(s) over (partition by g) as st from {name}_m),
    {name}_k as (select *, row_number() over (partition by g order by sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) desc, t) as k from {name}_s where nt - nl > 1e-9),
    {name} as (select g, t, sl / nl as lo, (st - sl) / (nt - nl) as hi from {name}_k where k = 1)"""


ROWS_SQL = f"base as (select 0 as g, id, mon, wu as y, 1e0 as w from {V['annual']} a)"
STUMP_SQL = f"""with {ROWS_SQL}, {stump_sql('s', 'base')}
    select id, round(case when mon <= t then lo else hi end, 4) as p from base join s using (g)"""
FOLD_SCORES = """
    scored as (select g, held, y, p, avg(y) over (partition by g, held) as ym from predicted),
    each as (select g, case when held then 'validation' else 'train' end as part, 1 - sum((y - p) * (y - p)) / sum((y - ym) * (y - ym)) as r2,
      sqrt(avg((y - p) * (y - p))) as rmse, avg(abs(y - p)) as mae from scored group by g, held),
    means as (select part, avg(r2) as r2, avg(rmse) as rmse, avg(mae) as mae from each group by part)
    select concat(part, '_', name) as score, round(case name when 'r2' then r2 when 'rmse' then rmse else mae end, 6) as value
    from means, (values ('r2'), ('rmse'), ('mae')) n(name)"""


def _summary(spark, found):
    rows = spark.createDataFrame([(k, float(v)) for k, v in found.summary().items()], "score string, value double")
    return rows.withColumn("value", r(F.col("value"), 6))


@query("tree_search", f"""
    with a as (select *, (row_number() over (partition by crop order by md5(concat('7|', cast(id as varchar))), id) - 1) % 3 as fold from {V['annual']} x),
    f as (select fold as g, mon, wu as y, 1e0 as w, fold = own as held from (select a.mon, a.wu, a.fold as own, h.fold from a, (values (0), (1), (2)) h(fold)) t),
    fitted as (select * from f where not held), {stump_sql('s', 'fitted')},
    predicted as (select g, held, y, case when mon <= t then lo else hi end as p from f join s using (g)), {FOLD_SCORES}""")
def tree_search(spark, d):
    """Search with folds stratified by class; the mean scores of the one candidate, a tree of depth 1."""
    grid_ = {"maxDepth": [1], "minInstancesPerNode": [1]}
    return _summary(spark, tuning.search(_labelled(spark, d), "DT", "id", folds=3, repeats=1, strata=["crop"], grid=grid_, seed=7))


@query("linear_search", f"""
    with a as (select id, mon, wu, r, (row_number() over (partition by r order by md5(concat(7 + r, '|', cast(id as varchar))), id) - 1) % 3 as own
      from {V['annual']} x, (values (0), (1)) u(r)),
    f as (select r * 3 + fold as g, mon, wu as y, fold = own as held from a, (values (0), (1), (2)) h(fold)),
    fitted as (select g, regr_slope(y, mon) as a, regr_intercept(y, mon) as b from f where not held group by g),
    predicted as (select g, held, y, a * mon + b as p from f join fitted using (g)), {FOLD_SCORES}""")
def linear_search(spark, d):
    """Repeated folds of a least-squares fit: the mean scores."""
    return _summary(spark, tuning.search(_labelled(spark, d), "LR", "id", folds=3, repeats=2, seed=7))


def _predicted(name, digits=4, **params):
    def run(spark, d):
        rows = _labelled(spark, d)
        model = estimators.configured(estimators.make_estimator(name, 7), params).fit(rows)
        return model.transform(rows).select("id", r(F.col("prediction"), digits).alias("p"))

    return run


WHOLE = {"numTrees": 3, "maxDepth": 1, "bootstrap": False, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
query("tree_fit", STUMP_SQL)(_predicted("DT", maxDepth=1))
query("forest_fit", STUMP_SQL)(_predicted("DRF", **WHOLE))
query("random_forest_fit", STUMP_SQL)(_predicted("RF", **WHOLE))
query("bagged_fit", STUMP_SQL)(_predicted("BT", **WHOLE))
# Extra trees stand in by few bins: with 12 months in 8 bins the split may differ, so they are given a bin for each.
query("extra_trees_fit", STUMP_SQL)(_predicted("ETR", maxBins=16, **WHOLE))

query("boosted_fit", f"""
    with {ROWS_SQL}, {stump_sql('s', 'base')},
    one as (select g, id, mon, y, w, case when mon <= t then lo else hi end as p from base join s using (g)),
    gap as (select g, mon, 2 * (y - p) as y, w from one), {stump_sql('z', 'gap')}
    select id, round(p + 0.1 * case when mon <= t then lo else hi end, 4) as p from one join z using (g)""")(
    _predicted("LGBM", maxIter=2, maxDepth=1, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all")
)

query("adaboost_fit", f"""
    with {ROWS_SQL}, {stump_sql('s', 'base')},
    one as (select g, id, mon, y, w, case when mon <= t then lo else hi end as p from base join s using (g)),
    miss as (select *, abs(y - p) / max(abs(y - p)) over () as share from one),
    loss as (select sum(w * share) / sum(w) as l from miss),
    again as (select g, id, mon, y, p, w * power(l / (1 - l), 0.5 * (1 - share)) as w from miss cross join loss), {stump_sql('z', 'again')},
    two as (select again.*, case when mon <= t then lo else hi end as q from again join z using (g)),
    miss2 as (select *, abs(y - q) / max(abs(y - q)) over () as share from two),
    loss2 as (select sum(w * share) / sum(w) as l2 from miss2)
    select id, round(case when l2 >= 0.5 then p when p = q then p when (ln((1 - l) / l) >= ln((1 - l2) / l2)) then p else q end, 4) as p
    from two cross join loss cross join loss2""")(_predicted("ABR", maxIter=2, stepSize=0.5, maxDepth=1))


@query("huber_fit", f"select id, round(3e0 * mon + 7e0, 2) as p from {V['annual']} a")
def huber_fit(spark, d):
    """On a line without noise every robust fit is the line."""
    rows = domain.annual(spark, d).select("id", F.col("mon").cast("double").alias("m"), (F.col("mon") * 3.0 + 7.0).alias("label"))
    rows = features.assemble(rows, ["m"])
    model = LinearRegression(loss="huber", maxIter=200, tol=1e-10, labelCol="label").fit(rows)
    return model.transform(rows).select("id", r(F.col("prediction"), 2).alias("p"))


@query("svr_fit", f"""
    select id, round(quantile_disc(wu / 1e6, 0.5) over (partition by crop), 5) as p from {V['annual']} a""")
def svr_fit(spark, d):
    """With one indicator a class, no intercept and nothing insensitive, the coefficients are the classes' lower medians, as these stay below C."""
    rows = domain.annual(spark, d).select("id", "crop", (F.col("wu") / 1e6).alias("label"))
    crops = list(CROP_CODES)
    coded = features.assemble(features.one_hot(rows, {"crop": crops}), [f"crop_{c}" for c in crops])
    settings = {"C": 2.0, "tol": 1e-10, "fitIntercept": False, "loss": "epsilon_insensitive"}
    model = estimators.configured(estimators.make_estimator("SVR", 7), settings).fit(coded)
    return model.transform(coded).select("id", r(F.col("prediction"), 5).alias("p"))


@query("svr_squared_fit", f"""
    with s as (select 1.5e0 as c, count(*) as n, sum(mon) as x, sum(mon * mon) as xx, sum(wu / 1e5) as y, sum(mon * wu / 1e5) as xy from {V['annual']} a),
    m as (select 2 * c * xx + 1 as p, 2 * c * x as q, 2 * c * n + 1 as s, 2 * c * xy as u, 2 * c * y as v from s)
    select id, round((u * s - q * v) / (p * s - q * q) * mon + (p * v - q * u) / (p * s - q * q), 6) as p
    from {V['annual']} a cross join m""")
def svr_squared_fit(spark, d):
    """The squared loss without an insensitive band, whose normal equations SQL solves."""
    rows = _labelled(spark, d).withColumn("label", F.col("label") / 1e5)
    settings = {"C": 1.5, "tol": 1e-15, "loss": "squared_epsilon_insensitive"}
    model = estimators.configured(estimators.make_estimator("SVR", 7), settings).fit(rows)
    return model.transform(rows).select("id", r(F.col("prediction"), 6).alias("p"))


@query("importances", f"select * from (select 'm' as feature, 1e0 as importance union all select 'constant', 0e0) t where (select count(*) from {V['annual']} a) > 0")
def importances(spark, d):
    """Split counts of a forest whose second feature is constant and can't be split on."""
    rows = domain.annual(spark, d).select("id", F.col("mon").cast("double").alias("m"), F.lit(1.0).alias("constant"), F.col("wu").alias("label"))
    model = estimators.configured(estimators.make_estimator("DRF", 7), WHOLE).fit(features.assemble(rows, ["m", "constant"]))
    return tuning.top_features(tuning.importances(model, ["m", "constant"], spark, "DRF", domain.scratch(spark, "forest")), 5)


# ---------------------------------------------------------------- maps


# Deeper models of several features have no closed form; what must hold of every row, and of the fit, is checked instead.

MONTHLY = ("cls", "col", "month", "price", "row")
MONTHLY_SQL = f"(select distinct a.r, a.c, q.yr, q.mon from {V['cube']} q join {V['cell']} a on a.r = q.r and a.c = q.c)"


def _monthly(spark, d):
    """Monthly use of the cube's cells on top of a need set by class and month, with the price and place of the cell as further features.

    A fit holds its rows as objects, many times their size in a shuffle, so they come in parts of a bounded number of rows.
    """
    p = domain.by_cell(spark, d, domain.parts(spark, d).select("row", "col", "cls", F.col("value").alias("price"), "crop"))
    used = domain.by_cell(spark, d, domain.cube(spark, d)).groupBy("row", "col", "year", "month").agg(F.sum("value").alias("used"))
    rows = used.join(p.hint("merge"), ["row", "col"]).select(
        F.concat_ws("-", "row", "col", "year", "month").alias("key"), "crop", (F.col("used") + F.col("cls") * 20.0 + F.col("month") * 10.0).alias("label"),
        F.col("row").alias("r"), F.col("col").alias("c"), "year", F.col("month").alias("mon"),
        *[F.col(c).cast("double").alias(c) for c in MONTHLY],
    )
    return features.assemble(rows, list(MONTHLY))


def _deep(name, bounded=True, **params):
    """Every row with whether its prediction lies between the labels, where the model averages labels, and whether the fit beats the mean."""

    def run(spark, d):
        rows = cut_lineage(_monthly(spark, d))
        model = estimators.configured(estimators.make_estimator(name, 7), params).fit(rows)
        told = cut_lineage(model.transform(rows).select("r", "c", "year", "mon", "label", "prediction"))
        y, p_ = F.col("label"), F.col("prediction")
        facts = told.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.stddev_pop(y).alias("sd"), F.sqrt(F.avg((y - p_) * (y - p_))).alias("rmse")).first()
        inside = p_.between(facts.lo - 1e-6, facts.hi + 1e-6) if bounded else p_.isNotNull() & ~F.isnan(p_)
        better = F.lit(bool(facts.rmse < 0.9 * facts.sd))
        return told.select(F.col("r").alias("row"), F.col("c").alias("col"), F.col("year").alias("yr"), "mon", inside.alias("inside"), better.alias("better"))

    return run


DEEP_SQL = f"""select r as "row", c as col, yr, mon, true as inside, true as better from {MONTHLY_SQL} t"""
query("forest_rows", DEEP_SQL)(_deep("DRF", numTrees=10, maxDepth=5, subsamplingRate=0.9, featureSubsetStrategy="0.8"))
query("bagged_rows", DEEP_SQL)(_deep("BT", numTrees=5, maxDepth=5))
query("extra_trees_rows", DEEP_SQL)(_deep("ETR", numTrees=5, maxDepth=5))
query("boosted_rows", DEEP_SQL)(_deep("LGBM", bounded=False, maxIter=5, maxDepth=4, stepSize=0.1))
query("adaboost_rows", DEEP_SQL)(_deep("ABR", maxIter=4, stepSize=0.5, maxDepth=3))


@query("search_choice", f"""
    select n, cast(c as int) as depth, c = 6 as chosen, true as told from (select count(*) as n from {MONTHLY_SQL} t) m, (values (1), (3), (6)) v(c)""")
def search_choice(spark, d):
    """Three depths over stratified folds of five features: the deepest explains most here, and is chosen by its validation error."""
    rows = cut_lineage(_monthly(spark, d))
    found = tuning.search(rows, "DT", "key", folds=3, repeats=1, strata=["crop"], grid={"maxDepth": [1, 3, 6], "minInstancesPerNode": [20]}, seed=7)
    least = min(c["validation_rmse"] for c in found.candidates)
    told = [
        (c["params"]["maxDepth"], c["params"] == found.best, (c["validation_rmse"] == least) == (c["params"] == found.best))
        for c in found.candidates
    ]
    made = spark.createDataFrame(told, "depth int, chosen boolean, told boolean")
    return made.withColumn("n", F.lit(rows.count()).cast("long"))


@query("importances_many", f"""
    select feature, feature = 'cls' as first, true as shared from (values ('cls'), ('col'), ('month'), ('price'), ('row')) v(feature)
    where (select count(*) from {MONTHLY_SQL} t) > 0""")
def importances_many(spark, d):
    """Shares of five features in a sampled forest; they add up to one, and the class, which sets most of the need, leads."""
    rows = cut_lineage(_monthly(spark, d))
    model = estimators.configured(estimators.make_estimator("RF", 7), {"numTrees": 5, "maxDepth": 4, "featureSubsetStrategy": "all"}).fit(rows)
    made = tuning.importances(model, MONTHLY, spark)
    whole = made.agg(F.abs(F.sum("importance") - 1).alias("off"), F.max("importance").alias("top")).first()
    return made.select("feature", (F.col("importance") == whole.top).alias("first"), F.lit(bool(whole.off < 1e-6)).alias("shared"))


@query("predictor_frame", f"""
    with m as (select r, c, yr, mon, avg(val) as v from {V['cube']} q group by 1, 2, 3, 4),
    y as (select distinct yr from {V['cube']} q), g as (select unnest(generate_series(1, 12)) as mon)
    select a.r as "row", a.c as col, y.yr as year, cast(g.mon as int) as month, round(m.v, 6) as ppt, a.val as awc,
      case cls when 1 then 'Corn' when 2 then 'Cotton' when 3 then 'Rice' when 5 then 'Soybeans' when 4 then null else 'Other' end as crop,
      round((a.c + 0.5) * 2e0, 6) as lon
    from {V['cell']} a cross join y cross join g left join
      m on a.r = m.r and a.c = m.c and y.yr = m.yr and g.mon = m.mon and a.cls <> 4""")
def predictor_frame(spark, d):
    return _predictors(spark, d).select(
        "row", "col", "year", "month", r(F.col("PPT"), 6).alias("ppt"), F.col("SWB_AWC").alias("awc"), "crop", r(F.col("lon"), 6).alias("lon")
    )


def _predictors(spark, d):
    spec = domain.cell_spec(spark, d)
    cube, p = domain.cube(spark, d), domain.parts(spark, d)
    years = cube.select("year").distinct().agg(F.sort_array(F.collect_set("year")).alias("_y"))
    code = F.when(F.col("cls") == 4, 0).otherwise(F.col("cls"))
    cover = p.withColumn("_y", years.scalar()).select("row", "col", code.alias("value"), F.explode("_y").alias("year"))
    blank = F.lit(None).cast("int")
    monthly = grid.composite(domain.by_cell(spark, d, cube), "mean").withColumn("dataset", F.lit("PPT"))
    static = p.select("row", "col", blank.alias("year"), blank.alias("month"), "value", F.lit("SWB_AWC").alias("dataset"))
    predictors = monthly.unionByName(static)
    return scoring.predictor_frame(cover, spec, predictors, ["PPT", "SWB_AWC"], features.MONTHS)


GROUP_MEANS = f"""(select avg(case when crop = '1-URGENT' then wu end) as rice, avg(case when crop = '2-HIGH' then wu end) as corn,
    avg(case when crop = '3-MEDIUM' then wu end) as cotton, avg(case when crop = '5-LOW' then wu end) as soy from {V['annual']} a)"""


@query("grid_scoring", f"""
    with m as (select r, c, yr, mon, avg(val) as v from {V['cube']} q group by 1, 2, 3, 4)
    select a.r as "row", a.c as col, m.yr as year, m.mon as month, case when a.val <= 1500 then round(10 * case cls when 1 then corn when 2 then cotton
      when 3 then rice when 5 then soy else (rice + corn + cotton + soy) / 4 end, 0) end as use
    from m join {V['cell']} a on a.r = m.r and a.c = m.c cross join {GROUP_MEANS} g where cls <> 4""")
def grid_scoring(spark, d):
    """Score every cell and month with a model of the class alone, whose fit is the class mean."""
    crop = F.col("crop")
    named = F.when(crop == "1-URGENT", "Rice").when(crop == "2-HIGH", "Corn").when(crop == "3-MEDIUM", "Cotton").when(crop == "5-LOW", "Soybeans")
    crops = ["Corn", "Cotton", "Rice", "Soybeans"]
    rows = domain.annual(spark, d).select(named.alias("crop"), F.col("wu").alias("label"), F.lit(0.0).alias("PPT")).where(F.col("crop").isNotNull())
    coded = features.one_hot(rows, {"crop": crops})
    names = ["PPT", *[f"crop_{c}" for c in crops]]
    model = LinearRegression(solver="normal", regParam=0.0, fitIntercept=False, labelCol="label").fit(features.assemble(coded, names))
    cells = _month_cells(spark, d)
    scored = scoring.score_cells(model, cells, ["PPT"], crops, "label", month_col=None)
    return scored.select("row", "col", "year", "month", r(F.col("value"), 0).alias("use"))


def _month_cells(spark, d):
    """Every cell and month; the predictor is zero, or missing for expensive parts."""
    months = grid.composite(domain.by_cell(spark, d, domain.cube(spark, d)), "mean")
    p = domain.parts(spark, d).where(F.col("cls") != 4).select("row", "col", recode_crop(F.col("cls")).alias("crop"), F.col("value").alias("price"))
    joined = months.join(domain.by_cell(spark, d, p).hint("merge"), ["row", "col"])
    return joined.select("row", "col", "year", "month", "crop", F.when(F.col("price") <= 1500, 0.0).alias("PPT"))


# A model whose terms are known exactly: the fit of noise-free rows gives them back.
CROP_TERMS = {"Corn": 20.0, "Cotton": 10.0, "Rice": 30.0, "Soybeans": 40.0}


@query("map_maker", f"""
    with y as (select distinct yr from {V['cube']} q), g as (select unnest(generate_series(1, 12)) as mon),
    fine as (select y.yr as year, cast(g.mon as int) as month, a.r as "row", a.c as col, case when cls <> 4 then 10 * (0.5e0 * a.val
      + 2e0 * (100e0 - (a.r + 0.5e0) * 2.5e0) + case cls when 1 then 20 when 2 then 10 when 3 then 30 when 5 then 40 else 25 end) end as v
      from {V['cell']} a cross join y cross join g),
    coarse as (select year, month, cast(floor("row" / 10) as int) as "row", cast(floor(col / 10) as int) as col, sum(v) as v from fine group by 1, 2, 3, 4)
    select 'fine' as map, year, month, "row", col, round(v, 2) as value from fine
    union all select 'coarse', year, month, "row", col, round(case when v > 0.5 then v end, 1) from coarse""")
def map_maker(spark, d):
    """Predictor frame, linear model, fine map and coarse sums for all months. The model does not use the masked predictor."""
    frame = _predictors(spark, d).persist()
    crops = sorted(CROP_TERMS)
    effect = F.element_at(F.create_map(*[F.lit(v) for pair in CROP_TERMS.items() for v in pair]), F.col("crop"))
    known = frame.where(F.col("crop").isin(crops)).withColumn("label", F.col("SWB_AWC") * 0.5 + F.col("lat") * 2.0 + effect)
    names = ["lat", "SWB_AWC", *[f"crop_{c}" for c in crops]]
    coded = features.assemble(features.one_hot(known, {"crop": crops}, drop=False), names)
    model = LinearRegression(solver="normal", regParam=0.0, fitIntercept=False, labelCol="label").fit(coded)
    scored = scoring.score_cells(model, frame, ["lat", "SWB_AWC"], crops, "label", month_col=None)
    fine, coarse = scoring.score_maps(scored)
    told = lambda df, name, digits: df.select(F.lit(name).alias("map"), "year", "month", "row", "col", r(F.col("value"), digits).alias("value"))
    return told(fine, "fine", 2).unionByName(told(coarse, "coarse", 1))


