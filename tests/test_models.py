import time

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from fieldwater.operators import estimators, evaluate, explain, features, scoring, tuning
from fieldwater.operators.boosting import AdaBoostModel, AdaBoostRegressor
from fieldwater.operators.neighbours import NeighboursRegressor
from fieldwater.operators.nodes import NodeTable
from fieldwater.operators.support import LOSSES, SupportVectorRegressor


def plain_linear(df, **kw):
    return LinearRegression(solver="normal", regParam=0.0, labelCol="label", **kw).fit(df)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.01 * rng.normal(size=300)
    data = [(i, *map(float, v), 1.0, float(t), "ab"[i % 2]) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, k double, label double, g string").persist()


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "Actual_GW double, Pred_GW double")
    row = evaluate.metrics(df).first()
    assert (row.r2, row.mae, row.rmse) == (0.5, 0.333, 0.577) and row.nrmse == pytest.approx(28.868)


def test_metrics_without_rows_or_mean(spark):
    empty = spark.createDataFrame([], "Actual_GW double, Pred_GW double")
    assert set(evaluate.metrics(empty).first()) == {None}
    zero = spark.createDataFrame([(-1.0, 1.0), (1.0, 1.0)], "Actual_GW double, Pred_GW double")
    assert evaluate.metrics(zero).first().nrmse is None


def test_error_in_units_has_no_offset():
    scaler = features.MinMaxScaler({"y": (100.0, 300.0)})
    found = tuning.SearchResult(None, {}, [{f"{p}_{s}": 0.5 for p in ("train", "validation") for s in ("r2", "rmse", "mae")}])
    assert found.summary(scaler, "y")["train_rmse"] == 100.0 and found.summary(scaler, "y")["train_r2"] == 0.5


@pytest.mark.parametrize("name", [n for n in estimators.NAMES if n not in ("ABR", "KNN")])
def test_every_estimator_fits_its_grid_point(rows, name):
    params = {k: v[0] for k, v in estimators.GRIDS[name].items()}
    small = {"numTrees": 3, "maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 1}
    params = {k: small.get(k, v) for k, v in params.items()}
    vectors = features.assemble(rows, ["a", "b", "c"])
    model = estimators.configured(estimators.make_estimator(name, 1), params).fit(vectors)
    assert model.transform(vectors).where(F.col("prediction").isNull()).isEmpty()


def test_unknown_estimator():
    with pytest.raises(ValueError):
        estimators.make_estimator("XGB")


def test_random_search_draws():
    assert len(estimators.parameter_sets("LGBM", draws=10, seed=1)) == 10
    assert estimators.parameter_sets("LGBM", draws=10, seed=1) == estimators.parameter_sets("LGBM", draws=10, seed=1)
    assert len(estimators.parameter_sets("RF")) == 3


def test_search_prefers_the_better_depth(rows):
    vectors = features.assemble(rows, ["a", "b", "c"])
    found = tuning.search(vectors, "DT", "id", folds=3, repeats=1, strata=["g"], grid={"maxDepth": [1, 5]}, seed=3)
    assert found.best == {"maxDepth": 5} and len(found.candidates) == 2
    assert found.candidates[1]["validation_r2"] > found.candidates[0]["validation_r2"]


def test_boosting_follows_the_definition(spark):
    """Weights of three rounds and the weighted median, recomputed from the trees' predictions."""
    rng = np.random.default_rng(4)
    x = np.sort(rng.random(40))
    y = np.sin(6 * x)
    df = features.assemble(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, label double"), ["a"])
    model = AdaBoostRegressor(maxIter=3, stepSize=0.5, maxDepth=2).fit(df)

    told = df.withColumn("votes", model.nodes.predictions(F.col("features"))).orderBy("a").collect()
    votes = np.array([r.votes for r in told]).T
    first = DecisionTreeRegressor(maxDepth=2, seed=0).fit(df).transform(df).orderBy("a").collect()
    assert list(votes[0]) == [r.prediction for r in first]
    w = np.ones(len(y))
    for p, weight in zip(votes, model.weights):
        loss = np.abs(p - y) / np.abs(p - y).max()
        mean = (w * loss).sum() / w.sum()
        beta = mean / (1 - mean)
        assert weight == pytest.approx(0.5 * np.log(1 / beta))
        w = w * beta ** (0.5 * (1 - loss))
    order = votes.argsort(axis=0)
    share = np.array(model.weights)[order].cumsum(axis=0)
    middle = order[(share >= 0.5 * sum(model.weights)).argmax(axis=0), np.arange(len(y))]
    made = [r.prediction for r in model.transform(df).orderBy("a").collect()]
    assert made == pytest.approx(votes[middle, np.arange(len(y))])


def test_plan_does_not_grow_with_trees(spark):
    def model(count):
        nodes = NodeTable()
        for k in range(count):
            root = nodes.add_node(0, k / count, len(nodes.feature) + 1, len(nodes.feature) + 2, 0.0)
            nodes.add_node(-1, 0.0, 0, 0, float(k))
            nodes.add_node(-1, 0.0, 0, 0, float(-k))
            nodes.roots.append(root)
        nodes.depth = 1
        return AdaBoostModel(nodes, [1.0] * count, "features", "prediction")

    df = features.assemble(spark.createDataFrame([(0.25, 1.0), (0.75, 1.0)], "a double, label double"), ["a"])
    model(2).transform(df)._jdf.queryExecution().executedPlan()
    start = time.perf_counter()
    made = model(800).transform(df)
    size = made._jdf.queryExecution().executedPlan().expressions().size()
    assert time.perf_counter() - start < 2
    assert size == model(2).transform(df)._jdf.queryExecution().executedPlan().expressions().size()
    for a, got in made.select("a", "prediction").collect():
        votes = sorted(float(k) if a <= k / 800 else float(-k) for k in range(800))
        assert got == votes[399]


@pytest.mark.parametrize("epsilon", [0.0, 0.05])
@pytest.mark.parametrize("loss", LOSSES)
def test_support_vectors_reach_the_least_objective(spark, loss, epsilon):
    """The objective recomputed from the coefficients lies within the gap of a bound found without the library."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.random((200, 2)), np.ones(200)]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.3 * rng.standard_t(2, 200)
    df = features.assemble(
        spark.createDataFrame([(float(a), float(b), float(t)) for (a, b, _), t in zip(x, y)] + [(1.0, 1.0, None)], "a double, b double, label double"), ["a", "b"])
    model = SupportVectorRegressor(loss=loss, C=1.5, epsilon=epsilon, tol=1e-9).fit(df)

    def objective(w):
        out = np.maximum(np.abs(y - x @ w) - epsilon, 0)
        return 0.5 * w @ w + 1.5 * (out if loss == LOSSES[0] else out * out).sum()

    found = np.array([*model.coefficients, model.intercept])
    assert objective(found) == pytest.approx(model.objective) and model.gap <= 1e-9 * model.objective and model.passes < 120
    near = found + 1e-3 * rng.normal(size=(500, 3))
    far = found + rng.normal(size=(500, 3))
    assert min(map(objective, [*near, *far])) >= model.objective - model.gap
    told = model.transform(df.where("label is not null")).select("a", "b", "prediction").collect()
    assert [r.prediction for r in told] == pytest.approx([model.coefficients[0] * r.a + model.coefficients[1] * r.b + model.intercept for r in told])


def test_support_vectors_of_odd_tables(spark):
    empty = features.assemble(spark.createDataFrame([], "a double, label double"), ["a"])
    with pytest.raises(ValueError):
        SupportVectorRegressor().fit(empty)
    with pytest.raises(ValueError):
        SupportVectorRegressor(loss="absolute").fit(empty)
    zero = features.assemble(spark.createDataFrame([(1.0, 0.0), (1.0, 0.0)], "a double, label double"), ["a"])
    model = SupportVectorRegressor().fit(zero)
    assert model.coefficients == [0.0] and model.intercept == 0.0 and model.gap == 0


def test_weighted_median_of_equal_votes(spark):
    df = features.assemble(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, label double"), ["a"])
    model = AdaBoostRegressor(maxIter=5).fit(df)
    assert [r.prediction for r in model.transform(df).collect()] == [2.0, 2.0]


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("block_rows", [50_000, 40])
@pytest.mark.parametrize("p", [1.0, 3.0])
def test_neighbours_equal_brute_force(spark, weights, block_rows, p):
    rng = np.random.default_rng(7)
    train, y = np.round(rng.random((120, 2)), 2), rng.random(120)
    train, y = np.r_[train, np.repeat(train[:1], 30, axis=0)], np.r_[y, np.repeat(y[:1], 30)]
    queries = np.r_[rng.random((30, 2)), train[:3]]
    to_df = lambda xs, ys: features.assemble(
        spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(xs, ys))], "i int, a double, b double, label double"), ["a", "b"])
    model = NeighboursRegressor(k=5, weights=weights, p=p).fit(to_df(train, y))
    made = {r.i: r.prediction for r in model._transform(to_df(queries, np.zeros(len(queries))), block_rows).collect()}
    for i, q in enumerate(queries):
        d = (np.abs(train - q) ** p).sum(axis=1) ** (1 / p)
        near = np.lexsort((y, d))[:5]
        if weights == "uniform":
            want = y[near].mean()
        elif (d[near] == 0).any():
            want = y[near][d[near] == 0].mean()
        else:
            want = np.average(y[near], weights=1 / d[near])
        assert made[i] == pytest.approx(want)


def test_importances_are_shares(spark, rows, tmp_path):
    vectors = features.assemble(rows, ["a", "b", "c"])
    model = estimators.configured(estimators.make_estimator("RF", 1), {"numTrees": 3}).fit(vectors)
    gain = {r.feature: r.importance for r in tuning.importances(model, ["a", "b", "c"], spark).collect()}
    assert sum(gain.values()) == pytest.approx(1, abs=1e-4) and gain["a"] > gain["c"]
    boosted = estimators.configured(estimators.make_estimator("LGBM", 1), {"maxIter": 2}).fit(vectors)
    split = tuning.importances(boosted, ["a", "b", "c"], spark, "LGBM", str(tmp_path / "m"))
    nodes = sum(t.numNodes // 2 for t in boosted.trees)
    assert tuning.split_counts(boosted, str(tmp_path / "m"), spark).agg(F.sum("splits")).first()[0] == nodes
    assert sum(r.importance for r in split.collect()) == pytest.approx(1, abs=1e-4)


def test_permuting_a_constant_changes_nothing(rows):
    model = plain_linear(features.assemble(rows, ["a", "b", "k"]))
    made = {(r.feature, r.repeat): r.importance for r in explain.permutation_importance(model, rows, ["a", "b", "k"], "id", repeats=2).collect()}
    assert made[("k", 0)] == pytest.approx(0, abs=1e-9) and made[("k", 1)] == pytest.approx(0, abs=1e-9) and made[("a", 0)] > 1


def test_permutation_is_one_to_one(rows):
    mixed = explain.paired_rows(rows.select("id", "a"), ["a"], "id", 3)
    before, after = {r.id: r.a for r in rows.collect()}, {r.id: r._donor.a for r in mixed.collect()}
    assert sorted(before.values()) == sorted(after.values()) and before != after


def test_partial_dependence_of_a_plane(rows):
    model = plain_linear(features.assemble(rows, ["a", "b", "c"]))
    made = explain.partial_dependence(model, rows, ["a", "b", "c"], "a", points=10).orderBy("at").collect()
    slope = (made[-1].response - made[0].response) / (made[-1]["at"] - made[0]["at"])
    assert len(made) == 10 and slope == pytest.approx(model.coefficients[0])
    values = sorted(r.a for r in rows.collect())
    assert made[0]["at"] == pytest.approx(np.quantile(values, 0.05))


def test_per_crop_models(rows):
    vectors = features.assemble(rows, ["a", "b"])
    models = tuning.per_crop_models(vectors, ["a", "b"], plain_linear, "g")
    assert tuning.predict_per_crop(models, vectors, "g").count() == 300


def test_other_cells_take_the_mean_of_the_variants(spark):
    crops = ["Corn", "Cotton", "Fish Culture", "Rice", "Soybeans"]
    means = {"Rice": 1.0, "Corn": 2.0, "Cotton": 3.0, "Soybeans": 6.0, "Fish Culture": 9.0}
    train = spark.createDataFrame([(c, float(i), m) for c, m in means.items() for i in range(3)], "crop string, t double, label double")
    coded = features.one_hot(train, {"crop": crops})
    names = ["t", *[f"crop_{c}" for c in crops]]
    model = plain_linear(features.assemble(coded, names), fitIntercept=False)
    cells = spark.createDataFrame([(0, 0, "Other", 1.0), (0, 1, "Rice", 1.0), (0, 2, "Other", None), (0, 3, "Fish Culture", 2.0), (0, 4, None, float("nan"))], "row int, col int, crop string, t double")
    made = {r["col"]: r["value"] for r in scoring.score_cells(model, cells, ["t"], crops, "label", month_col=None, volume_units=False).collect()}
    assert made[0] == pytest.approx(3) and made[1] == pytest.approx(1) and made[3] == pytest.approx(9)
    assert made[2] is None and made[4] is None
    volume = scoring.score_cells(model, cells, ["t"], crops, "label", month_col=None)
    assert {r["col"]: r["value"] for r in volume.collect()}[1] == pytest.approx(10)


@pytest.mark.parametrize(("name", "params"), [("KNN", {"k": 3}), ("ABR", {"maxIter": 3, "maxDepth": 2}), ("SVR", {"C": 1.5})])
def test_own_models_come_back(spark, rows, name, params):
    from fieldwater.plans.domain import scratch
    from fieldwater.sources import stages

    vectors = features.assemble(rows, ["a", "b", "c"])
    model = estimators.configured(estimators.make_estimator(name, 1), params).fit(vectors)
    path = stages.save_model(model, scratch(spark, "own"))
    told = lambda m: sorted((r.id, r.prediction) for r in m.transform(vectors).collect())
    assert told(stages.load_model(name, path)) == told(model)


def test_neighbours_without_all_pairs(spark):
    """Far rows never meet: each query reaches a few cells, and the plan has no cross join."""
    from fieldwater.operators import neighbours

    rng = np.random.default_rng(1)
    data = [(float(a), float(b), float(a)) for a, b in rng.random((3000, 2))] + [(0.5, 0.5, 1.0)] * 1500
    ready = features.assemble(spark.createDataFrame(data, "a double, b double, label double"), ["a", "b"])
    model = NeighboursRegressor(k=5).fit(ready)
    made = model._transform(ready.limit(200).select("features"), 300)
    assert "CartesianProduct" not in (plan := made._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert made.where("prediction is null").count() == 0
    pivots = np.array([[0.0, 0.0], [1.0, 1.0], [5.0, 5.0]])
    import pandas as pd

    reach = neighbours._reach(pivots, np.array([0.1, 0.1, 0.1]), np.array([9, 9, 9]), 3, 2.0)
    out = next(reach(iter([pd.DataFrame({"_id": [b"q"], "_x": [np.array([0.0, 0.1])]})])))
    assert list(out["_cell"]) == [0]
