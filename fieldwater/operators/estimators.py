"""The estimator menu: names, Spark ML estimators and tuning grids."""

from __future__ import annotations

import itertools
import random

from pyspark.ml import Estimator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

from fieldwater.operators.boosting import AdaBoostRegressor
from fieldwater.operators.neighbours import NeighboursRegressor
from fieldwater.operators.support import LOSSES, SupportVectorRegressor

MAX_DEPTH = 30  # deepest tree Spark ML grows; stands in for "no limit"

# ---- Fixed values: tuning grids, expressed in Spark ML parameters. Parameters without a Spark ML
# counterpart (leaf count, path smoothing, column sampling by tree) are left out.
GRIDS = {
    "LGBM": {
        "maxIter": [300, 400, 500, 800],
        "maxDepth": [16, 20, MAX_DEPTH],
        "stepSize": [0.01, 0.05],
        "subsamplingRate": [1.0, 0.9],
        "featureSubsetStrategy": ["1.0", "0.9"],
        "minInstancesPerNode": [20, 30, 40],
    },
    "DRF": {
        "numTrees": [500, 800],
        "maxDepth": [16, 20, MAX_DEPTH],
        "subsamplingRate": [0.9, 0.5],
        "featureSubsetStrategy": ["0.8", "0.9"],
        "minInstancesPerNode": [20, 30, 40],
    },
    "RF": {"numTrees": [500], "maxDepth": [MAX_DEPTH], "minInstancesPerNode": [5, 6, 7]},
    "ETR": {"numTrees": [500], "maxDepth": [MAX_DEPTH], "minInstancesPerNode": [1, 2, 3, 4, 5, 6, 7]},
    "DT": {"maxDepth": [10, 20, MAX_DEPTH], "minInstancesPerNode": [1, 2]},
    "BT": {"numTrees": [500], "featureSubsetStrategy": ["all", "10", "5", "7"], "subsamplingRate": [1.0, 0.9]},
    "ABR": {"maxIter": [800], "stepSize": [0.005], "loss": ["linear", "square"]},
    "KNN": {"k": [20, 40, 50], "weights": ["uniform", "distance"], "p": [1, 3]},
    "SVR": {"C": [1.0, 1.5, 2.0], "maxIter": [3000, 5000], "loss": list(LOSSES)},
    "LR": {},
}
NAMES = tuple(GRIDS)
WITH_IMPORTANCES = ("RF", "ETR", "LGBM", "DRF")
SPLIT_COUNT_IMPORTANCES = ("LGBM", "DRF")


def make_estimator(name: str, seed: int = 0, features: str = "features", label: str = "label") -> Estimator:
    """A fresh estimator by menu name. A suffix after ``_`` is ignored.

    ETR is a forest with coarse bins (Spark ML draws no random thresholds), a
    stand-in, not an equivalent.
    """
    base = name.split("_")[0]
    common = {"featuresCol": features, "labelCol": label, "predictionCol": "prediction"}
    menu = {
        "LGBM": lambda: GBTRegressor(seed=seed, maxBins=256, **common),
        "DRF": lambda: RandomForestRegressor(seed=seed, maxBins=256, **common),
        "RF": lambda: RandomForestRegressor(seed=seed, featureSubsetStrategy="all", maxBins=256, **common),
        "ETR": lambda: RandomForestRegressor(seed=seed, featureSubsetStrategy="all", maxBins=8, **common),
        "DT": lambda: DecisionTreeRegressor(seed=seed, maxBins=256, **common),
        "BT": lambda: RandomForestRegressor(seed=seed, featureSubsetStrategy="all", maxBins=256, **common),
        "ABR": lambda: AdaBoostRegressor(seed=seed, **common),
        "KNN": lambda: NeighboursRegressor(**common),
        "SVR": lambda: SupportVectorRegressor(**common),
        "LR": lambda: LinearRegression(solver="normal", regParam=0.0, **common),
    }
    if base not in menu:
        raise ValueError(f"unknown model {name}; choose from {', '.join(NAMES)}")
    return menu[base]()


def parameter_sets(name: str, grid: dict | None = None, draws: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations of a grid, or ``draws`` of them picked by seed."""
    chosen = GRIDS[name.split("_")[0]] if grid is None else grid
    combos = [dict(zip(chosen, values)) for values in itertools.product(*chosen.values())]
    if draws is not None and draws < len(combos):
        combos = random.Random(seed).sample(combos, draws)
    return combos


def configured(estimator: Estimator, params: dict) -> Estimator:
    return estimator.copy({estimator.getParam(k): v for k, v in params.items()})
