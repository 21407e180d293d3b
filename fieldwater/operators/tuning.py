"""Search over parameters with repeated folds, importances, per-crop models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.operators.estimators import (
    SPLIT_COUNT_IMPORTANCES,
    WITH_IMPORTANCES,
    configured,
    make_estimator,
    parameter_sets,
)
from fieldwater.operators.evaluate import metric_columns
from fieldwater.operators.features import MinMaxScaler, assemble
from fieldwater.operators.split import repeated_folds

SCORES = ("r2", "rmse", "mae")


@dataclass
class SearchResult:
    """The refitted model, its parameters, and the mean scores of every candidate."""

    model: Model
    best: dict
    candidates: list[dict] = field(default_factory=list)

    def summary(self, scaler: MinMaxScaler | None = None, target: str | None = None) -> dict[str, float]:
        """Mean train and validation scores over all candidates; errors are put back in units of the target."""
        if not self.candidates:
            return {}
        keys = [f"{part}_{s}" for part in ("train", "validation") for s in SCORES]
        means = {k: sum(c[k] for c in self.candidates) / len(self.candidates) for k in keys}
        if scaler is not None and target is not None:
            lo, hi = scaler.limits[target]
            means = {k: v if k.endswith("r2") else v * ((hi - lo) or 1.0) for k, v in means.items()}
        return means


def search(
    train: DataFrame,
    name: str,
    key: str,
    label: str = "label",
    features: str = "features",
    folds: int = 5,
    repeats: int = 3,
    strata: Sequence[str] = (),
    grid: dict | None = None,
    draws: int | None = None,
    seed: int = 0,
    parallelism: int = 4,
) -> SearchResult:
    """Grid search (or ``draws`` seeded draws) over repeated, optionally stratified folds.

    Every fit is a distributed Spark ML fit on cached folds; train and
    validation scores come from one aggregation per fit. The best candidate by
    validation RMSE is refitted on all rows.
    """
    combos = parameter_sets(name, grid, draws, seed)
    if len(combos) == 1 and not combos[0]:
        combos = [{}]
    base = make_estimator(name, seed, features, label)
    folded = repeated_folds(train, key, folds, repeats, strata, seed).persist()
    jobs = [(i, r, f) for i in range(len(combos)) for r in range(repeats) for f in range(folds)]

    def score(job):
        i, r, f = job
        held = F.col(f"fold_{r}") == f
        model = configured(base, combos[i]).fit(folded.where(~held))
        scored = model.transform(folded).select(held.alias("_held"), F.col(label).alias("_y"), F.col("prediction").alias("_p"))
        made = metric_columns("_y", "_p")
        rows = scored.groupBy("_held").agg(*[made[s].alias(s) for s in SCORES]).collect()
        return i, {("validation" if row["_held"] else "train") + f"_{s}": row[s] for row in rows for s in SCORES}

    with ThreadPool(max(1, parallelism)) as pool:
        done = pool.map(score, jobs, chunksize=1)
    candidates = []
    for i, params in enumerate(combos):
        mine = [s for j, s in done if j == i]
        candidates.append({"params": params, **fold_means(mine)})
    best = min(candidates, key=lambda c: c["validation_rmse"])["params"]
    model = configured(base, best).fit(folded)
    folded.unpersist()
    return SearchResult(model, best, candidates)


def fold_means(scores: Sequence[dict]) -> dict[str, float]:
    """Mean of every score over the folds that have it; a score that no fold has is refused."""
    means = {}
    for key in [f"{part}_{s}" for part in ("train", "validation") for s in SCORES]:
        present = [s[key] for s in scores if s.get(key) is not None]
        if not present:
            raise ValueError(f"no fold has a {key}: there are too few rows for so many folds")
        means[key] = sum(present) / len(present)
    return means


def split_counts(model: Model, path: str, spark) -> DataFrame:
    """Number of splits per feature index of a tree model, read from its saved node table."""
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data*")
    node = F.col("nodeData.split.featureIndex") if "nodeData" in nodes.columns else F.col("split.featureIndex")
    return nodes.select(node.alias("feature")).where(F.col("feature") >= 0).groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits")
    )


def importances(model: Model, columns: Sequence[str], spark, name: str = "RF", path: str | None = None) -> DataFrame:
    """(feature, importance), normalised to 1, five decimals, descending.

    Boosted models and their forests count splits when a path for the node
    table is given; the others report impurity gain.
    """
    if name.split("_")[0] not in WITH_IMPORTANCES:
        raise ValueError(f"{name} has no importances")
    ordered = sorted(columns)
    if path and name.split("_")[0] in SPLIT_COUNT_IMPORTANCES:
        counted = {r["feature"]: r["splits"] for r in split_counts(model, path, spark).collect()}
        raw = [float(counted.get(i, 0)) for i in range(len(ordered))]
    else:
        raw = [float(v) for v in model.featureImportances.toArray()]
    total = sum(raw) or 1.0
    rows = [(c, round(v / total, 5)) for c, v in zip(ordered, raw)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def top_features(table: DataFrame, k: int = 5) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def per_crop_models(train: DataFrame, crops: Sequence[str], fit, crop_col: str = "crop") -> dict[str, Model]:
    """One model per crop. Crops are a short list; each fit is distributed over its rows."""
    return {c: fit(train.where(F.col(crop_col) == c)) for c in crops}


def predict_per_crop(models: dict[str, Model], df: DataFrame, crop_col: str = "crop") -> DataFrame:
    """Each row predicted by its crop's model; rows of no crop, or of one without a model, stay with a NULL prediction."""
    known = F.coalesce(F.col(crop_col).isin(list(models)), F.lit(False))
    out = df.where(~known).withColumn("prediction", F.lit(None).cast("double"))
    for crop, model in models.items():
        out = out.unionByName(model.transform(df.where(F.col(crop_col) == crop)))
    return out


def prediction_table(
    model: Model, rows: DataFrame, scaler: MinMaxScaler | None, target: str, columns: Sequence[str], label: str = "label"
) -> DataFrame:
    """Predictions with keys kept: actual, predicted and error in the units of the target, features unscaled.

    The absolute value is taken on the scaled prediction.
    """
    scored = model.transform(rows)
    predicted = F.abs(F.col("prediction"))
    actual = F.col(label)
    if scaler is not None:
        predicted, actual = scaler.unscale(target, predicted), scaler.unscale(target, actual)
        scored = scored.withColumns({c: scaler.unscale(c, F.col(f"`{c}`")) for c in columns if c in scaler.limits})
    out = scored.withColumns({"Pred_GW": predicted, "Actual_GW": actual})
    return out.withColumn("Error_GW", F.col("Actual_GW") - F.col("Pred_GW")).drop("features", "prediction", label)


__all__ = [
    "SearchResult",
    "assemble",
    "importances",
    "per_crop_models",
    "predict_per_crop",
    "prediction_table",
    "search",
    "split_counts",
    "top_features",
    "vector_to_array",
]
