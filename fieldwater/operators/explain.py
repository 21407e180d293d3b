"""Permutation importance and partial dependence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.operators.evaluate import metric_columns
from fieldwater.operators.features import assemble
from fieldwater.operators.quantiles import quantiles
from fieldwater.operators.ranking import hash_rank


def paired_rows(rows: DataFrame, columns: Sequence[str], key: str, seed: int | str) -> DataFrame:
    """Give every row another row's columns as ``_donor``, one-to-one, by pairing two hash orders of the table."""
    receivers = hash_rank(rows, [], key, f"{seed}a", "_rank")
    donated = rows.select(key, F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("_donor"))
    return receivers.join(hash_rank(donated, [], key, f"{seed}b", "_rank").select("_rank", "_donor"), "_rank").drop("_rank")


def permutation_importance(
    model: Model,
    rows: DataFrame,
    columns: Sequence[str],
    key: str,
    label: str = "label",
    features: Sequence[str] | None = None,
    repeats: int = 10,
    seed: int = 1,
) -> DataFrame:
    """Rise of the normalised RMSE when one feature is permuted: (feature, repeat, importance).

    A repeat is one pairing of the rows, shared by all features: each feature
    in turn takes the paired row's value, which is one more pass of the model
    over the same rows, and one aggregation scores all of them.
    """
    names = list(features or columns)
    rows = rows.select(key, label, *[F.col(f"`{c}`") for c in columns]).persist()
    whole = model.transform(assemble(rows, columns))
    base = whole.agg(metric_columns(label, "prediction")["nrmse"].alias("_score")).first()[0]
    parts = []
    for r in range(repeats):
        scored = paired_rows(rows, names, key, f"{seed}-{r}")
        for i, name in enumerate(names):
            swapped = scored.withColumn("_held", F.col(f"`{name}`")).withColumn(name, F.col("_donor")[name])
            ready = assemble(swapped, columns, f"_f{i}").withColumn(name, F.col("_held")).drop("_held")
            scored = model.copy({model.featuresCol: f"_f{i}", model.predictionCol: f"_p{i}"}).transform(ready)
        scores = scored.agg(*[metric_columns(label, f"_p{i}")["nrmse"].alias(f"_s{i}") for i in range(len(names))])
        told = [F.struct(F.lit(n).alias("feature"), F.lit(r).alias("repeat"), (F.col(f"_s{i}") - base).alias("importance")) for i, n in enumerate(names)]
        parts.append(scores.select(F.inline(F.array(*told))))
    return reduce(DataFrame.unionByName, parts)


def permutation_summary(importances: DataFrame, k: int = 10) -> DataFrame:
    """The k features with the highest mean importance."""
    means = importances.groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.stddev_samp("importance").alias("sd")
    )
    return means.orderBy(F.desc("importance"), "feature").limit(k)


def partial_dependence(
    model: Model,
    rows: DataFrame,
    columns: Sequence[str],
    feature: str,
    points: int = 100,
    low: float = 0.05,
    high: float = 0.95,
) -> DataFrame:
    """Mean prediction with one feature held at each of ``points`` values between two of its quantiles.

    Rows that agree in all other features are merged first and weighted. Each
    is expanded over the fixed grid in place and averaged on the map side, so
    ``points`` rows are shuffled per task. A feature with fewer distinct values
    than ``points`` is held at those values instead. Missing values are no place
    on the axis.
    """
    present = rows.where(F.col(f"`{feature}`").isNotNull())
    distinct = [r[0] for r in present.select(f"`{feature}`").distinct().limit(points).collect()]
    if len(distinct) < points:
        values = sorted(float(v) for v in distinct)
    else:
        lo, hi = quantiles(rows, [], feature, [low, high], ["lo", "hi"]).first()
        values = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    others = [F.col(f"`{c}`") for c in columns if c != feature]
    merged = rows.groupBy(*others).agg(F.count(F.lit(1)).alias("_c"))
    grid = F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(feature)
    scored = model.transform(assemble(merged.select(*others, "_c", grid), columns))
    mean = F.sum(F.col("prediction") * F.col("_c")) / F.sum("_c")
    return scored.groupBy(F.col(f"`{feature}`").alias("at")).agg(mean.alias("response")).withColumn("feature", F.lit(feature))
