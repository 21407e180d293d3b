"""Linear support-vector regression with both epsilon losses."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasFitIntercept, HasLabelCol, HasMaxIter, HasPredictionCol, HasTol
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.session import cut_lineage

LOSSES = ("epsilon_insensitive", "squared_epsilon_insensitive")
STEPS = tuple(0.5**k for k in range(24))  # step lengths that one pass tries
NARROWER = 0.2  # how much each round narrows the smoothed corner of the loss


class _SupportParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasTol, HasFitIntercept):
    loss = Param(Params._dummy(), "loss", "epsilon_insensitive or squared_epsilon_insensitive", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "weight of the loss against the squared coefficients", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to this size cost nothing", TypeConverters.toFloat)


def _smoothed(excess, loss: str, width: float):
    """Value, slope and curvature of the loss at ``excess`` = |error| - epsilon; the corner of the linear loss is rounded over ``width``."""
    out = np.maximum(excess, 0.0)
    if loss == "squared_epsilon_insensitive":
        return out * out, 2 * out, 2.0 * (excess > 0)
    inside = (excess > 0) & (excess <= width)
    return np.where(inside, out * out / (2 * width), out - np.where(excess > 0, width / 2, 0.0)), np.minimum(out / width, 1.0), inside / width


def _passes(at: np.ndarray, loss: str, eps: float, cost: float, width: float, step: np.ndarray | None):
    """Partial sums of one partition, by position.

    Without a step: smoothed loss, loss, distance of the row's dual value from
    its loss, slope, the upper triangle of the curvature, and by how much the
    rows in the rounded corner lie beyond it. With a step: the smoothed loss at
    each length of it.
    """
    size = len(at)
    upper = np.triu_indices(size)

    def run(batches):
        total = np.zeros(3 + 2 * size + len(upper[0]) if step is None else len(STEPS))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            error = pdf["y"].to_numpy() - x @ at
            if step is not None:
                moved = x @ step
                for k, s in enumerate(STEPS):
                    total[k] += _smoothed(np.abs(error - s * moved) - eps, loss, width)[0].sum()
                continue
            excess = np.abs(error) - eps
            value, slope, curve = _smoothed(excess, loss, width)
            true = np.maximum(excess, 0.0)
            if loss == LOSSES[0]:
                apart = (true * (1 - slope)).sum()
            else:
                true, apart = true * true, 0.0
            bent = (x * curve[:, None]).T @ x
            beyond = (curve * np.maximum(excess, 0.0) * np.sign(error)) @ x
            total += np.concatenate([[value.sum(), true.sum(), cost * apart], (slope * np.sign(error)) @ x, bent[upper], beyond])
        yield pd.DataFrame({"position": np.arange(len(total)), "value": total})

    return run


class SupportVectorRegressor(Estimator, _SupportParams):
    """Minimises half the squared coefficients plus C times the summed loss.

    The intercept is the coefficient of a constant feature, so it counts in the
    squares too. The corner of the linear loss is rounded over a width that
    shrinks from round to round; within a round Newton steps are taken, whose
    gradient and curvature are summed by partition and then by position, so the
    driver gets numbers for features and pairs of features only, however many
    rows there are. Every pass also sums the distance between the objective and
    a lower bound of it (the dual value at the slopes), and the fit ends once
    that distance is ``tol`` of the objective; ``maxIter`` bounds the passes.

    Rows with a NULL or NaN label or a NULL vector are not fitted. A table
    without rows is refused.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 maxIter=1000, tol=1e-8, fitIntercept=True, loss="epsilon_insensitive", C=1.0, epsilon=0.0):
        super().__init__()
        self._setDefault(maxIter=1000, tol=1e-8, fitIntercept=True, loss="epsilon_insensitive", C=1.0, epsilon=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SupportVectorModel:
        loss, cost, eps = (self.getOrDefault(n) for n in ("loss", "C", "epsilon"))
        if loss not in LOSSES:
            raise ValueError(f"unknown loss {loss}; choose from {', '.join(LOSSES)}")
        x = vector_to_array(F.col(self.getFeaturesCol()))
        if self.getFitIntercept():
            x = F.concat(x, F.array(F.lit(1.0)))
        y = F.col(self.getLabelCol()).cast("double")
        rows = cut_lineage(df.where(F.col(self.getFeaturesCol()).isNotNull() & y.isNotNull() & ~F.isnan(y)).select(x.alias("x"), y.alias("y")))
        first = rows.agg(F.max(F.size("x")).alias("n"), F.avg(F.abs("y")).alias("scale")).first()
        if first.n is None:
            raise ValueError("there are no rows to fit")
        size = first.n
        upper = np.triu_indices(size)

        def summed(at, width, step=None):
            parts = rows.mapInPandas(_passes(at, loss, eps, cost, width, step), "position int, value double")
            got = {r.position: r.total for r in parts.groupBy("position").agg(F.sum("value").alias("total")).collect()}
            return np.array([got[k] for k in range(len(got))])

        def look(at, width):
            told = summed(at, width)
            curve = np.zeros((size, size))
            curve[upper] = told[3 + size : -size]
            curve = curve + np.triu(curve, 1).T
            slope = at - cost * told[3 : 3 + size]
            half = 0.5 * at @ at
            # Where the corner's rows would lie on it; a narrower corner has its best point nearer to that place.
            corner = at + np.linalg.lstsq(curve, told[-size:], rcond=1e-9)[0]
            return half + cost * told[0], half + cost * told[1], told[2], slope, np.eye(size) + cost * curve, corner

        at, width, passes = np.zeros(size), first.scale or 1.0, 1
        value, whole, apart, slope, curve, corner = look(at, width)
        best, best_gap, best_whole = at, np.inf, whole
        while True:
            rest = 0.5 * slope @ slope
            gap = apart + rest
            if gap < best_gap:
                best, best_gap, best_whole = at, gap, whole
            enough = self.getTol() * max(whole, 1e-300)
            if gap <= enough or passes >= self.getMaxIter():
                break
            if rest <= max(0.1 * apart, 0.1 * enough):
                width *= NARROWER
                at = corner + NARROWER * (at - corner)
                value, whole, apart, slope, curve, corner = look(at, width)
                passes += 1
                continue
            step = -np.linalg.solve(curve, slope)
            fall = slope @ step
            made = look(at + step, width)
            passes += 1
            if made[0] > value + 1e-4 * fall:
                # The whole step is too long: one pass tells the objective at every shorter one.
                tried = summed(at, width, step)
                moved = at + np.outer(STEPS, step)
                reached = 0.5 * (moved * moved).sum(axis=1) + cost * tried
                k = int(reached.argmin())
                passes += 1
                if reached[k] >= value:
                    break  # no step lowers it any more in floating point
                step = STEPS[k] * step
                made = look(at + step, width)
                passes += 1
            at = at + step
            value, whole, apart, slope, curve, corner = made
        bias = float(best[-1]) if self.getFitIntercept() else 0.0
        weights = best[:-1] if self.getFitIntercept() else best
        return SupportVectorModel(
            [float(w) for w in weights], bias, self.getFeaturesCol(), self.getPredictionCol(),
            objective=float(best_whole), gap=float(best_gap), passes=passes,
        )


class SupportVectorModel(Model, _SupportParams):
    """A linear model; ``gap`` bounds how far its objective is from the least one."""

    def __init__(self, coefficients, intercept, features, prediction, objective=None, gap=None, passes=None):
        super().__init__()
        self.coefficients, self.intercept = coefficients, intercept
        self.objective, self.gap, self.passes = objective, gap, passes
        self._setDefault(maxIter=1000, tol=1e-8, fitIntercept=True, loss="epsilon_insensitive", C=1.0, epsilon=0.0)
        self._set(featuresCol=features, predictionCol=prediction)

    def copy(self, extra=None):
        new = SupportVectorModel(
            self.coefficients, self.intercept, self.getFeaturesCol(), self.getPredictionCol(), self.objective, self.gap, self.passes
        )
        return new._set(**{p.name: v for p, v in (extra or {}).items()})

    def save_stage(self, path: str) -> None:
        told = json.dumps([self.coefficients, self.intercept, self.getFeaturesCol(), self.getPredictionCol(), self.objective, self.gap, self.passes])
        SparkSession.active().createDataFrame([(told,)], "settings string").write.mode("overwrite").parquet(path)

    @classmethod
    def load_stage(cls, spark: SparkSession, path: str) -> SupportVectorModel:
        return cls(*json.loads(spark.read.parquet(path).first()[0]))

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.coefficients]).cast("array<double>")
        terms = F.zip_with(vector_to_array(F.col(self.getFeaturesCol())), weights, lambda v, w: v * w)
        return df.withColumn(self.getPredictionCol(), F.aggregate(terms, F.lit(self.intercept), lambda total, term: total + term))
