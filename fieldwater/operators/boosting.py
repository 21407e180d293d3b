"""AdaBoost.R2 (Drucker, 1997) over Spark ML decision trees."""

from __future__ import annotations

import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.operators.nodes import NodeTable
from fieldwater.session import cut_lineage

CHECKPOINT_EVERY = 10


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed):
    loss = Param(Params._dummy(), "loss", "linear, square or exponential", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)


class AdaBoostRegressor(Estimator, _BoostParams):
    """Reweights rows after each tree by how badly it misses them.

    Weights live in a column and are updated by column arithmetic; the driver
    only sees the largest error and the weighted mean loss of each round. The
    lineage is cut every few rounds.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 maxIter=50, stepSize=1.0, loss="linear", maxDepth=3, seed=0):
        super().__init__()
        self._setDefault(maxIter=50, stepSize=1.0, loss="linear", maxDepth=3, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AdaBoostModel:
        label, rate = self.getLabelCol(), self.getStepSize()
        rows = df.select(self.getFeaturesCol(), F.col(label).cast("double").alias(label)).withColumn("_w", F.lit(1.0))
        rows = cut_lineage(rows)
        trees, weights = [], []
        for i in range(self.getMaxIter()):
            tree = DecisionTreeRegressor(
                featuresCol=self.getFeaturesCol(), labelCol=label, predictionCol="_p", weightCol="_w",
                maxDepth=self.getOrDefault("maxDepth"), seed=self.getSeed() + i,
            ).fit(rows)
            missed = tree.transform(rows).withColumn("_e", F.abs(F.col(label) - F.col("_p"))).drop("_p")
            worst = missed.agg(F.max("_e")).first()[0]
            if not worst:
                trees.append(tree)
                weights.append(1.0 if not weights else max(weights))
                break
            share = F.col("_e") / worst
            lost = {
                "linear": share,
                "square": share * share,
                "exponential": 1 - F.exp(-share),
            }[self.getOrDefault("loss")]
            mean_loss = missed.agg(F.sum(F.col("_w") * lost) / F.sum("_w")).first()[0]
            if mean_loss >= 0.5:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = max(mean_loss / (1 - mean_loss), 1e-12)
            trees.append(tree)
            weights.append(rate * math.log(1 / beta))
            rows = missed.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), rate * (1 - lost))).drop("_e")
            if (i + 1) % CHECKPOINT_EVERY == 0:
                rows = cut_lineage(rows)
        nodes = NodeTable()
        for tree in trees:
            nodes.add_tree(tree)
        return AdaBoostModel(nodes, weights, self.getFeaturesCol(), self.getPredictionCol())


class AdaBoostModel(Model, _BoostParams):
    """Weighted median of the trees' predictions, walked through one table of nodes."""

    def __init__(self, nodes, weights, features, prediction):
        super().__init__()
        self.nodes, self.weights = nodes, weights
        self._setDefault(maxIter=50, stepSize=1.0, loss="linear", maxDepth=3, seed=0)
        self._set(featuresCol=features, predictionCol=prediction)

    def copy(self, extra=None):
        new = AdaBoostModel(self.nodes, self.weights, self.getFeaturesCol(), self.getPredictionCol())
        names = {p.name: v for p, v in (extra or {}).items()}
        return new._set(**names)

    def save_stage(self, path: str) -> None:
        """The nodes as a table, and what joins the trees."""
        spark = SparkSession.active()
        self.nodes.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        told = json.dumps([[float(w) for w in self.weights], self.getFeaturesCol(), self.getPredictionCol()])
        spark.createDataFrame([(told,)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load_stage(cls, spark: SparkSession, path: str) -> AdaBoostModel:
        weights, features, prediction = json.loads(spark.read.parquet(f"{path}/settings").first()[0])
        return cls(NodeTable.from_table(spark.read.parquet(f"{path}/nodes")), weights, features, prediction)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), self.nodes.weighted_median(F.col(self.getFeaturesCol()), self.weights))
