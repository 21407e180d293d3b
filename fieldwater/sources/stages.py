"""Stage tables that a later run may reuse, and saved models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressionModel,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession

from fieldwater.operators.boosting import AdaBoostModel
from fieldwater.operators.features import MinMaxScaler
from fieldwater.operators.neighbours import NeighboursModel
from fieldwater.operators.support import SupportVectorModel

LOADERS = {
    "LGBM": GBTRegressionModel,
    "DRF": RandomForestRegressionModel,
    "RF": RandomForestRegressionModel,
    "ETR": RandomForestRegressionModel,
    "BT": RandomForestRegressionModel,
    "DT": DecisionTreeRegressionModel,
    "LR": LinearRegressionModel,
}

# Models of this library, which save themselves as tables.
OWN_MODELS = {"ABR": AdaBoostModel, "KNN": NeighboursModel, "SVR": SupportVectorModel}


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished stage lies at ``path``: a stage counts once its success marker is written.

    The marker is looked up in the stage's own file system, and a storage error is raised.
    """
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stage(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = False, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Read a stage table back when reuse is asked for and it exists, else build, write and read it.

    The written table also ends the lineage: what follows restarts from it.
    """
    if not (reuse and exists(spark, path)):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def save_model(model: Model, path: str) -> str:
    if isinstance(model, tuple(OWN_MODELS.values())):
        model.save_stage(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(name: str, path: str) -> Model:
    base = name.split("_")[0]
    if base in OWN_MODELS:
        return OWN_MODELS[base].load_stage(SparkSession.active(), path)
    if base not in LOADERS:
        raise ValueError(f"unknown model {name}")
    return LOADERS[base].load(path)


def save_scaler(scaler: MinMaxScaler, spark: SparkSession, path: str) -> str:
    scaler.table(spark).write.mode("overwrite").parquet(path)
    return path


def load_scaler(spark: SparkSession, path: str) -> MinMaxScaler:
    return MinMaxScaler.from_table(spark.read.parquet(path))
