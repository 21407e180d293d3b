"""Trees as one table of nodes, walked inside an expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node int, root boolean, feature int, threshold double, low int, high int, value double, depth int"


def numbers(values: Sequence, kind: str) -> Column:
    """A constant array as one foldable text, so that a plan holds a single literal whatever its length."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class NodeTable:
    """Nodes of all trees of an ensemble; a leaf has feature -1, a row goes low at or below the threshold.

    Expressions made from it have the same size for one tree and for a
    thousand: the arrays are constants, and a walk is as many steps as the
    deepest tree has levels.
    """

    def __init__(self) -> None:
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.value: list[float] = []
        self.depth = 0

    def add_node(self, feature: int, threshold: float, low: int, high: int, value: float) -> int:
        for column, given in zip((self.feature, self.threshold, self.low, self.high, self.value), (feature, threshold, low, high, value)):
            column.append(given)
        return len(self.feature) - 1

    def add_tree(self, tree) -> None:
        """The nodes of a fitted Spark ML tree, read once."""
        root = self.add_node(-1, 0.0, 0, 0, 0.0)
        todo = [(tree._call_java("rootNode"), root, 0)]
        while todo:
            node, at, level = todo.pop()
            self.depth = max(self.depth, level)
            self.value[at] = float(node.prediction())
            if node.subtreeDepth() == 0:
                continue
            split = node.split()
            if not split.getClass().getSimpleName() == "ContinuousSplit":
                raise ValueError("only splits of continuous features can be walked")
            self.feature[at], self.threshold[at] = split.featureIndex(), float(split.threshold())
            self.low[at] = self.add_node(-1, 0.0, 0, 0, 0.0)
            self.high[at] = self.add_node(-1, 0.0, 0, 0, 0.0)
            todo += [(node.leftChild(), self.low[at], level + 1), (node.rightChild(), self.high[at], level + 1)]
        self.roots.append(root)

    def table(self, spark: SparkSession) -> DataFrame:
        roots = set(self.roots)
        rows = zip(range(len(self.feature)), self.feature, self.threshold, self.low, self.high, self.value, strict=True)
        return spark.createDataFrame([(n, n in roots, f, t, lo, hi, v, self.depth) for n, f, t, lo, hi, v in rows], NODES)

    @classmethod
    def from_table(cls, table: DataFrame) -> NodeTable:
        """A model's own nodes: as many as its fit made."""
        made = cls()
        for r in table.orderBy("node").collect():
            if r.root:
                made.roots.append(r.node)
            made.add_node(r.feature, r.threshold, r.low, r.high, r.value)
            made.depth = r.depth
        return made

    def predictions(self, features: Column) -> Column:
        """One number a tree, in the order of the trees."""
        x = vector_to_array(features)
        feature, low, high = (numbers(v, "int") for v in (self.feature, self.low, self.high))
        threshold, value = numbers(self.threshold, "double"), numbers(self.value, "double")

        def step(node, _):
            below = F.get(x, F.get(feature, node)) <= F.get(threshold, node)
            return F.when(F.get(feature, node) < 0, node).when(below, F.get(low, node)).otherwise(F.get(high, node))

        levels = F.sequence(F.lit(1), F.lit(self.depth)) if self.depth else F.array().cast("array<int>")
        return F.transform(numbers(self.roots, "int"), lambda root: F.get(value, F.aggregate(levels, root, step)))

    def weighted_median(self, features: Column, weights: Sequence[float]) -> Column:
        """The smallest prediction at which the weights of the predictions up to it reach half of all."""
        votes = F.array_sort(
            F.zip_with(self.predictions(features), numbers([float(w) for w in weights], "double"), lambda p, w: F.struct(p.alias("p"), w.alias("w")))
        )
        half = 0.5 * sum(weights)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("median"))

        def step(acc, vote):
            total = acc["sum"] + vote["w"]
            reached = F.coalesce(acc["median"], F.when(total >= half - 1e-12, vote["p"]))
            return F.struct(total.alias("sum"), reached.alias("median"))

        return F.aggregate(votes, start, step)["median"]
