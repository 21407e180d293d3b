"""Exact k-nearest-neighbour regression."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwater.session import cut_lineage

# Training rows, and queries, that one task holds at a time.
BLOCK_ROWS = 50_000
# Places a cell holds before it is split, the training points that split it (first by hash), and the levels a tree may have.
LEAF_PLACES = 4_000
PIVOTS = 64
DEEPEST = 7

PLACES = "_cell bigint, _t array<double>, _n bigint, _c bigint, _far double"
ASKED = "_id binary, _x array<double>, _cell bigint, _low double, _limit double"


class _NeighbourParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    p = Param(Params._dummy(), "p", "order of the Minkowski distance", TypeConverters.toFloat)


class NeighboursRegressor(Estimator, _NeighbourParams):
    """Keeps the training rows as a table; all work happens when predicting."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 k=5, weights="uniform", p=2.0):
        super().__init__()
        self._setDefault(k=5, weights="uniform", p=2.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NeighboursModel:
        # Copies of a training row are kept once, with their number.
        rows = (
            df.select(
                vector_to_array(self.getFeaturesCol()).alias("_t"), F.col(self.getLabelCol()).cast("double").alias("_y")
            )
            .groupBy("_t", "_y")
            .agg(F.count(F.lit(1)).alias("_c"))
            .persist()
        )
        settings = {q.name: v for q, v in self.extractParamMap().items()}
        return NeighboursModel(rows, settings)


def _nearest_rows(k: int, p: float):
    """Task helper: for each query the k nearest distinct training rows, as (distance, target, copies).

    Built as a closure so that workers need no copy of this package.
    """

    def run(points, train, y, copies):
        import numpy as np

        # Sorted by target first, the stable sort below breaks ties by target.
        by_target = np.argsort(y, kind="stable")
        train, y, copies = train[by_target], y[by_target], copies[by_target]
        keep = min(k, len(train))
        step = max(1, 4_000_000 // max(1, train.size))
        for a in range(0, len(points), step):
            gaps = np.abs(points[a : a + step, None, :] - train[None, :, :])
            distance = (gaps**p).sum(axis=2) ** (1.0 / p)
            for row, picked in zip(distance, np.argsort(distance, axis=1, kind="stable")[:, :keep]):
                yield [{"d": float(row[j]), "y": float(y[j]), "c": int(copies[j])} for j in picked]

    return run


def _pair_of_blocks(find):
    """Task helper: one block of queries against one block of training rows."""

    def run(queries, block):
        import numpy as np
        import pandas as pd

        if not len(queries) or not len(block):
            return pd.DataFrame({"_id": pd.Series([], dtype=object), "_near": pd.Series([], dtype=object)})
        near = find(
            np.stack(queries["_x"].to_numpy()), np.stack(block["_t"].to_numpy()), block["_y"].to_numpy(), block["_c"].to_numpy()
        )
        return pd.DataFrame({"_id": queries["_id"].to_numpy(), "_near": list(near)})

    return run


def _limits(k: int, p: float):
    """Task helper: distances of queries to pivots, and a distance within which each query's k nearest rows lie for sure.

    The cells within reach of some distance hold k rows for sure; a cell farther
    off than that, less its radius, holds none of the k nearest (the triangle
    inequality).
    """

    def limits(points, pivots, radius, held):
        import numpy as np

        gaps = np.abs(points[:, None, :] - pivots[None, :, :])
        distance = (gaps**p).sum(axis=2) ** (1.0 / p)
        farthest = distance + radius
        order = farthest.argsort(axis=1)
        enough = (held[order].cumsum(axis=1) < k).sum(axis=1)
        sure = np.take_along_axis(farthest, order, axis=1)
        at = np.minimum(enough, sure.shape[1] - 1)
        return distance, np.where(enough < sure.shape[1], sure[np.arange(len(points)), at], np.inf)

    return limits


def _reach(pivots, radius, held, k: int, p: float):
    """Task helper: the cells, by number, that may hold one of the k nearest rows of each query."""
    limits = _limits(k, p)

    def run(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            if not len(rows):
                continue
            distance, limit = limits(np.stack(rows["_x"].to_numpy()), pivots, radius, held)
            query, cell = np.nonzero((distance - radius) * (1 - 1e-9) <= limit[:, None] * (1 + 1e-9))
            yield pd.DataFrame({"_id": rows["_id"].to_numpy()[query], "_x": rows["_x"].to_numpy()[query], "_cell": cell.astype("int32")})

    return run


def _split(p: float):
    """Task helper: places of one cell go to the nearest of its pivots, whose number makes the new cell's."""

    def run(places, pivots):
        import numpy as np
        import pandas as pd

        if not len(places) or not len(pivots):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("_cell", "_t", "_n", "_c", "_far")})
        points, centres = np.stack(places["_t"].to_numpy()), np.stack(pivots["_pivot"].to_numpy())
        cell, far = np.empty(len(points), np.int64), np.empty(len(points))
        step = max(1, 4_000_000 // centres.size)
        for k in range(0, len(points), step):
            gaps = np.abs(points[k : k + step, None, :] - centres[None, :, :])
            distance = (gaps**p).sum(axis=2) ** (1.0 / p)
            best = distance.argmin(axis=1)
            cell[k : k + step], far[k : k + step] = pivots["_child"].to_numpy()[best], distance[np.arange(len(best)), best]
        return pd.DataFrame({"_cell": cell, "_t": places["_t"].to_numpy(), "_n": places["_n"].to_numpy(), "_c": places["_c"].to_numpy(), "_far": far})

    return run


def _open(k: int, p: float):
    """Task helper: queries at one cell go on to those of its parts that may hold one of their k nearest rows."""
    limits = _limits(k, p)

    def run(queries, parts):
        import numpy as np
        import pandas as pd

        made = []
        if len(queries) and len(parts):
            points, pivots = np.stack(queries["_x"].to_numpy()), np.stack(parts["_pivot"].to_numpy())
            radius, held, child = (parts[c].to_numpy() for c in ("_radius", "_held", "_child"))
            step = max(1, 4_000_000 // pivots.size)
            for i in range(0, len(points), step):
                part = queries.iloc[i : i + step]
                distance, limit = limits(points[i : i + step], pivots, radius, held)
                limit = np.minimum(limit, part["_limit"].to_numpy())
                low = (distance - radius) * (1 - 1e-9)
                query, cell = np.nonzero(low <= limit[:, None] * (1 + 1e-9))
                columns = {"_id": part["_id"].to_numpy()[query], "_x": part["_x"].to_numpy()[query], "_cell": child[cell]}
                made.append(pd.DataFrame({**columns, "_low": low[query, cell], "_limit": limit[query]}))
        return pd.concat(made) if made else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("_id", "_x", "_cell", "_low", "_limit")})

    return run


def _fresh(rows: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that both sides of a cogroup may come from one table."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def _shares(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(key, name): among how many tasks the rows of each key are dealt."""
    return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


class NeighboursModel(Model, _NeighbourParams):
    """Mean, or inverse-distance mean, of the k nearest training targets.

    Training places (distinct feature vectors) lie in a tree of cells. A cell
    with more places than a leaf holds is split by a few dozen of its own
    places, drawn by hash: every place goes to the nearest of them. The number
    of levels grows with the logarithm of the places, and the tree is a table of
    (cell, part, pivot, radius, rows held), one for each level. Queries walk down by
    joins on the cell and go on only to parts that can hold one of their k
    nearest rows, by the triangle inequality of the Minkowski distance, so the
    rows a query is compared with don't grow with the table. Cells asked by many
    queries and crowded places are dealt into blocks of bounded size, and only k
    rows per query leave a block. Equal feature vectors are looked up once.
    """

    def __init__(self, rows: DataFrame, settings: dict):
        super().__init__()
        self.rows = rows
        self._setDefault(k=5, weights="uniform", p=2.0)
        self._set(**settings)
        if self.getOrDefault("p") < 1:
            raise ValueError("a Minkowski distance has an order of at least 1")

    def copy(self, extra=None):
        return NeighboursModel(self.rows, {**self._settings(), **{q.name: v for q, v in (extra or {}).items()}})

    def _settings(self) -> dict:
        return {q.name: v for q, v in self.extractParamMap().items()}

    def save_stage(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        told = self.rows.sparkSession.createDataFrame([(json.dumps(self._settings()),)], "settings string")
        told.write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load_stage(cls, spark: SparkSession, path: str) -> NeighboursModel:
        return cls(spark.read.parquet(f"{path}/rows"), json.loads(spark.read.parquet(f"{path}/settings").first()[0]))

    def _tree(self, leaf_places: int) -> tuple[DataFrame, list[DataFrame]]:
        """Leaves, as (cell, place, rows, copies) of every place, and the levels of the tree from the root down."""
        p = self.getOrDefault("p")
        start = [F.lit(1).cast("bigint").alias("_cell"), "_t", "_n", "_c", F.lit(1.0).alias("_far")]
        places = cut_lineage(self.rows.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_c")).select(*start))
        leaves, levels = None, []
        for _ in range(DEEPEST):
            # Cells of one place can't be split.
            crowded = places.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"), F.max("_far").alias("_radius"))
            crowded = cut_lineage(crowded.where((F.col("_size") > leaf_places) & (F.col("_radius") > 0)))
            done = places.join(crowded.select("_cell"), "_cell", "left_anti")
            leaves = done if leaves is None else leaves.unionByName(done)
            if crowded.isEmpty():
                return leaves, levels
            # By hash, a few times as many places of each cell as it needs pivots; their number is bounded whatever the cell's size.
            draw = F.xxhash64("_t")
            rate = F.least(F.lit(1.0), F.lit(4.0 * PIVOTS) / F.col("_size"))
            drawn = places.join(crowded, "_cell").where(F.pmod(draw, F.lit(2**30)) < rate * 2**30)
            chosen = drawn.groupBy("_cell").agg(F.slice(F.array_sort(F.collect_list(F.struct(draw.alias("h"), "_t"))), 1, PIVOTS).alias("_p"))
            pivots = cut_lineage(
                chosen.select("_cell", F.posexplode("_p").alias("_k", "_v")).select(
                    "_cell", (F.col("_cell") * PIVOTS + F.col("_k")).alias("_child"), F.col("_v._t").alias("_pivot")
                )
            )
            shares = crowded.select("_cell", F.ceil(F.col("_size") / BLOCK_ROWS).cast("int").alias("_s"))
            dealt = places.join(shares, "_cell").withColumn("_s", F.pmod(F.xxhash64("_t"), F.col("_s")).cast("int"))
            sent = pivots.join(shares, "_cell").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
            places = cut_lineage(dealt.groupBy("_cell", "_s").cogroup(_fresh(sent).groupBy("_cell", "_s")).applyInPandas(_split(p), PLACES))
            parts = places.groupBy(F.col("_cell").alias("_child")).agg(F.max("_far").alias("_radius"), F.sum("_c").alias("_held"))
            levels.append(cut_lineage(pivots.join(parts, "_child")))
        return leaves.unionByName(places), levels

    def _asked(self, queries: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """(id, query, leaf) for the leaves that may hold one of the k nearest rows of a query."""
        k, p = self.getOrDefault("k"), self.getOrDefault("p")
        start = [F.lit(1).cast("bigint").alias("_cell"), F.lit(0.0).alias("_low"), F.lit(float("inf")).alias("_limit")]
        asked = cut_lineage(queries.select("_id", "_x", *start))
        for level in levels:
            inner = level.select("_cell").distinct()
            shares = _shares(asked.join(inner, "_cell", "left_semi"), "_cell", BLOCK_ROWS, "_s")
            dealt = asked.join(shares, "_cell").withColumn("_s", F.pmod(F.xxhash64("_id"), F.col("_s")).cast("int"))
            sent = level.join(shares, "_cell").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
            opened = dealt.groupBy("_cell", "_s").cogroup(_fresh(sent).groupBy("_cell", "_s")).applyInPandas(_open(k, p), ASKED)
            found = opened.unionByName(asked.join(inner, "_cell", "left_anti"))
            # The least of the distances that are sure for a query rules out cells beyond it everywhere.
            tight = found.withColumn("_limit", F.min("_limit").over(W.partitionBy("_id")))
            asked = cut_lineage(tight.where(F.col("_low") <= F.col("_limit") * (1 + 1e-9)))
        return asked.select("_id", "_x", "_cell")

    def _candidates(self, queries: DataFrame, block_rows: int, leaf_places: int = LEAF_PLACES) -> DataFrame:
        k, p = self.getOrDefault("k"), self.getOrDefault("p")
        find, shape = _nearest_rows(k, p), "_id binary, _near array<struct<d: double, y: double, c: bigint>>"
        leaves, levels = self._tree(leaf_places)
        asked = self._asked(queries, levels)
        placed = leaves.select("_cell", F.col("_t").alias("_place")).join(self.rows, F.col("_place") == F.col("_t")).drop("_place")
        train = cut_lineage(placed.select("_cell", "_t", "_y", "_c"))
        of_rows, of_queries = _shares(train, "_cell", block_rows, "_rows"), _shares(asked, "_cell", block_rows, "_queries")
        # Every block of a leaf's queries meets every block of its rows.
        blocks = cut_lineage(of_rows.join(of_queries, "_cell"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sent = asked.join(blocks, "_cell").withColumn("_q", F.pmod(F.xxhash64("_id"), F.col("_queries")).cast("int")).withColumn("_b", every("_rows"))
        dealt = train.join(blocks, "_cell").withColumn("_b", F.pmod(F.xxhash64("_t", "_y"), F.col("_rows")).cast("int")).withColumn("_q", every("_queries"))
        keys = ["_cell", "_q", "_b"]
        return sent.select(*keys, "_id", "_x").groupBy(*keys).cogroup(_fresh(dealt.select(*keys, "_t", "_y", "_c")).groupBy(*keys)).applyInPandas(
            _pair_of_blocks(find), shape
        )

    def _transform(self, df: DataFrame, block_rows: int = BLOCK_ROWS, leaf_places: int = LEAF_PLACES) -> DataFrame:
        k = self.getOrDefault("k")
        vector = vector_to_array(self.getFeaturesCol())
        identity = F.unhex(F.sha2(F.to_json(F.struct(vector.alias("v"))), 256))
        queries = df.select(vector.alias("_x")).distinct().withColumn(
            "_id", F.unhex(F.sha2(F.to_json(F.struct(F.col("_x").alias("v"))), 256))
        )
        near = self._candidates(queries, block_rows, leaf_places)
        merged = near.groupBy("_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))

        def mean(weight):
            """Weighted mean over the first k rows, copies counted one by one."""
            start = F.struct(F.lit(k).cast("bigint").alias("left"), F.lit(0.0).alias("wy"), F.lit(0.0).alias("w"))

            def step(acc, n):
                taken = F.least(acc["left"], n["c"])
                share = weight(n) * taken
                return F.struct(
                    (acc["left"] - taken).alias("left"), (acc["wy"] + share * n["y"]).alias("wy"), (acc["w"] + share).alias("w")
                )

            total = F.aggregate("_near", start, step)
            return F.try_divide(total["wy"], total["w"])

        answer = mean(lambda n: F.lit(1.0))
        if self.getOrDefault("weights") == "distance":
            # A query that coincides with training rows takes their mean.
            exact = mean(lambda n: F.when(n["d"] == 0, 1.0).otherwise(0.0))
            answer = F.coalesce(exact, mean(lambda n: F.coalesce(F.try_divide(F.lit(1.0), n["d"]), F.lit(0.0))))
        answered = merged.select("_id", answer.alias(self.getPredictionCol()))
        return df.withColumn("_id", identity).join(answered, "_id", "left").drop("_id")
