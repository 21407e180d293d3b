"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers floor(scale * x), so a dimension takes few values. In
every round a task tabulates, for each dimension, each integer value that
occurs among the rows in hand and each centroid, the squared difference; the
distance of a row to a centroid is then the sum of its gathered table entries.
Tables cover a bounded batch of rows, so they stay small even when every value
occurs once. Sums are exact integers, so results don't depend on how rows are
dealt to tasks.

A round is one pass over the stored integer vectors. Tasks return one row per centroid
and task (count and component sums), which are added up before the k new
centroids, a table of k x dimensions, come to the driver. No row is shuffled.

Defined cases: vectors that are NULL, of another length, or with a NULL, NaN or
infinite component are left out; components beyond 2^27 in size count as
+-2^27, so that a squared distance fits a long; repeated rows each count;
a missing id hashes as an empty one; with fewer vectors than centroids there
are as many centroids as vectors; equal hashes start in the order of their
components; an empty table gives no rows; an inertia that doesn't fit a long is NULL.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches, stored

CENTROIDS = 40
DIMENSIONS = 64
ROUNDS = 5
SCALE = 256
SALT = 2
LARGEST = 2**27
# Rows whose values one set of tables covers.
TABLE_ROWS = 4096

PARTIAL = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


@dataclass(frozen=True)
class Centroids:
    """The final centroids, one row each."""

    values: np.ndarray

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.values.tolist()]


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), kept within the largest size."""
    wide = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST))))
    return F.transform(vector, lambda x: wide(x).cast("int"))


def integer_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the usable vectors."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return given.filter((F.size("v") == dimensions) & F.forall("v", usable)).select("vec_id", integers(F.col("v"), scale).alias("v"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, salt: int = SALT) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes, in ascending order of the hash."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    picked = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r["v"] for r in picked], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, gathered from one table a dimension."""
    made = np.zeros((len(v), len(centroids)), np.int64)
    for d in range(v.shape[1]):
        values, at = np.unique(v[:, d], return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        made += table[at]
    return made


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for k in range(0, len(v), TABLE_ROWS):
        part = slice(k, k + TABLE_ROWS)
        away = distances(v[part], centroids)
        best = away.argmin(axis=1)  # the first of equals
        yield part, best, away[np.arange(len(best)), best]


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dimensions = centroids.shape
    n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
    for batch in batches:
        v = _vectors(batch.column(0), dimensions)
        for part, best, _ in _nearest(v, centroids):
            n += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            where = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) > 0])) if len(best) else order
            sums[best[order][where]] += np.add.reduceat(v[part][order], where, axis=0) if len(where) else 0
    has = np.flatnonzero(n)
    columns = [pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(sums[has].tolist(), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = _vectors(batch.column(1), centroids.shape[1])
        for part, best, away in _nearest(v, centroids):
            columns = [batch.column(0).slice(part.start, len(best)), pa.array(best.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of each component's mean; a centroid without vectors stays."""
    found = vectors.select("v").mapInArrow(partial(_sums, centroids=centroids), PARTIAL)
    # Sums of longs are added as decimals, so no table is too large for them.
    totals = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(centroids.shape[1])]
    new = centroids.copy()
    for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        new[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(centroids.shape[1])]
    return new


def cluster(
    rows: DataFrame,
    count: int = CENTROIDS,
    dimensions: int = DIMENSIONS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    salt: int = SALT,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids."""
    bounded_batches(rows.sparkSession)
    vectors = stored(integer_vectors(rows, dimensions, scale, vec_id, vector), "vectors")
    centroids = first_centroids(vectors, count, salt).reshape(-1, dimensions)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], ASSIGNED), Centroids(centroids)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = vectors.select("vec_id", "v").mapInArrow(partial(_assigned, centroids=centroids), ASSIGNED)
    return stored(assigned, "assigned"), Centroids(centroids)


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """Each vector with the distances summed over its cluster and over all, and its centroid's digest."""
    # One row per cluster: no more than there are centroids.
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in own.collect()}
    fits = lambda x: x if x < 2**63 else None
    facts = [(c, fits(s), fits(sum(sums.values())), centroids.digests()[c]) for c, s in sums.items()]
    table = assigned.sparkSession.createDataFrame(facts, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), F.col("cluster") == F.col("_c")).drop("_c")
