"""The tree of pivots behind the nearest rows: exact, and as much work for a query whatever the table's size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwater.operators import features, neighbours
from fieldwater.operators.neighbours import NeighboursRegressor


def frame(spark, xs, ys):
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    names = [f"x{k}" for k in range(xs.shape[1])]
    return features.assemble(spark.createDataFrame(rows, f"i int, {', '.join(f'{n} double' for n in names)}, label double"), names)


def brute(train, y, queries, k, p):
    made = []
    for q in queries:
        d = (np.abs(train - q) ** p).sum(axis=1) ** (1 / p)
        made.append(y[np.lexsort((y, d))[:k]].mean())
    return np.array(made)


def crowds(rng, n, far):
    """Even rows, a dense spot, copies, and rows far off."""
    dense = np.full((n // 3, 2), 0.5) + rng.random((n // 3, 2)) * 1e-6
    xs = np.r_[rng.random((n // 3, 2)), dense, np.repeat(rng.random((1, 2)), n // 4, axis=0), rng.random((20, 2)) * far]
    return xs, rng.random(len(xs))


@pytest.mark.parametrize(("p", "leaf", "pivots"), [(2.0, 25, 4), (1.0, 60, 16), (3.0, 5, 3)])
def test_a_deep_tree_is_exact(spark, monkeypatch, p, leaf, pivots):
    monkeypatch.setattr(neighbours, "PIVOTS", pivots)
    rng = np.random.default_rng(3)
    train, y = crowds(rng, 900, 1000.0)
    queries = np.r_[rng.random((40, 2)), train[:5], rng.random((5, 2)) * 3000]
    model = NeighboursRegressor(k=7, p=p).fit(frame(spark, train, y))
    made = {r.i: r.prediction for r in model._transform(frame(spark, queries, np.zeros(len(queries))), 50, leaf).collect()}
    assert [made[i] for i in range(len(queries))] == pytest.approx(brute(train, y, queries, 7, p))
    leaves, levels = model._tree(leaf)
    assert len(levels) > 1 and leaves.count() == len(np.unique(train, axis=0))


def compared(model, queries, leaf):
    """Places that a query is compared with, on average: those of the leaves it asks, and the pivots on its way."""
    leaves, levels = model._tree(leaf)
    sizes = leaves.groupBy("_cell").agg(F.count("*").alias("n"))
    asked = model._asked(queries, levels)
    return asked.join(sizes, "_cell").agg(F.sum("n")).first()[0] / queries.count(), len(levels)


def test_work_for_a_query_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIVOTS", 16)
    rng = np.random.default_rng(5)
    points = [(f"{k}".encode(), [float(v) for v in x]) for k, x in enumerate(rng.random((60, 2)))]
    queries = spark.createDataFrame(points, "_id binary, _x array<double>")
    found = {}
    for n in (3_000, 30_000):
        train = rng.random((n, 2))
        found[n] = compared(NeighboursRegressor(k=5).fit(frame(spark, train, train[:, 0])), queries, 200)
    # Ten times the rows add a level; leaves that a query asks are somewhat more, not ten times as many.
    assert found[30_000][0] < 2.5 * found[3_000][0] and found[30_000][1] > found[3_000][1]


def test_few_rows_and_none(spark):
    train = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]])
    model = NeighboursRegressor(k=5).fit(frame(spark, train, np.array([1.0, 2.0, 6.0])))
    assert [r.prediction for r in model.transform(frame(spark, train[:1], np.zeros(1))).collect()] == [3.0]
    none = NeighboursRegressor(k=5).fit(frame(spark, train, np.zeros(3)).where("i < 0"))
    assert [r.prediction for r in none.transform(frame(spark, train[:1], np.zeros(1))).collect()] == [None]
