import hashlib
import math
import random

import numpy as np
import pytest

from fieldwater.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, n string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y", "z", 7) for i, v in rows], SCHEMA)


def usable(v, dimensions):
    return v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, count, dimensions, rounds):
    """Plain loops over Python integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if usable(v, dimensions)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for k, m in members.items():
            centers[k] = [sum(x) // len(m) for x in zip(*m)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    own = {k: sum(d for _, c, d in found if c == k) for k in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("count", [1, 6, 400])
def test_against_brute_force(spark, monkeypatch, count):
    monkeypatch.setattr(C, "TABLE_ROWS", 64)
    draw = random.Random(count)
    rows = [(k, [draw.choice([-0.7, 0.1, 0.5]) + draw.gauss(0, 0.2) for _ in range(4)]) for k in range(300)]
    rows += [(3, rows[3][1]), (3, [0.0] * 4), (None, [0.1] * 4), (900, None), (901, []), (902, [0.1] * 3), (903, [0.1] * 5), (904, [0.1, None, 0.1, 0.1])]
    rows += [(905, [float("nan"), 0.0, 0.0, 0.0]), (906, [float("inf"), 0.0, 0.0, 0.0]), (907, [5000.0, -5000.0, 1e-9, -1e-9])]
    rows += [(1000 + k, [0.25, -0.5, 0.0, 1.0]) for k in range(200)]
    found, centers = C.cluster(frame(spark, rows), count, 4)
    assert rows_of(C.with_inertia(found, centers)) == brute(rows, count, 4, C.ROUNDS)


def test_ties_go_to_the_smaller_number():
    assert C.distances(np.array([[1, 1]]), np.array([[0, 1], [2, 1], [1, 1]])).tolist() == [[1, 1, 0]]
    _, best, away = next(iter(C._nearest(np.array([[1, 1]]), np.array([[0, 1], [2, 1]]))))
    assert best.tolist() == [0] and away.tolist() == [1]


def test_distances_equal_plain_ones():
    draw = np.random.default_rng(1)
    v, c = draw.integers(-(2**27), 2**27, (500, 8)), draw.integers(-(2**27), 2**27, (9, 8))
    assert (C.distances(v, c) == ((v[:, None] - c[None]) ** 2).sum(axis=2)).all()


def test_huge_components_stay_in_range(spark):
    rows = [(k, [3e38, -3e38]) for k in range(3)] + [(9, [0.0, 0.0])]
    found, centers = C.cluster(frame(spark, rows), 1, 2)
    got = {r.vec_id: r.distance for r in C.with_inertia(found, centers).collect()}
    assert set(got) == {0, 1, 2, 9} and got[9] > got[0] == got[1] >= 0


def test_empty(spark):
    for rows in ([], [(1, None), (2, [0.0])]):
        assert C.with_inertia(*C.cluster(frame(spark, rows))).count() == 0
