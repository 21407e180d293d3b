"""Polygons with holes and parts, and regridding by area."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldwater.functions import geo
from fieldwater.operators import polygons, regrid
from fieldwater.operators.grid import GridSpec
from fieldwater.sources.tables import read_rings

CELL = "row int, col int, value double"
RING = "array<struct<x: double, y: double>>"
SPEC = GridSpec(left=-10, top=10, xres=0.5, yres=0.5, height=40, width=40)


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def star(draw, x, y, low, high, corners=9):
    """A star-shaped ring around a point, in either direction."""
    made = []
    for k in range(corners):
        angle, far = 2 * math.pi * k / corners, draw.uniform(low, high)
        made.append((x + far * math.cos(angle), y + far * math.sin(angle)))
    return made if draw.random() < 0.5 else made[::-1]


def holds(points, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            inside = not inside
    return inside


def shapes(seed=1, count=12):
    """Parts, each an outer ring and holes strictly inside it."""
    draw = random.Random(seed)
    made = []
    for k in range(count):
        parts = []
        for cx in draw.sample([-7, 0, 7], draw.randrange(1, 4)):
            y = draw.uniform(-6, 6)
            outer, holes = star(draw, cx, y, 2.0, 3.2), [star(draw, cx, y, 0.4, 1.2)] if draw.random() < 0.7 else []
            parts.append([outer, *holes])
        made.append((k, draw.uniform(1, 9), parts))
    return made


def frame(spark, made):
    rows = [(k, v, [[ring(p) for p in part] for part in parts]) for k, v, parts in made]
    return spark.createDataFrame(rows, f"id int, v double, parts array<array<{RING}>>")


def inside(parts, x, y):
    return any(holds(part[0], x, y) and not any(holds(h, x, y) for h in part[1:]) for part in parts)


def test_burn_leaves_holes_and_fills_all_parts(spark):
    made = shapes()
    table = frame(spark, made).withColumn("ring", geo.oriented(F.col("parts")))
    want = defaultdict(float)
    for _, v, parts in made:
        for row in range(40):
            for col in range(40):
                if inside(parts, -10 + (col + 0.5) * 0.5, 10 - (row + 0.5) * 0.5):
                    want[row, col] += v
    got = {(r.row, r.col): r.value for r in polygons.burn(table, SPEC, "id", "v").collect()}
    assert got == pytest.approx(dict(want)) and len(want) > 200


def test_centroid_and_area_of_parts(spark):
    made = shapes(2)
    table = frame(spark, made).withColumn("ring", geo.oriented(F.col("parts")))
    x, y = geo.centroid_of(F.col("ring"))

    def moments(points):
        a = cx = cy = 0.0
        for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
            c = x1 * y2 - x2 * y1
            a, cx, cy = a + c / 2, cx + (x1 + x2) * c / 6, cy + (y1 + y2) * c / 6
        return (a, cx, cy) if a > 0 else (-a, -cx, -cy)

    for r in table.select("id", x.alias("x"), y.alias("y"), geo.area_of(F.col("ring")).alias("a")).collect():
        a = cx = cy = 0.0
        for part in made[r.id][2]:
            for k, points in enumerate(part):
                m, sign = moments(points), 1 if k == 0 else -1
                a, cx, cy = a + sign * m[0], cx + sign * m[1], cy + sign * m[2]
        assert (r.x, r.y, r.a) == pytest.approx((cx / a, cy / a, a))


def test_rings_turning_the_other_way_have_the_same_centroid(spark):
    table = frame(spark, shapes(3)).withColumn("ring", geo.oriented(F.col("parts")))
    back = F.transform("ring", lambda one: F.reverse(one))
    a, b = geo.centroid_of(F.col("ring")), geo.centroid_of(back)
    for r in table.select(*[c.alias(n) for c, n in zip([*a, *b], "abcd")]).collect():
        assert (r.a, r.b) == pytest.approx((r.c, r.d))


def test_touched_cells_follow_the_edges_of_holes(spark):
    outer, hole = [(-9, -9), (9, -9), (9, 9), (-9, 9)], [(-5, -5), (5, -5), (5, 5), (-5, 5)]
    table = frame(spark, [(1, 1.0, [[outer, hole]])]).withColumn("ring", geo.oriented(F.col("parts")))
    got = {(r.row, r.col) for r in polygons.burn(table, SPEC, "id").collect()}
    assert (20, 20) not in got and (20, 5) in got
    # The left and upper border of the hole lie on the borders of cells that they touch.
    assert (20, 10) in got and (20, 11) not in got and (20, 30) in got


def test_one_ring_or_many_read_alike(spark, tmp_path):
    made = [(k, v, [part[:1] for part in parts[:1]]) for k, v, parts in shapes(4)]
    table = frame(spark, made)
    table.write.parquet(f"{tmp_path}/parts")
    table.select("id", "v", F.col("parts")[0][0].alias("ring")).write.parquet(f"{tmp_path}/ring")
    cells = [sorted(tuple(r) for r in polygons.burn(read_rings(spark, f"{tmp_path}/{n}"), SPEC, "id", "v").collect()) for n in ("parts", "ring")]
    assert [r[:2] for r in cells[0]] == [r[:2] for r in cells[1]] and len(cells[0]) > 50
    spark.createDataFrame([(1, "x")], "id int, ring string").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        read_rings(spark, f"{tmp_path}/bad")


def test_empty_and_missing_rings(spark):
    table = spark.createDataFrame([(1, 1.0, None), (2, 1.0, []), (3, 1.0, [[]]), (4, 1.0, [ring([(0, 0)])])], f"id int, v double, ring array<{RING}>")
    assert polygons.burn(table, SPEC, "id", "v").count() == 0
    x, y = geo.centroid_of(F.col("ring"))
    assert all(r.x is None for r in table.select(x.alias("x"), y.alias("y")).collect())


# ---------------------------------------------------------------- regridding by area


def clipped(points, left, right, low, high):
    """A convex polygon cut to a box, side by side."""
    for axis, bound, keep in ((0, left, 1), (0, right, -1), (1, low, 1), (1, high, -1)):
        out = []
        for p, q in zip(points, [*points[1:], *points[:1]]):
            a, b = (p[axis] - bound) * keep, (q[axis] - bound) * keep
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                out.append(tuple(p[k] + a / (a - b) * (q[k] - p[k]) for k in (0, 1)))
        points = out
    return points


def area(points):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, [*points[1:], *points[:1]]))) / 2


@pytest.mark.parametrize("offset", [0.0, 0.35])
def test_totals_are_kept(spark, offset):
    source = GridSpec(left=0, top=30, xres=1, yres=1, height=30, width=30)
    target = GridSpec(left=-offset, top=30 + offset, xres=10 / 3, yres=2.7, height=13, width=11)
    cells = spark.range(900).select(F.floor(F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.sqrt("id").alias("value"))
    made = regrid.regrid(cells, source, target, "sum", by="area")
    assert made.agg(F.sum("value")).first()[0] == pytest.approx(cells.agg(F.sum("value")).first()[0])
    flat = regrid.regrid(cells.withColumn("value", F.lit(7.0)), source, target, "average", by="area")
    assert all(r.value == pytest.approx(7.0) for r in flat.collect())


def test_nesting_grids_agree_with_centres(spark):
    source, target = GridSpec(0, 12, 1, 1, 12, 12), GridSpec(0, 12, 3, 3, 4, 4)
    cells = spark.range(144).select(
        F.floor(F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"), (F.col("id") * 7 % 5).cast("double").alias("value")
    )
    for kind in ("sum", "average", "mode", "min", "max"):
        a, b = ({(r.row, r.col): r.value for r in regrid.regrid(cells, source, target, kind, by=by).collect()} for by in ("centre", "area"))
        assert a == pytest.approx(b)


def test_missing_cells_have_no_weight(spark):
    source, target = GridSpec(0, 2, 1, 1, 2, 2), GridSpec(0, 2, 2, 2, 1, 1)
    cells = spark.createDataFrame([(0, 0, 4.0), (0, 1, None), (1, 0, 8.0)], CELL)
    assert regrid.regrid(cells, source, target, "average", by="area").first().value == 6.0
    assert regrid.regrid(cells.where("false"), source, target, "mode", by="area").count() == 0
    with pytest.raises(ValueError):
        regrid.regrid(cells, source, target, "mode", by="corner")


def test_quadrilaterals_between_systems(spark):
    source = GridSpec(left=-91.0, top=34.2, xres=0.05, yres=0.05, height=12, width=12, crs="lonlat")
    albers = geo.Albers()
    corners = [(-91.0 + c * 0.05, 34.2 - r * 0.05) for r in range(13) for c in range(13)]
    x, y = albers.forward(F.col("lon"), F.col("lat"))
    plane = {(p.lon, p.lat): (p.x, p.y) for p in spark.createDataFrame(corners, "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y")).collect()}
    xs, ys = [p[0] for p in plane.values()], [p[1] for p in plane.values()]
    target = GridSpec(left=min(xs) - 900, top=max(ys) + 700, xres=6100.0, yres=7300.0, height=12, width=13, crs="albers")
    values = {(r, c): float(1 + (r * 31 + c * 17) % 11) for r in range(12) for c in range(12)}
    cells = spark.createDataFrame([(*k, v) for k, v in values.items()], CELL)
    want = defaultdict(float)
    for (r, c), v in values.items():
        quad = [plane[corners[(r + dr) * 13 + c + dc]] for dr, dc in ((0, 0), (0, 1), (1, 1), (1, 0))]
        for row in range(target.height):
            for col in range(target.width):
                left, top = target.left + col * target.xres, target.top - row * target.yres
                share = area(clipped(quad, left, left + target.xres, top - target.yres, top)) / area(quad)
                if share > 1e-9:
                    want[row, col] += share * v
    got = {(r.row, r.col): r.value for r in regrid.regrid(cells, source, target, "sum", by="area").collect()}
    assert got == pytest.approx(dict(want), rel=1e-6)
    assert sum(got.values()) == pytest.approx(sum(values.values()))
