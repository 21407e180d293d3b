import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwater.functions import geo
from fieldwater.operators import compare, cropstats, grid, nearest, polygons, regrid
from fieldwater.operators.grid import GridSpec

CELL = "row int, col int, value double"
RING = "array<struct<x: double, y: double>>"


def values(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


# ---------------------------------------------------------------- geometry


def test_albers_worked_examples(spark):
    clarke = geo.Albers(29.5, 45.5, 23, -96, 6378206.4, 0.00676866)
    x, y = clarke.forward(F.lit(-75.0), F.lit(35.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((1885472.73, 1535925.00), abs=0.01)
    x, y = geo.Albers().forward(F.lit(-91.0), F.lit(34.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((458257.789, 1227034.460), abs=0.001)


def test_albers_round_trip(spark):
    p = spark.range(400).select((F.col("id") % 20 * 2.5 - 120).alias("lon"), (F.floor(F.col("id") / 20) * 1.3 + 24).alias("lat"))
    x, y = geo.reproject(F.col("lon"), F.col("lat"), "lonlat", "albers")
    q = p.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.reproject(F.col("x"), F.col("y"), "albers", "lonlat")
    x2, y2 = geo.reproject(lon, lat, "lonlat", "albers")
    assert q.select(F.max(F.greatest(F.abs(x2 - F.col("x")), F.abs(y2 - F.col("y"))))).first()[0] < 1e-6


def test_centroid(spark):
    df = spark.createDataFrame([(ring((0, 0), (4, 0), (4, 2), (0, 2)),), (ring((0, 0), (4, 0), (4, 2), (0, 2), (0, 0)),)], f"ring {RING}")
    cx, cy = geo.centroid(F.col("ring"))
    assert [tuple(r) for r in df.select(cx, cy).collect()] == [(2.0, 1.0)] * 2


# ---------------------------------------------------------------- sampling and blocks


def test_point_sample_edges(spark):
    spec = GridSpec(0, 10, 1, 1, 10, 10)
    cells = spark.createDataFrame([(0, 0, 5.0), (9, 9, 6.0)], CELL)
    points = spark.createDataFrame([(0.0, 10.0), (9.99, 0.01), (10.0, 5.0), (-0.1, 5.0), (5.0, 5.0)], "x double, y double")
    made = {(r.x, r.y): r.value for r in grid.sample_points(points, cells, spec, "x", "y").collect()}
    assert made == {(0.0, 10.0): 5.0, (9.99, 0.01): 6.0, (10.0, 5.0): None, (-0.1, 5.0): None, (5.0, 5.0): None}


@pytest.mark.parametrize("kind, want", [("sum", 5), ("average", 5 / 3), ("mode", 2), ("min", 1), ("max", 2), ("med", 2), ("q1", 1.5), ("q3", 2)])
def test_block_kinds(spark, kind, want):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, None)], CELL)
    assert values(grid.block_reduce(cells, 2, kind)) == {(0, 0): pytest.approx(want)}
    fine = GridSpec(0, 2, 1, 1, 2, 2)
    assert values(regrid.regrid(cells, fine, fine.coarser(2), kind)) == {(0, 0): pytest.approx(want)}


def test_mode_tie_takes_the_smallest(spark):
    cells = spark.createDataFrame([(0, 0, 9.0), (0, 1, 3.0), (1, 0, 9.0), (1, 1, 3.0)], CELL)
    assert values(grid.block_reduce(cells, 2, "mode")) == {(0, 0): 3.0}


def test_coarse_sum_threshold(spark):
    cells = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.25), (10, 0, 0.51)], CELL)
    assert values(grid.coarse_sum(cells)) == {(0, 0): None, (1, 0): 0.51}


def test_coarse_sum_keeps_the_total(spark):
    cells = spark.createDataFrame([(r, c, float(r * c + 1)) for r in range(20) for c in range(20)], CELL)
    total = cells.agg(F.sum("value")).first()[0]
    assert grid.coarse_sum(cells).agg(F.sum("value")).first()[0] == pytest.approx(total)


@pytest.mark.parametrize("kind", list(regrid.INTERPOLATING))
def test_interpolation_keeps_a_plane(spark, kind):
    spec = GridSpec(0, 12, 1, 1, 12, 12)
    flat = spark.createDataFrame([(r, c, 4.0) for r in range(12) for c in range(12)], CELL)
    target = GridSpec(0.3, 11.9, 0.7, 0.7, 10, 10)
    assert set(np.round(list(values(regrid.regrid(flat, spec, target, kind)).values()), 9)) == {4.0}


def test_unknown_resampling_kind(spark):
    spec = GridSpec(0, 1, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        regrid.regrid(spark.createDataFrame([], CELL), spec, spec, "guess")


# ---------------------------------------------------------------- focal


def test_focal_fill_from_a_corner(spark):
    spec = GridSpec(0, 3, 1, 1, 3, 3)
    filled = values(grid.focal_fill(spark.createDataFrame([(0, 0, 7.0)], CELL), spec))
    assert filled[(1, 1)] == 7.0 and filled[(2, 2)] == 7.0 and len(filled) == 9


@pytest.mark.parametrize("categorical", [False, True])
def test_focal_fill_against_growing_windows(spark, categorical):
    rng = np.random.default_rng(5)
    h, w = 17, 23
    a = np.where(rng.random((h, w)) < 0.04, rng.integers(1, 4, (h, w)).astype(float), np.nan)
    want = a.copy()
    for r in range(h):
        for c in range(w):
            size = 0
            while np.isnan(want[r, c]):
                size += 1
                box = a[max(0, r - size) : r + size + 1, max(0, c - size) : c + size + 1]
                box = box[~np.isnan(box)]
                if box.size:
                    v, n = np.unique(box, return_counts=True)
                    want[r, c] = v[n.argmax()] if categorical else box.mean()
    cells = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(h) for c in range(w) if not np.isnan(a[r, c])], CELL)
    made = values(grid.focal_fill(cells, GridSpec(0, h, 1, 1, h, w), categorical))
    assert all(made[(r, c)] == pytest.approx(want[r, c]) for r in range(h) for c in range(w))


def test_focal_fill_of_an_empty_grid(spark):
    made = values(grid.focal_fill(spark.createDataFrame([], CELL), GridSpec(0, 2, 1, 1, 2, 2)))
    assert set(made.values()) == {None}


# ---------------------------------------------------------------- land cover, polygons


def test_land_cover_rules(spark):
    rows = [(111, None, 1, None), (1, 1, 1, None), (5, None, 0, None), (3, None, 0, None), (5, None, 0, 1), (83, None, 0, None)]
    df = spark.createDataFrame(rows, "cover int, water int, mask int, field int")
    made = df.select(grid.correct_land_cover(F.col("cover"), F.col("water"), F.col("mask"), F.col("field")).alias("v"))
    assert [r.v for r in made.collect()] == [92, 0, 0, 3, 5, 92]


SPEC = GridSpec(0, 10, 1, 1, 10, 10)


def test_burn_unit_square(spark):
    df = spark.createDataFrame([(1, ring((4, 4), (5, 4), (5, 5), (4, 5)), 2.0)], f"id int, ring {RING}, w double")
    assert values(polygons.burn(df, SPEC, "id", "w")) == {(5, 4): 2.0}


def test_burn_sums_overlaps(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    df = spark.createDataFrame([(1, square, 2.0), (2, square, 3.0)], f"id int, ring {RING}, w double")
    assert set(values(polygons.burn(df, SPEC, "id", "w")).values()) == {5.0}


def test_sliver_touches_cells_without_centres(spark):
    df = spark.createDataFrame([(1, ring((1.1, 8.05), (6.9, 8.05), (6.9, 8.1)))], f"id int, ring {RING}")
    assert polygons.covered_cells(df, SPEC, ["id"]).isEmpty()
    assert set(values(polygons.burn(df, SPEC, "id"))) == {(1, c) for c in range(1, 7)}


def _inside(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_cells_of_random_polygons(spark):
    rng = np.random.default_rng(2)
    shapes = [[(float(x), float(y)) for x, y in rng.random((7, 2)) * 12 - 1] for _ in range(12)]
    df = spark.createDataFrame([(i, ring(*s)) for i, s in enumerate(shapes)], f"id int, ring {RING}")
    made = {(r.id, r["row"], r["col"]) for r in polygons.covered_cells(df, SPEC, ["id"]).collect()}
    want = {
        (i, r, c) for i, s in enumerate(shapes) for r in range(10) for c in range(10) if _inside(s, c + 0.5, 10 - r - 0.5)
    }
    assert made == want
    touched = {(r.id, r["row"], r["col"]) for r in polygons.covered_cells(df, SPEC, ["id"], all_touched=True).collect()}
    assert want <= touched
    for i, s in enumerate(shapes):
        for t in np.linspace(0, 1, 60):
            for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1]):
                x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
                r, c = int(np.floor(10 - y)), int(np.floor(x))
                if 0 <= r < 10 and 0 <= c < 10:
                    assert (i, r, c) in touched


def test_clip_and_box_agree(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(10) for c in range(10)], CELL)
    box = spark.createDataFrame([(1, ring((2.2, 3.3), (7.7, 3.3), (7.7, 8.8), (2.2, 8.8)))], f"id int, ring {RING}")
    a = set(values(polygons.clip(cells, box, SPEC, "id")))
    b = set(values(polygons.clip_box(cells, SPEC, 2.2, 3.3, 7.7, 8.8)))
    assert a == b and a


# ---------------------------------------------------------------- nearest


def test_equally_near_takes_the_lower_id(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p int, x double, y double")
    fields = spark.createDataFrame([(9, 1.0, 0.0), (4, -1.0, 0.0)], "f int, x double, y double")
    assert nearest.nearest(points, fields, "f").first().f == 4


def test_nearest_equals_brute_force_with_a_crowd(spark):
    """A third of the fields crowd one spot, many are copies, and the crowd forces a deep tree."""
    rng = np.random.default_rng(1)
    fx = np.r_[rng.random(400) * 100, 50 + rng.random(150) * 1e-4, np.full(50, 20.0)]
    fy = np.r_[rng.random(400) * 100, 50 + rng.random(150) * 1e-4, np.full(50, 20.0)]
    fyear = rng.integers(2014, 2016, len(fx))
    px, py, pyear = np.r_[rng.random(200) * 140 - 20, np.full(60, 50.0)], np.r_[rng.random(200) * 140 - 20, np.full(60, 50.0)], rng.integers(2014, 2017, 260)
    fields = spark.createDataFrame([(int(y), i, float(a), float(b)) for i, (y, a, b) in enumerate(zip(fyear, fx, fy))], "Year int, f int, x double, y double")
    points = spark.createDataFrame([(int(y), i, float(a), float(b)) for i, (y, a, b) in enumerate(zip(pyear, px, py))], "Year int, p int, x double, y double")
    made = {r.p: r.f for r in nearest.nearest(points, fields, "f", within=["Year"]).collect()}
    assert len(made) == 260
    for i in range(260):
        mine = fyear == pyear[i]
        if not mine.any():
            assert made[i] is None
            continue
        d = np.where(mine, (fx - px[i]) ** 2 + (fy - py[i]) ** 2, np.inf)
        assert made[i] == int(np.flatnonzero(d == d.min())[0])


def test_link_passes_unknown_rows_through(spark):
    rows = spark.createDataFrame(
        [(1, 2014, None, "RT", 1.0, 1.0), (2, 2014, "MS", "RT", 1.0, 1.0), (3, 2014, None, "VMP", 9.0, 9.0)],
        "id int, Year int, State string, Data string, x double, y double",
    )
    fields = spark.createDataFrame([("P1", 2014, 0.0, 0.0), ("P2", 2014, 10.0, 10.0)], "PermitNumb string, Year int, x double, y double")
    made = {r.id: (r.PermitNumb, r.x, r.y) for r in nearest.link_to_fields(rows, fields).collect()}
    assert made == {1: (None, 1.0, 1.0), 2: ("P1", 0.0, 0.0), 3: ("P2", 10.0, 10.0)}


# ---------------------------------------------------------------- comparison and statistics


def test_season_counts_each_month_once(spark):
    rows = [(y, m, 0, 0, 1.0) for y in (2014, 2015) for m in range(4, 10)] + [(2014, m, 0, 1, None if m == 5 else 1.0) for m in range(4, 10)]
    newer = spark.createDataFrame(rows, "year int, month int, row int, col int, value double")
    older = newer.withColumn("value", F.lit(2.0))
    made = {(r.year, r.col): (r.older, r.newer, r.difference) for r in compare.season_totals(compare.match_models(older, newer)).collect()}
    assert made == {(2014, 0): (12.0, 6.0, -6.0), (2015, 0): (12.0, 6.0, -6.0), (2014, 1): (None, None, None)}


def test_mean_month_comparison_skips_october(spark):
    totals = spark.createDataFrame([(2014, 4, 10.0, 8.0), (2015, 4, 20.0, 16.0), (2014, 10, 1.0, 1.0), (2014, 5, 0.0, 3.0)], "year int, month int, older double, newer double")
    made = {r.month: (r.older, r.newer, r.difference, r.difference_percent) for r in compare.mean_month_comparison(totals).collect()}
    assert made == {4: (15.0, 12.0, 3.0, 20.0), 5: (0.0, 3.0, -3.0, None)}


def test_region_shares(spark):
    zoned = spark.createDataFrame([("n", 2014, "Rice")] * 3 + [("n", 2014, "Corn")] + [("n", 2014, "Other")] * 4, "region string, year int, crop string")
    row = cropstats.region_shares(zoned).first()
    assert (row["Rice"], row["Corn"], row["Cotton"], row["Total"]) == (75.0, 25.0, None, 4)


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(0).normal(size=200)], "g string, v double")
    made = cropstats.kernel_density(df, ["g"], "v", -6, 6, 241)
    assert made.agg(F.sum("density") * 12 / 240).first()[0] == pytest.approx(1, abs=1e-3)
