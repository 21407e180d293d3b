"""Regridding between two axis-aligned grids with thirteen resampling kinds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.functions.geo import bounds, edges, reproject, signed_area
from fieldwater.functions.sizing import attach, measured
from fieldwater.operators.grid import BLOCK_REDUCERS, GridSpec, align_to_grid, most_frequent, to_target_cells
from fieldwater.operators.quantiles import quantiles

AGGREGATING = (*BLOCK_REDUCERS, "mode")
# Half width of each interpolation kernel, in source cells.
INTERPOLATING = {"bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}
QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}
KINDS = ("near", *INTERPOLATING, *AGGREGATING)


def _kernel(kind: str, distance: Column) -> Column:
    """Weight of a source cell ``distance`` cells away from the target centre."""
    t = F.abs(distance)
    if kind == "bilinear":
        return F.greatest(1 - t, F.lit(0.0))
    if kind == "cubic":  # Keys (1981), a = -1/2
        near = (t * 1.5 - 2.5) * t * t + 1
        far = ((t * -0.5 + 2.5) * t - 4) * t + 2
        return F.when(t < 1, near).when(t < 2, far).otherwise(0.0)
    if kind == "cubicspline":  # cubic B-spline
        near = (t * 3 - 6) * t * t / 6 + 4 / 6
        far = F.pow(2 - t, 3) / 6
        return F.when(t < 1, near).when(t < 2, far).otherwise(0.0)
    pi_t = t * math.pi
    lanczos = F.sin(pi_t) * F.sin(pi_t / 3) * 3 / (pi_t * pi_t)
    return F.when(t < 1e-12, F.lit(1.0)).when(t < 3, lanczos).otherwise(0.0)


def _axis(spark: SparkSession, n_target: int, start: float, step: float, n_source: int, kind: str) -> DataFrame:
    """Rows (source, target, weight) along one axis.

    ``start`` and ``step`` place the centre of target cell i at source
    coordinate ``start + i * step``, counted in source cells from centre 0.
    """
    reach = INTERPOLATING[kind]
    centre = F.col("target") * step + start
    targets = spark.range(n_target).select(F.col("id").cast("int").alias("target"))
    first = F.floor(centre).cast("int") - (reach - 1)
    spread = targets.select(
        "target", F.explode(F.sequence(first, first + (2 * reach - 1))).alias("source"), centre.alias("_c")
    )
    weight = _kernel(kind, F.col("_c") - F.col("source"))
    return spread.where(F.col("source").between(0, n_source - 1)).select("source", "target", weight.alias("_w")).where(
        F.col("_w") != 0
    )


def interpolate(cells: DataFrame, source: GridSpec, target: GridSpec, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Separable kernel interpolation. Missing cells drop out and the weights are renormalised.

    The weight tables of the two axes have a few rows per target line. They
    are measured and joined one after the other, so each source cell is
    expanded along one axis, summed, and only then along the other.
    """
    if source.crs != target.crs:
        return _interpolate_projected(cells, source, target, kind, keys)
    spark = cells.sparkSession
    x0 = (target.left + target.xres / 2 - source.left) / source.xres - 0.5
    y0 = (source.top - target.top + target.yres / 2) / source.yres - 0.5
    columns = _axis(spark, target.width, x0, target.xres / source.xres, source.width, kind)
    lines = _axis(spark, target.height, y0, target.yres / source.yres, source.height, kind)
    present = cells.where(F.col("value").isNotNull()).select(*keys, "row", "col", "value")
    across = (
        attach(present.withColumnRenamed("col", "source"), measured(columns), ["source"])
        .groupBy(*keys, "row", "target")
        .agg(F.sum(F.col("value") * F.col("_w")).alias("_s"), F.sum("_w").alias("_t"))
        .select(*keys, F.col("row").alias("source"), F.col("target").alias("col"), "_s", "_t")
    )
    down = (
        attach(across, measured(lines), ["source"])
        .groupBy(*keys, "target", "col")
        .agg(F.sum(F.col("_s") * F.col("_w")).alias("_s"), F.sum(F.col("_t") * F.col("_w")).alias("_t"))
    )
    value = F.when(F.abs("_t") > 1e-9, F.col("_s") / F.col("_t"))
    return down.select(*keys, F.col("target").alias("row"), "col", value.alias("value"))


def _interpolate_projected(cells: DataFrame, source: GridSpec, target: GridSpec, kind: str, keys: Sequence[str]) -> DataFrame:
    """Kernel interpolation between coordinate systems, whose axes do not line up.

    Every target centre is projected once and spread over the source cells its
    kernel reaches (at most 36), which are then joined by row and column.
    """
    reach = INTERPOLATING[kind]
    x, y = reproject(target.x_of(F.col("col")), target.y_of(F.col("row")), target.crs, source.crs)
    places = target.lattice(cells.sparkSession).select(
        "row", "col", ((F.lit(source.top) - y) / source.yres - 0.5).alias("_y"), ((x - source.left) / source.xres - 0.5).alias("_x")
    )
    first = lambda c: F.floor(c).cast("int") - (reach - 1)
    lines = places.select("*", F.explode(F.sequence(first(F.col("_y")), first(F.col("_y")) + 2 * reach - 1)).alias("_sr"))
    spread = lines.select("*", F.explode(F.sequence(first(F.col("_x")), first(F.col("_x")) + 2 * reach - 1)).alias("_sc"))
    weight = _kernel(kind, F.col("_y") - F.col("_sr")) * _kernel(kind, F.col("_x") - F.col("_sc"))
    wanted = spread.where(source.inside(F.col("_sr"), F.col("_sc"))).select("row", "col", "_sr", "_sc", weight.alias("_w")).where("_w <> 0")
    present = cells.where(F.col("value").isNotNull()).select(*keys, F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value")
    summed = wanted.join(present, ["_sr", "_sc"]).groupBy(*keys, "row", "col").agg(
        F.sum(F.col("value") * F.col("_w")).alias("_s"), F.sum("_w").alias("_t")
    )
    return summed.select(*keys, "row", "col", F.when(F.abs("_t") > 1e-9, F.col("_s") / F.col("_t")).alias("value"))


def _overlaps(spark: SparkSession, n_target: int, start: float, step: float, n_source: int) -> DataFrame:
    """Rows (source, target, weight) along one axis: the share of each source cell that lies in a target cell.

    Target cell i spans source coordinates ``start + i * step`` to ``start + (i + 1) * step``, counted in source cells from the grid's edge.
    """
    low, high = F.col("target") * step + start, (F.col("target") + 1) * step + start
    targets = spark.range(n_target).select(F.col("id").cast("int").alias("target"))
    first = F.greatest(F.floor(low), F.lit(0)).cast("int")
    last = F.least(F.ceil(high) - 1, F.lit(n_source - 1)).cast("int")
    spread = targets.select("target", low.alias("_lo"), high.alias("_hi"), first.alias("_a"), last.alias("_b")).where("_a <= _b")
    lined = spread.select("target", "_lo", "_hi", F.explode(F.sequence("_a", "_b")).alias("source"))
    share = F.least(F.col("_hi"), F.col("source") + 1.0) - F.greatest(F.col("_lo"), F.col("source").cast("double"))
    # Borders that agree up to rounding share no area.
    return lined.select("source", "target", share.alias("_w")).where(F.col("_w") > 1e-9)


def _clamped(a: Column, b: Column, dv: Column) -> Column:
    """Integral of min(max(u, 0), 1) along a segment from u = a to u = b over a height of ``dv``."""
    area = lambda u: F.when(u <= 0, 0.0).when(u < 1, u * u / 2).otherwise(u - 0.5)
    level = F.least(F.greatest((a + b) / 2, F.lit(0.0)), F.lit(1.0))
    return dv * F.when(F.abs(b - a) < 1e-9, level).otherwise((area(b) - area(a)) / (b - a))


def _projected_overlaps(cells: DataFrame, source: GridSpec, target: GridSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, row, col, value, weight) where the systems differ: each source cell becomes a quadrilateral of the target plane.

    The area a quadrilateral shares with a target cell is the sum over its
    edges of the distance from the cell's left border, kept between 0 and the
    cell's width, integrated over the height the edge has in the cell's row.
    A cell meets the few target cells of its own bounding box.
    """
    left, top = F.lit(source.left) + F.col("col") * source.xres, F.lit(source.top) - F.col("row") * source.yres

    def corner(dx: int, dy: int) -> Column:
        x, y = reproject(left + dx * source.xres, top - dy * source.yres, source.crs, target.crs)
        return F.struct(((x - target.left) / target.xres).alias("x"), ((F.lit(target.top) - y) / target.yres).alias("y"))

    # Exploded out of arrays of one, so that a corner is projected once.
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    quads = cells.where(F.col("value").isNotNull()).select(*keys, "value", F.explode(F.array(ring)).alias("_q"))
    box = bounds(F.col("_q"))
    sized = quads.select(*keys, "value", edges(F.col("_q")).alias("_e"), signed_area(F.col("_q")).alias("_area"), F.explode(F.array(box)).alias("_box"))
    span = lambda low, high, size: F.sequence(
        F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.floor(high), F.lit(size - 1)).cast("int")
    )
    reached = sized.where(
        (F.col("_box.xmax") >= 0) & (F.col("_box.ymax") >= 0) & (F.col("_box.xmin") < target.width) & (F.col("_box.ymin") < target.height)
    )
    lines = reached.select("*", F.explode(span(F.col("_box.ymin"), F.col("_box.ymax"), target.height)).alias("_r"))
    met = lines.select("*", F.explode(span(F.col("_box.xmin"), F.col("_box.xmax"), target.width)).alias("_c"))

    def share(acc: Column, s: Column) -> Column:
        low = F.greatest(F.least(s["y1"], s["y2"]), F.col("_r").cast("double"))
        high = F.least(F.greatest(s["y1"], s["y2"]), F.col("_r") + 1.0)
        slope = F.try_divide(s["x2"] - s["x1"], s["y2"] - s["y1"])
        at = lambda y: F.coalesce(s["x1"] + slope * (y - s["y1"]), s["x1"]) - F.col("_c")
        inside = _clamped(at(low), at(high), high - low) * F.signum(s["y2"] - s["y1"])
        return acc + F.when(high > low, inside).otherwise(0.0)

    weight = F.aggregate("_e", F.lit(0.0), share) / F.col("_area")
    return met.select(*keys, F.col("_r").alias("row"), F.col("_c").alias("col"), "value", weight.alias("_w")).where(F.col("_w") > 1e-9)


def overlaps(cells: DataFrame, source: GridSpec, target: GridSpec, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, col, value, _w): present source cells with the share of their area in each target cell they meet."""
    if source.crs != target.crs:
        return _projected_overlaps(cells, source, target, keys)
    spark = cells.sparkSession
    x0, y0 = (target.left - source.left) / source.xres, (source.top - target.top) / source.yres
    columns = _overlaps(spark, target.width, x0, target.xres / source.xres, source.width)
    lines = _overlaps(spark, target.height, y0, target.yres / source.yres, source.height)
    present = cells.where(F.col("value").isNotNull()).select(*keys, "row", "col", "value")
    across = attach(present.withColumnRenamed("col", "source"), measured(columns), ["source"]).select(
        *keys, F.col("row").alias("source"), F.col("target").alias("col"), "value", F.col("_w").alias("_x")
    )
    down = attach(across, measured(lines), ["source"])
    return down.select(*keys, F.col("target").alias("row"), "col", "value", (F.col("_x") * F.col("_w")).alias("_w"))


def area_regrid(cells: DataFrame, source: GridSpec, target: GridSpec, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Aggregate source cells by the share of their area in each target cell.

    ``sum`` deals a cell's value out in proportion, so the total over target
    cells that cover the source is kept; ``average`` weighs by area; ``mode``
    is the value with the most area, the smallest among equals; ``min`` and
    ``max`` are over all cells that share area; quartiles are the smallest
    value below which, itself included, that part of the area lies. Values of
    a target cell are summed by value before they are compared, so many cells of few values stay few rows.
    """
    place = [*keys, "row", "col"]
    met = overlaps(cells, source, target, keys)
    if kind in ("min", "max"):
        return met.groupBy(*place).agg(BLOCK_REDUCERS[kind](F.col("value")).alias("value"))
    if kind == "sum":
        return met.groupBy(*place).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    if kind == "average":
        return met.groupBy(*place).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))
    if kind != "mode" and kind not in QUARTILES:
        raise ValueError(f"no area weights for resampling kind {kind}")
    # Rounded, so that equal shares tie whatever order they were added in.
    weighed = met.groupBy(*place, "value").agg(F.round(F.sum("_w"), 9).alias("_w"))
    if kind == "mode":
        best = F.min(F.struct((-F.col("_w")).alias("_n"), F.col("value").alias("_v")))
        return weighed.groupBy(*place).agg(best["_v"].alias("value"))
    line = W.partitionBy(*place)
    upto = F.sum("_w").over(line.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = weighed.select(*place, "value", upto.alias("_upto"), F.sum("_w").over(line).alias("_all"))
    return ranked.where(F.col("_upto") >= F.col("_all") * QUARTILES[kind] - 1e-9).groupBy(*place).agg(F.min("value").alias("value"))


def regrid(
    cells: DataFrame, source: GridSpec, target: GridSpec, kind: str = "near", keys: Sequence[str] = (), by: str = "centre"
) -> DataFrame:
    """Resample ``cells`` onto ``target``.

    Aggregating kinds assign each source cell to the target cell that holds
    its centre, or, ``by`` area, to every target cell by the share it has in it. ``near`` and the interpolating kinds work from the target
    centre. Only present cells are returned.
    """
    if by not in ("centre", "area"):
        raise ValueError(f"cells are assigned by centre or by area, not by {by}")
    if by == "area" and kind in AGGREGATING:
        return area_regrid(cells, source, target, kind, keys)
    if kind == "near":
        return align_to_grid(target, cells, source, keys)
    if kind in INTERPOLATING:
        return interpolate(cells, source, target, kind, keys)
    if kind not in AGGREGATING:
        raise ValueError(f"unknown resampling kind {kind}")
    moved = to_target_cells(cells, source, target)
    if kind == "mode":
        return most_frequent(moved, [*keys, "row", "col"], "value")
    if kind in QUARTILES:
        # A target cell may hold any number of source cells, so its values are not gathered.
        return quantiles(moved, [*keys, "row", "col"], "value", [QUARTILES[kind]], ["value"])
    return moved.groupBy(*keys, "row", "col").agg(BLOCK_REDUCERS[kind](F.col("value")).alias("value"))
