"""Polygons on grids: burn, clip and zonal joins by scan lines.

A polygon is turned into runs of cells: each edge reports where it crosses the
centre line of the grid rows it spans, the crossings of a row are paired up
(even-odd rule), and each pair is a run of columns. Work is proportional to
the edges and to the cells inside; no cell is ever tested against a polygon it
is not in, and crowded places need no special care.

A polygon column holds one ring, or an array of all rings of a polygon with
holes and parts. The edges of all rings meet in one scan line, so a hole's
crossings close and open runs by themselves. Parts must not overlap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.functions.geo import edges_of, rings_of
from fieldwater.operators.grid import GridSpec


def _edge_rows(polygons: DataFrame, spec: GridSpec, carry: Sequence[str], ring: str) -> DataFrame:
    """One row per edge in grid units: u counts columns from the left, v counts rows from the top."""
    e = polygons.select(*carry, F.explode(edges_of(rings_of(polygons, ring))).alias("_e"))
    u = lambda x: (x - spec.left) / spec.xres
    v = lambda y: (F.lit(spec.top) - y) / spec.yres
    return e.select(
        *carry,
        u(F.col("_e.x1")).alias("u1"),
        v(F.col("_e.y1")).alias("v1"),
        u(F.col("_e.x2")).alias("u2"),
        v(F.col("_e.y2")).alias("v2"),
    )


def cell_runs(polygons: DataFrame, spec: GridSpec, carry: Sequence[str], ring: str = "ring") -> DataFrame:
    """Runs (row, first, last) of the cells whose centres lie inside each polygon.

    ``carry`` must identify the polygon. A centre exactly on a left or upper
    edge counts as inside, on a right or lower edge as outside.
    """
    e = _edge_rows(polygons, spec, carry, ring)
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    # Rows r with low <= r + 0.5 < high, kept to the grid.
    first = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - 0.5) - 1, F.lit(spec.height - 1)).cast("int")
    spanning = e.withColumns({"_a": first, "_b": last}).where(F.col("_a") <= F.col("_b"))
    lined = spanning.select("*", F.explode(F.sequence("_a", "_b")).alias("row"))
    share = (F.col("row") + 0.5 - F.col("v1")) / (F.col("v2") - F.col("v1"))
    crossings = lined.select(*carry, "row", (F.col("u1") + share * (F.col("u2") - F.col("u1"))).alias("_u"))
    line = W.partitionBy(*carry, "row").orderBy("_u")
    paired = crossings.select(
        *carry, "row", F.col("_u").alias("_from"), F.lead("_u").over(line).alias("_to"), F.row_number().over(line).alias("_k")
    ).where(F.col("_k") % 2 == 1)
    start = F.greatest(F.ceil(F.col("_from") - 0.5), F.lit(0)).cast("int")
    stop = F.least(F.ceil(F.col("_to") - 0.5) - 1, F.lit(spec.width - 1)).cast("int")
    return paired.select(*carry, "row", start.alias("first"), stop.alias("last")).where(F.col("first") <= F.col("last"))


def touched_by_edges(polygons: DataFrame, spec: GridSpec, carry: Sequence[str], ring: str = "ring") -> DataFrame:
    """Cells that any edge of a polygon meets, borders on the left and top of a cell included."""
    e = _edge_rows(polygons, spec, carry, ring)
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    first = F.greatest(F.floor(low), F.lit(0)).cast("int")
    last = F.least(F.floor(high), F.lit(spec.height - 1)).cast("int")
    lined = (
        e.withColumns({"_lo": low, "_hi": high, "_a": first, "_b": last})
        .where(F.col("_a") <= F.col("_b"))
        .select("*", F.explode(F.sequence("_a", "_b")).alias("row"))
    )
    # Part of the edge inside the row band, as u at its two ends.
    top = F.greatest(F.col("_lo"), F.col("row").cast("double"))
    bottom = F.least(F.col("_hi"), F.col("row") + 1.0)
    slope = F.try_divide(F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1"))
    at = lambda v: F.col("u1") + slope * (v - F.col("v1"))
    ua, ub = F.coalesce(at(top), F.col("u1")), F.coalesce(at(bottom), F.col("u2"))
    left, right = F.least(ua, ub), F.greatest(ua, ub)
    c0 = F.greatest(F.floor(left), F.lit(0)).cast("int")
    c1 = F.least(F.floor(right), F.lit(spec.width - 1)).cast("int")
    ranged = lined.select(*carry, "row", c0.alias("_c0"), c1.alias("_c1")).where(F.col("_c0") <= F.col("_c1"))
    return ranged.select(*carry, "row", F.explode(F.sequence("_c0", "_c1")).alias("col"))


def covered_cells(
    polygons: DataFrame, spec: GridSpec, carry: Sequence[str], ring: str = "ring", all_touched: bool = False
) -> DataFrame:
    """Cells of each polygon: centre inside, or touched in any way."""
    runs = cell_runs(polygons, spec, carry, ring)
    inside = runs.select(*carry, "row", F.explode(F.sequence("first", "last")).alias("col"))
    if not all_touched:
        return inside
    return inside.unionByName(touched_by_edges(polygons, spec, carry, ring)).distinct()


def burn(
    polygons: DataFrame,
    spec: GridSpec,
    key: str,
    value: str | None = None,
    constant: float = 1.0,
    keys: Sequence[str] = (),
    ring: str = "ring",
) -> DataFrame:
    """Polygons to cells: an attribute summed over overlapping polygons (centre rule), or a
    constant burned into every touched cell when no attribute is named. ``keys`` (a year, say)
    keep separate grids apart."""
    if value is None:
        touched = covered_cells(polygons, spec, [key, *keys], ring, all_touched=True)
        return touched.select(*keys, "row", "col").distinct().withColumn("value", F.lit(float(constant)))
    cells = covered_cells(polygons, spec, [key, *keys, value], ring)
    return cells.groupBy(*keys, "row", "col").agg(F.sum(value).alias("value"))


def zonal_cells(cells: DataFrame, polygons: DataFrame, spec: GridSpec, zone: str, key: str | None = None, ring: str = "ring") -> DataFrame:
    """Cells joined to every zone that holds their centre. A zone may have many polygons.

    The polygons are rasterised first, so the join is a plain equi-join on the
    cell: a cell meets exactly the zones it belongs to.
    """
    carry = [zone] if key is None else [key, zone]
    zones = covered_cells(polygons, spec, carry, ring).select(zone, "row", "col")
    if key is not None:
        zones = zones.distinct()
    return cells.join(zones, ["row", "col"])


def clip(cells: DataFrame, polygons: DataFrame, spec: GridSpec, key: str, ring: str = "ring") -> DataFrame:
    """Cells whose centres lie in any of the polygons."""
    keep = covered_cells(polygons, spec, [key], ring).select("row", "col").distinct()
    return cells.join(keep, ["row", "col"], "left_semi")


def clip_box(cells: DataFrame, spec: GridSpec, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells whose centres lie in a box: a range predicate that reaches the scan."""
    c0, c1 = (xmin - spec.left) / spec.xres - 0.5, (xmax - spec.left) / spec.xres - 0.5
    r0, r1 = (spec.top - ymax) / spec.yres - 0.5, (spec.top - ymin) / spec.yres - 0.5
    return cells.where(
        F.col("col").between(math.ceil(c0), math.floor(c1)) & F.col("row").between(math.ceil(r0), math.floor(r1))
    )
