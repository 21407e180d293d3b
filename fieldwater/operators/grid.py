"""Grids as cell tables: one row per (row, col), absent or NULL where there is no value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.functions import codes
from fieldwater.functions.geo import reproject
from fieldwater.functions.scalar import lookup
from fieldwater.operators.quantiles import quantiles


@dataclass(frozen=True)
class GridSpec:
    """Placement of a grid: upper-left corner, cell size, shape and coordinate system."""

    left: float
    top: float
    xres: float
    yres: float
    height: int
    width: int
    crs: str = "lonlat"
    nodata: float = codes.NODATA

    def col_of(self, x: Column) -> Column:
        return F.floor((x - self.left) / self.xres).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.top) - y) / self.yres).cast("int")

    def x_of(self, col: Column, corner: bool = False) -> Column:
        return (col + (0.0 if corner else 0.5)) * self.xres + self.left

    def y_of(self, row: Column, corner: bool = False) -> Column:
        return F.lit(self.top) - (row + (0.0 if corner else 0.5)) * self.yres

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def extent(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax."""
        return (
            self.left,
            self.top - self.height * self.yres,
            self.left + self.width * self.xres,
            self.top,
        )

    def coarser(self, factor: int) -> GridSpec:
        """The grid whose cells each cover ``factor`` x ``factor`` cells of this one."""
        return replace(
            self,
            xres=self.xres * factor,
            yres=self.yres * factor,
            height=-(-self.height // factor),
            width=-(-self.width // factor),
        )

    def lattice(self, spark: SparkSession) -> DataFrame:
        """Every (row, col) of the grid, generated where it is used."""
        ids = spark.range(self.height * self.width)
        return ids.select(
            F.floor(F.col("id") / self.width).cast("int").alias("row"),
            (F.col("id") % self.width).cast("int").alias("col"),
        )

    def save_row(self, spark: SparkSession, name: str) -> DataFrame:
        """This placement as a one-row table."""
        fields = "grid string, left double, top double, xres double, yres double, height int, width int, crs string, nodata double"
        place = [float(v) for v in (self.left, self.top, self.xres, self.yres)]
        values = (name, *place, self.height, self.width, self.crs, float(self.nodata))
        return spark.createDataFrame([values], fields)


def extent_of_points(points: DataFrame, x: str, y: str, src: str = "lonlat", dst: str = "lonlat") -> DataFrame:
    """One row (xmin, ymin, xmax, ymax); the two corners are reprojected when asked."""
    box = points.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.max(x).alias("_x1"), F.max(y).alias("_y1"))
    x0, y0 = reproject(F.col("_x0"), F.col("_y0"), src, dst)
    x1, y1 = reproject(F.col("_x1"), F.col("_y1"), src, dst)
    return box.select(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def with_coordinates(
    cells: DataFrame, spec: GridSpec, dst: str = "lonlat", corner: bool = False, names: tuple[str, str] = ("lon", "lat")
) -> DataFrame:
    """Add the coordinates of each cell's centre, or of its upper-left corner: arithmetic on (row, col), no join."""
    x, y = reproject(spec.x_of(F.col("col"), corner), spec.y_of(F.col("row"), corner), spec.crs, dst)
    return cells.withColumns({names[0]: x, names[1]: y})


def lon_lat_grid(spark: SparkSession, spec: GridSpec, dst: str = "lonlat", corner: bool = False) -> DataFrame:
    """Coordinates of every cell of a grid."""
    return with_coordinates(spec.lattice(spark), spec, dst, corner)


# --------------------------------------------------------------------------- sampling


def sample_points(
    points: DataFrame,
    cells: DataFrame,
    spec: GridSpec,
    x: str,
    y: str,
    src: str = "lonlat",
    on: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """Value of the cell each point falls in; NULL outside the grid or where there is no value.

    A left equi-join on the cell and on any further keys (``on``: dataset,
    year, month). The cell side holds one row per key, so a crowded cell is
    plain join skew, which AQE splits.
    """
    px, py = reproject(F.col(x), F.col(y), src, spec.crs)
    located = points.withColumns({"_row": spec.row_of(py), "_col": spec.col_of(px)})
    wanted = cells.where(spec.inside(F.col("row"), F.col("col"))).select(
        *[F.col(k).alias(f"_on_{k}") for k in on], F.col("row").alias("_r"), F.col("col").alias("_c"), value
    )
    same = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c"))
    for key in on:
        same = same & (F.col(key) == F.col(f"_on_{key}"))
    return located.join(wanted, same, "left").drop("_row", "_col", "_r", "_c", *[f"_on_{k}" for k in on])


def sample_predictors(
    points: DataFrame,
    cells: DataFrame,
    specs: dict[str, GridSpec],
    x: str,
    y: str,
    key: str,
    datasets: Sequence[str],
    year: str = "Year",
    month: str = "Month",
) -> DataFrame:
    """Add one column per dataset, sampled at each point's cell for its year and month.

    All datasets share one join: a point is expanded to its cell in every
    dataset, joined once per kind of product (monthly, yearly, static) with the
    long cell table, and pivoted back by key.
    """
    if not datasets:
        return points
    unknown = [d for d in datasets if d not in specs]
    if unknown:
        raise ValueError(f"no grid for {unknown}")
    places = []
    for name in datasets:
        spec = specs[name]
        px, py = reproject(F.col(x), F.col(y), "lonlat", spec.crs)
        row, col = spec.row_of(py), spec.col_of(px)
        places.append(F.struct(F.lit(name).alias("dataset"), row.alias("row"), col.alias("col")))
    wanted = points.select(key, year, month, F.explode(F.array(*places)).alias("_p")).select(
        key, year, month, "_p.dataset", "_p.row", "_p.col"
    )
    wanted = wanted.withColumnsRenamed({year: "year", month: "month"})
    keys_of = {"monthly": ["year", "month"], "yearly": ["year"], "static": []}
    parts = []
    for kind, keys in keys_of.items():
        named = [d for d in datasets if codes.temporal_kind(d) == kind]
        if named:
            on = ["dataset", "row", "col", *keys]
            part = cells.where(F.col("dataset").isin(named)).select(*on, "value")
            parts.append(wanted.join(part, on).select(key, "dataset", "value"))
    found = reduce(DataFrame.unionByName, parts)
    wide = found.groupBy(key).pivot("dataset", list(datasets)).agg(F.first("value", ignorenulls=True))
    return points.join(wide, key, "left")


def align_to_grid(target: GridSpec, cells: DataFrame, source: GridSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-cell resample of a grid onto another, across coordinate systems.

    Each target cell takes the source cell that holds its centre. With keys
    (dataset, year, month) the lattice is matched to every key group through
    the join itself, so nothing is repeated beforehand.
    """
    x, y = reproject(target.x_of(F.col("col")), target.y_of(F.col("row")), target.crs, source.crs)
    lattice = target.lattice(cells.sparkSession).select(
        "row", "col", source.row_of(y).alias("_sr"), source.col_of(x).alias("_sc")
    )
    moved = cells.where(F.col("value").isNotNull()).select(
        *keys, F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value"
    )
    return lattice.join(moved, ["_sr", "_sc"]).drop("_sr", "_sc")


# --------------------------------------------------------------------------- composites in time


# More products than this are refused; the caller may raise the bound.
CATALOGUE_ROWS = 10_000
DEFICIT = "et_minus_soil"

REDUCERS = {
    "sum": lambda v, when: F.sum(v),
    "mean": lambda v, when: F.avg(v),
    "first": lambda v, when: F.min_by(v, when),
    "last": lambda v, when: F.max_by(v, when),
    "last_minus_first": lambda v, when: F.max_by(v, when) - F.min_by(v, when),
    "sum_nonneg": lambda v, when: F.when(F.sum(v) >= 0, F.sum(v)),
}


def composite(
    cube: DataFrame,
    reducer: str,
    keys: Sequence[str] = ("row", "col", "year", "month"),
    value: str = "value",
    order: Sequence[str] = ("ts",),
    scale: float = 1.0,
) -> DataFrame:
    """Reduce a dated cube to one value per key.

    Reducers: sum, mean, median, first, last, last_minus_first, and sum_nonneg
    (a negative sum is missing).
    """
    if reducer == "median":
        middle = quantiles(cube, keys, value, [0.5], [value])
        return middle if scale == 1.0 else middle.withColumn(value, F.col(value) * F.lit(float(scale)))
    if reducer not in REDUCERS:
        raise ValueError(f"unknown reducer {reducer}")
    made = REDUCERS[reducer](F.col(value), F.struct(*order))
    return cube.groupBy(*keys).agg((made * F.lit(float(scale))).alias(value))


def composite_by_catalogue(
    cube: DataFrame,
    catalogue: DataFrame,
    keys: Sequence[str] = ("dataset", "row", "col", "year", "month"),
    order: Sequence[str] = ("ts",),
    most_rules: int = CATALOGUE_ROWS,
) -> DataFrame:
    """Composite many products, each by the reducer and scale its catalogue row names.

    Products that share a reducer are reduced together in one aggregation over
    just their rows (the dataset filter reaches the scan), so sums stay in
    hash aggregation and only median products pay for a median. A deficit
    product is made from the rows of its two source products. Where the cube
    names each row's ``collection``, a product with a later collection takes
    the rows of the one that holds in the row's own month. A product of the
    cube that the catalogue lacks, and an unknown reducer, are refused.
    """
    rules = [r.asDict() for r in catalogue.limit(most_rules + 1).collect()]
    if len(rules) > most_rules:
        raise ValueError("the catalogue is not a short list")
    by_reducer: dict[str, dict[str, float]] = {}
    deficits = [r for r in rules if r["reducer"] == DEFICIT]
    for rule in rules:
        if rule["reducer"] not in (DEFICIT, "median", *REDUCERS):
            raise ValueError(f"unknown reducer {rule['reducer']} of {rule['dataset']}")
        if rule["reducer"] != DEFICIT:
            by_reducer.setdefault(rule["reducer"], {})[rule["dataset"]] = rule["scale"]
    known = sorted({d for scales in by_reducer.values() for d in scales})
    stray = cube.where(F.col("dataset").isNull() | ~F.col("dataset").isin(known)).select("dataset").limit(1).collect()
    if stray:
        raise ValueError(f"no rule reduces product {stray[0]['dataset']}")
    later = {r["dataset"]: (r["collection"], r["later_collection"]) for r in rules if r.get("later_collection")}
    if "collection" in cube.columns and later:
        first, second = (lookup({d: pair[i] for d, pair in later.items()}, F.col("dataset")) for i in (0, 1))
        held = F.when(codes.in_later_collection(F.col("year"), F.col("month")), second).otherwise(first)
        cube = cube.where(held.isNull() | (F.col("collection") == held))
    parts = []
    for reducer, scales in by_reducer.items():
        rows = cube.where(F.col("dataset").isin(list(scales)))
        scale = lookup(scales, F.col("dataset"))
        reduced = composite(rows, reducer, keys, order=order)
        parts.append(reduced.withColumn("value", F.col("value") * scale))
    places = [k for k in keys if k != "dataset"]
    for rule in deficits:
        et, soil = (cube.where(F.col("dataset") == name) for name in codes.DEFICIT_SOURCES[rule["dataset"]])
        value = (F.col("value") * F.lit(float(rule["scale"]))).alias("value")
        parts.append(et_minus_soil(et, soil, places).withColumn("dataset", F.lit(rule["dataset"])).select(*keys, value))
    return reduce(DataFrame.unionByName, parts)


def et_minus_soil(et: DataFrame, soil: DataFrame, keys: Sequence[str] = ("row", "col", "year", "month")) -> DataFrame:
    """Deficit: monthly evapotranspiration (0.1 mm units) less monthly surface soil moisture."""
    left = composite(et, "sum", keys, scale=0.1).withColumnRenamed("value", "_et")
    right = composite(soil, "sum", keys).withColumnRenamed("value", "_soil")
    return left.join(right, list(keys)).select(*keys, (F.col("_et") - F.col("_soil")).alias("value"))


def daily_cube_to_month(cube: DataFrame, dataset: str) -> DataFrame:
    """Month of a daily cube: the mean for runoff and storage, else the sum with negatives missing."""
    months = cube.withColumns({"year": F.year("date"), "month": F.month("date")})
    reducer = "mean" if dataset in codes.DAILY_MEAN_PRODUCTS else "sum_nonneg"
    return composite(months, reducer, order=("date",))


# --------------------------------------------------------------------------- blocks

BLOCK_REDUCERS = {
    "sum": lambda v: F.sum(v),
    "average": lambda v: F.avg(v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "med": lambda v: F.percentile(v, 0.5),
    "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75),
}


def block_reduce(cells: DataFrame, factor: int, reducer: str, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Reduce ``factor`` x ``factor`` blocks. Missing cells are skipped; a block without values is NULL.

    A block has at most factor^2 cells, so the exact percentiles stay bounded.
    """
    blocks = cells.withColumns(
        {"row": F.floor(F.col("row") / factor).cast("int"), "col": F.floor(F.col("col") / factor).cast("int")}
    )
    if reducer == "mode":
        return most_frequent(blocks, [*keys, "row", "col"], value)
    return blocks.groupBy(*keys, "row", "col").agg(BLOCK_REDUCERS[reducer](F.col(value)).alias(value))


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, the smallest among equals. Counts first, so no group is held."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_n"), F.col(value).alias("_v")))
    return counts.groupBy(*keys).agg(best["_v"].alias(value))


def coarse_sum(cells: DataFrame, factor: int = 10, keys: Sequence[str] = (), minimum: float = codes.COARSE_MINIMUM) -> DataFrame:
    """Block sums with sums at or below ``minimum`` missing."""
    summed = block_reduce(cells, factor, "sum", keys)
    return summed.withColumn("value", F.when(F.col("value") > minimum, F.col("value")))


def majority_regrid(cells: DataFrame, source: GridSpec, target: GridSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Majority class of the source cells whose centres fall in each target cell."""
    return most_frequent(to_target_cells(cells, source, target), [*keys, "row", "col"], "value")


def to_target_cells(cells: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """Replace (row, col) by the target cell that holds the source cell's centre, projected where the systems differ."""
    x, y = reproject(source.x_of(F.col("col")), source.y_of(F.col("row")), source.crs, target.crs)
    moved = cells.withColumns({"_r": target.row_of(y), "_c": target.col_of(x)}).where(target.inside(F.col("_r"), F.col("_c")))
    return moved.drop("row", "col").withColumnsRenamed({"_r": "row", "_c": "col"})


# --------------------------------------------------------------------------- focal windows


def dense(cells: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """The full lattice with NULL where the cell table has no row."""
    return spec.lattice(cells.sparkSession).join(cells.select("row", "col", value), ["row", "col"], "left")


def focal_mean(cells: DataFrame, spec: GridSpec, radius: int = 1, value: str = "value") -> DataFrame:
    """Mean of the non-missing cells of the (2r+1)^2 window around every cell.

    The window sum is separable: a running frame along rows, then one along
    columns. Each pass moves the table once and a task sorts one line of it.
    """
    along_row = W.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    along_col = W.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    lines = dense(cells, spec, value).select(
        "row", "col", F.sum(value).over(along_row).alias("_s"), F.count(value).over(along_row).alias("_n")
    )
    total, n = F.sum("_s").over(along_col), F.sum("_n").over(along_col)
    return lines.select("row", "col", F.try_divide(total, n).alias(value))


def _column_distance():
    """Task helper: ring distance to the nearest value for one grid column, from each row's in-row gap.

    Built as a closure so that workers need no copy of this package.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("row")
        gap = pdf["gap"].to_numpy(dtype="float64")
        best = gap.copy()
        shift = 1
        while shift < len(gap) and (best > shift).any():
            best[shift:] = np.minimum(best[shift:], np.maximum(gap[:-shift], shift))
            best[:-shift] = np.minimum(best[:-shift], np.maximum(gap[shift:], shift))
            shift += 1
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "col": pdf["col"].to_numpy(), "radius": best})

    return run


def missing_radius(grid: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """(row, col, radius) of every cell of a dense grid: the window radius that first meets a value.

    In-row gaps come from two window frames; each grid column (``height``
    numbers) is then finished on its own.
    """
    before = W.partitionBy("row").orderBy("col").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("row").orderBy("col").rowsBetween(W.currentRow, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("col"))
    never = F.lit(float("inf"))
    gap = F.least(
        F.coalesce((F.col("col") - F.last(at, True).over(before)).cast("double"), never),
        F.coalesce((F.first(at, True).over(after) - F.col("col")).cast("double"), never),
    )
    return (
        grid.select("row", "col", gap.alias("gap"))
        .groupBy("col")
        .applyInPandas(_column_distance(), "row int, col int, radius double")
    )


def focal_fill(cells: DataFrame, spec: GridSpec, categorical: bool = False, value: str = "value") -> DataFrame:
    """Fill every missing cell from the smallest window around it that holds a value.

    The window that first meets a value meets values only on its outermost
    ring, so each missing cell looks up just that ring: the mean of its values,
    or the most frequent (smallest among equals) when categorical.
    """
    grid = dense(cells, spec, value)
    radius = missing_radius(grid, spec, value)
    gaps = radius.where((F.col("radius") > 0) & (F.col("radius") < float("inf"))).select(
        F.col("row").alias("_r0"), F.col("col").alias("_c0"), F.col("radius").cast("int").alias("_d")
    )
    step = F.sequence(-F.col("_d"), F.col("_d"))
    inner = F.sequence(-F.col("_d") + 1, F.col("_d") - 1)
    place = lambda dr, dc: F.struct((F.col("_r0") + dr).alias("row"), (F.col("_c0") + dc).alias("col"))
    ring = F.concat(
        F.transform(step, lambda s: place(-F.col("_d"), s)),
        F.transform(step, lambda s: place(F.col("_d"), s)),
        F.transform(inner, lambda s: place(s, -F.col("_d"))),
        F.transform(inner, lambda s: place(s, F.col("_d"))),
    )
    # At distance one the inner run is the single row of the cell itself.
    ring = F.filter(ring, lambda p: spec.inside(p["row"], p["col"]))
    looks = gaps.select("_r0", "_c0", F.explode(ring).alias("_p")).select("_r0", "_c0", "_p.row", "_p.col")
    met = looks.join(cells.where(F.col(value).isNotNull()).select("row", "col", value), ["row", "col"])
    if categorical:
        filled = most_frequent(met, ["_r0", "_c0"], value)
    else:
        filled = met.groupBy("_r0", "_c0").agg(F.avg(value).alias(value))
    filled = filled.select(F.col("_r0").alias("row"), F.col("_c0").alias("col"), F.col(value).alias("_f"))
    return grid.join(filled, ["row", "col"], "left").select(
        "row", "col", F.coalesce(F.col(value), F.col("_f")).alias(value)
    )


# --------------------------------------------------------------------------- land cover


def correct_land_cover(
    cover: Column, hydrography: Column, irrigated: Column, in_field: Column
) -> Column:
    """Ordered land-cover rules: ponds become aquaculture, open water is missing, and a crop
    outside both the irrigation mask and the permitted fields is missing unless it is always irrigated."""
    merged = F.when(cover.isin(list(codes.POND_CODES)), F.lit(codes.AQUACULTURE_CODE)).otherwise(cover)
    dry = (
        ~merged.isin(list(codes.ALWAYS_IRRIGATED_CODES))
        & F.coalesce(irrigated == 0, F.lit(False))
        & ~F.coalesce(in_field == 1, F.lit(False))
    )
    water = F.coalesce(hydrography == 1, F.lit(False))
    return F.when(water | dry, F.lit(codes.MISSING_CODE)).otherwise(merged)


def correct_land_cover_cells(
    cover: DataFrame, hydrography: DataFrame, irrigation: DataFrame, fields: DataFrame, keys: Sequence[str] = ("year",)
) -> DataFrame:
    """Join the four grids by cell and apply the land-cover rules. Hydrography has no year."""
    cell = ["row", "col"]
    joined = (
        cover.withColumnRenamed("value", "_cover")
        .join(irrigation.withColumnRenamed("value", "_irrigated"), [*keys, *cell], "left")
        .join(fields.withColumnRenamed("value", "_field"), [*keys, *cell], "left")
        .join(hydrography.withColumnRenamed("value", "_water"), cell, "left")
    )
    fixed = correct_land_cover(F.col("_cover"), F.col("_water"), F.col("_irrigated"), F.col("_field"))
    return joined.select(*keys, *cell, fixed.alias("value"))
