"""Exact nearest neighbour in the plane by descending a tree of grid cells.

Targets are summarised in a tree table: each node is a square cell with its
target count and tight bounding box, split 4 x 4 while it holds more than a
few targets. A point walks down the tree level by level and keeps only the
nodes that can still hold its nearest target: those whose nearest corner is
no farther than the farthest corner of the best node. Every step is an
equi-join on the node, so a crowded area costs extra levels rather than
extra candidates, and the answer is exact whatever the distribution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.functions.geo import reproject
from fieldwater.functions.scalar import is_true
from fieldwater.functions.sizing import BROADCAST_ROWS, attach
from fieldwater.session import cut_lineage

LEAF = 8  # targets a node may hold without being split
FAN = 4  # splits per axis
DEEPEST = 24  # 4^24 cells per axis is still exact in a double


def _cell(value: Column, origin: float, span: float, level: int) -> Column:
    n = FAN**level
    return F.least(F.floor((value - origin) / (span / n)), F.lit(n - 1)).cast("bigint")


BOX = ("n", "x0", "x1", "y0", "y1")
NODE = ("cx", "cy", *BOX, "members")


def _nodes(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finest nodes, from target places that carry cx, cy. The caller has checked their sizes."""
    return places.groupBy(*keys, "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("tx").alias("x0"),
        F.max("tx").alias("x1"),
        F.min("ty").alias("y0"),
        F.max("ty").alias("y1"),
        F.collect_list(F.struct("tid", "tx", "ty")).alias("members"),
    )


def _parents(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Next coarser nodes. Members are kept only while they fit a leaf, so a node never grows."""
    up = nodes.withColumns({"cx": F.floor(F.col("cx") / FAN), "cy": F.floor(F.col("cy") / FAN)})
    merged = up.groupBy(*keys, "cx", "cy").agg(
        F.sum("n").alias("n"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        F.flatten(F.collect_list(F.when(F.col("n") <= LEAF, F.col("members")))).alias("members"),
    )
    return merged.withColumn("members", F.when(F.col("n") <= LEAF, F.col("members")))


def _near2(px: Column, py: Column, node) -> Column:
    """Squared distance to the nearest place a node's targets may be."""
    dx = F.greatest(node("x0") - px, px - node("x1"), F.lit(0.0))
    dy = F.greatest(node("y0") - py, py - node("y1"), F.lit(0.0))
    return dx * dx + dy * dy


def _far2(px: Column, py: Column, node) -> Column:
    """Squared distance no target of the node exceeds."""
    dx = F.greatest(F.abs(px - node("x0")), F.abs(px - node("x1")))
    dy = F.greatest(F.abs(py - node("y0")), F.abs(py - node("y1")))
    return dx * dx + dy * dy


def nearest(
    points: DataFrame,
    targets: DataFrame,
    target_id: str,
    x: str = "x",
    y: str = "y",
    target_x: str | None = None,
    target_y: str | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add to each point the nearest target of its ``within`` group (a year, say).

    New columns: ``target_id`` (smallest id among equally near ones),
    ``near_x``, ``near_y`` and ``dist2``. Points without any target in their
    group keep NULLs. Points at one position are looked up once.
    """
    keys = list(within)
    tx, ty = target_x or x, target_y or y
    places = (
        targets.where(F.col(tx).isNotNull() & F.col(ty).isNotNull())
        .groupBy(*keys, F.col(tx).cast("double").alias("tx"), F.col(ty).cast("double").alias("ty"))
        .agg(F.min(target_id).alias("tid"))
    )
    places = cut_lineage(places)
    box = places.agg(F.count(F.lit(1)), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    n_places, x_lo, x_hi, y_lo, y_hi = box
    if not n_places:
        empty = {target_id: F.lit(None).cast(targets.schema[target_id].dataType)}
        return points.withColumns({**empty, **{c: F.lit(None).cast("double") for c in ("near_x", "near_y", "dist2")}})
    span = max(x_hi - x_lo, y_hi - y_lo) or 1.0

    depth = math.ceil(math.log(max(n_places / LEAF, 1), FAN * FAN))
    while True:
        at_depth = places.withColumns(
            {"cx": _cell(F.col("tx"), x_lo, span, depth), "cy": _cell(F.col("ty"), y_lo, span, depth)}
        )
        fullest = at_depth.groupBy(*keys, "cx", "cy").count().agg(F.max("count")).first()[0]
        if fullest <= LEAF or depth >= DEEPEST:
            break
        depth = min(DEEPEST, depth + 1 + math.ceil(math.log(fullest / LEAF, FAN * FAN)))
    levels = [cut_lineage(_nodes(at_depth, keys))]
    for _ in range(depth):
        levels.append(cut_lineage(_parents(levels[-1], keys)))
    levels.reverse()

    where = [*keys, "px", "py"]
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")
    ).distinct()
    # No level has more nodes than there are target places.
    small = n_places <= BROADCAST_ROWS // 10
    frontier = attach(spots, _sized(levels[0], small), keys)
    for level in range(1, depth + 1):
        frontier = _descend(frontier, _sized(levels[level], small), keys, where)
        if level % 4 == 0:
            frontier = cut_lineage(frontier)

    reached = F.transform(
        "members",
        lambda m: F.struct(
            ((F.col("px") - m["tx"]) * (F.col("px") - m["tx"]) + (F.col("py") - m["ty"]) * (F.col("py") - m["ty"])).alias("d2"),
            m["tid"].alias("tid"),
            m["tx"].alias("tx"),
            m["ty"].alias("ty"),
        ),
    )
    found = frontier.groupBy(*where).agg(F.min(F.array_min(reached)).alias("_best"))
    renamed = found.withColumnsRenamed({**{k: f"_k_{k}" for k in keys}, "px": "_px", "py": "_py"})
    same = (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return points.join(renamed, same, "left").select(
        *points.columns,
        F.col("_best.tid").alias(target_id),
        F.col("_best.tx").alias("near_x"),
        F.col("_best.ty").alias("near_y"),
        F.col("_best.d2").alias("dist2"),
    )


def _sized(nodes: DataFrame, small: bool) -> DataFrame:
    """Mark a checkpointed level for broadcast when its rows are known or counted to be few."""
    return F.broadcast(nodes) if small or nodes.count() <= BROADCAST_ROWS // 10 else nodes


def _descend(frontier: DataFrame, children: DataFrame, keys, where) -> DataFrame:
    """Replace the nodes that hold more than a leaf by their children, then drop what is too far."""
    px, py = F.col("px"), F.col("py")
    child = children.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.floor(F.col("cx") / FAN).alias("_px"),
        F.floor(F.col("cy") / FAN).alias("_py"),
        *[F.col(c).alias(f"_{c}") for c in NODE],
    )
    same = (F.col("n") > LEAF) & (F.col("cx") == F.col("_px")) & (F.col("cy") == F.col("_py"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    # A leaf matches no child and is carried on as it is.
    opened = frontier.join(child, same, "left").select(
        *where, *[F.when(F.col("_cx").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in NODE]
    )
    bound = F.min(_far2(px, py, F.col)).over(W.partitionBy(*where))
    scored = opened.withColumns({"_near": _near2(px, py, F.col), "_bound": bound})
    return scored.where(F.col("_near") <= F.col("_bound")).drop("_near", "_bound")


def link_to_fields(
    rows: DataFrame,
    fields: DataFrame,
    permit: str = "PermitNumb",
    x: str = "x",
    y: str = "y",
    year: str = "Year",
    eligible: Column | None = None,
    plane: str | None = None,
) -> DataFrame:
    """Move eligible rows to the centroid of the nearest field of their year and attach its permit.

    ``fields`` holds (year, permit, x, y) centroids in the same plane. With
    ``plane`` both sides are longitudes and latitudes: distances are measured
    in that projection, where a degree east is not a degree north. Rows
    that are not eligible, including those where eligibility is unknown, pass
    through with their own coordinates and no permit. By default a row is
    eligible when its state is MS or its source is VMP.
    """
    default = (F.col("State") == "MS") | (F.col("Data") == "VMP")
    marked = is_true(default if eligible is None else eligible)
    flat = lambda a, b: reproject(a, b, "lonlat", plane) if plane else (a, b)
    fx, fy = flat(F.col(x), F.col(y))
    centroids = fields.select(F.col(year), F.col(permit), fx.alias("_fx"), fy.alias("_fy"))
    px, py = flat(F.col(x), F.col(y))
    placed = rows.where(marked).withColumns({"_plane_x": px, "_plane_y": py})
    linked = nearest(placed, centroids, permit, "_plane_x", "_plane_y", "_fx", "_fy", [year])
    near_x, near_y = F.col("near_x"), F.col("near_y")
    if plane:
        near_x, near_y = reproject(near_x, near_y, plane, "lonlat")
    moved = linked.withColumns({x: F.coalesce(near_x, F.col(x)), y: F.coalesce(near_y, F.col(y))}).drop(
        "near_x", "near_y", "dist2", "_plane_x", "_plane_y"
    )
    passed = rows.where(~marked).withColumn(permit, F.lit(None).cast(fields.schema[permit].dataType))
    return moved.unionByName(passed)
