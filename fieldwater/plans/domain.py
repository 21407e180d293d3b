"""The driver tables read as meters, points, fields and grids."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.functions.sizing import dealt
from fieldwater.operators.grid import GridSpec
from fieldwater.session import checkpoint_dir

GRID_WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder for a stage table."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sites(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("site"),
        F.col("c_mktsegment").alias("crop"),
        F.col("c_nationkey").cast("int").alias("state"),
        F.col("c_acctbal").alias("acres"),
    )


def readings(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("site"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("crop"),
        "value",
    )


def annual(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("site"),
        F.col("o_orderpriority").alias("crop"),
        F.year("o_orderdate").alias("yr"),
        F.month("o_orderdate").alias("mon"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("wu"),
    )


def profile(spark, d) -> DataFrame:
    """Mean line quantity by order class and month: (crop, month, use)."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("crop"), F.month("o_orderdate").alias("month")
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return lines.join(orders, "l_orderkey").groupBy("crop", "month").agg(F.avg("l_quantity").alias("use"))


def parts(spark, d) -> DataFrame:
    """Parts as grid cells: (row, col, value, cls, crop, brand, name)."""
    return table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / GRID_WIDTH).cast("int").alias("row"),
        (F.col("p_partkey") % GRID_WIDTH).cast("int").alias("col"),
        F.col("p_retailprice").alias("value"),
        F.col("p_size").alias("cls"),
        F.col("p_type").alias("crop"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
    )


def cells(spark, d) -> DataFrame:
    return parts(spark, d).select("row", "col", "value")


def cell_spec(spark, d) -> GridSpec:
    """Placement of the part grid; its height comes from the row count in the file footer."""
    n = table(spark, d, "part").count()
    return GridSpec(left=0.0, top=100.0, xres=2.0, yres=2.5, height=math.ceil(n / GRID_WIDTH), width=GRID_WIDTH)


def cube(spark, d) -> DataFrame:
    """Line items as a dated cube over the part grid."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("cell"),
        F.floor(F.col("l_partkey") / GRID_WIDTH).cast("int").alias("row"),
        (F.col("l_partkey") % GRID_WIDTH).cast("int").alias("col"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_suppkey").alias("k3"),
        F.col("l_extendedprice").alias("k4"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


def by_cell(spark, d, rows: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Deal a table of cells or of their dates by cell, in as many parts as the cube's lines ask for (counted in the file footer)."""
    return dealt(rows, keys, table(spark, d, "lineitem").count())


CUBE_ORDER = ("ts", "k1", "k2", "k3", "k4")


def points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("pid"),
        (((k * 61) % 1000).cast("double") / 10).alias("x"),
        (((k * 17) % 1000).cast("double") / 10).alias("y"),
        F.col("c_acctbal").alias("bal"),
    )


def field_points(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("fid"),
        (((k * 37) % 1000).cast("double") / 10).alias("x"),
        (((k * 91) % 1000).cast("double") / 10).alias("y"),
        F.col("s_nationkey").cast("int").alias("nation"),
        F.col("s_acctbal").alias("bal"),
    )


# The same readings of the driver tables in SQL, used inline by the check queries.
VIEW = {
    "site": "(select c_custkey as site, c_mktsegment as crop, cast(c_nationkey as int) as state, c_acctbal as acres from customer)",
    "reading": "(select event_id, user_id as site, ts, event_type as crop, value from events)",
    "annual": (
        "(select o_orderkey as id, o_custkey as site, o_orderpriority as crop, cast(year(o_orderdate) as int) as yr, "
        "cast(month(o_orderdate) as int) as mon, o_orderstatus as status, o_totalprice as wu from orders)"
    ),
    "profile": (
        "(select o_orderpriority as crop, cast(month(o_orderdate) as int) as mon, avg(l_quantity) as avg_wu "
        "from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)"
    ),
    "cell": (
        "(select cast(floor(p_partkey / 50.0) as int) as r, cast(p_partkey % 50 as int) as c, p_retailprice as val, "
        "p_size as cls, p_type as crop, p_brand as brand, p_name as name from part)"
    ),
    "cube": (
        "(select l_partkey as cell, cast(floor(l_partkey / 50.0) as int) as r, cast(l_partkey % 50 as int) as c, "
        "cast(year(l_shipdate) as int) as yr, cast(month(l_shipdate) as int) as mon, l_shipdate as ts, l_quantity as val, "
        "l_orderkey as k1, l_linenumber as k2, l_suppkey as k3, l_extendedprice as k4, l_returnflag as flag, "
        "l_linestatus as line_status from lineitem)"
    ),
    "point": (
        "(select c_custkey as pid, cast((c_custkey * 61) % 1000 as double) / 10 as x, "
        "cast((c_custkey * 17) % 1000 as double) / 10 as y, c_acctbal as bal from customer)"
    ),
    "field": (
        "(select s_suppkey as fid, cast((s_suppkey * 37) % 1000 as double) / 10 as x, "
        "cast((s_suppkey * 91) % 1000 as double) / 10 as y, cast(s_nationkey as int) as nation, s_acctbal as bal from supplier)"
    ),
}
VIEW["weight"] = f"(select crop, mon, avg_wu / sum(avg_wu) over (partition by crop) as wt from {VIEW['profile']} p)"
