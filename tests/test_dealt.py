"""Rows are dealt by their count: one task's share stays the same however large the tables are."""

from datetime import date
from functools import partial

import pytest
from pyspark.sql import functions as F

from fieldwater.functions import sizing
from fieldwater.operators import cropstats, grid, scoring
from fieldwater.plans import domain, grid_queries, model_queries

PARTS, LINES, TASK = 120, 2_400, 40
PART = "p_partkey long, p_retailprice double, p_size int, p_type string, p_brand string, p_name string"
LINE = (
    "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
    "l_returnflag string, l_linestatus string, l_shipdate date"
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dealt"))
    parts = [(k, 1000.0 + k, 1 + k % 6, "SMALL", "b", "n") for k in range(PARTS)]
    lines = [(k // 4, k % 4, k * 7 % PARTS, k % 5, 1.0 + k % 50, 100.0 + k, "NAR"[k % 3], "OF"[k % 2], date(2014 + k % 3, 1 + k % 12, 1 + k % 28)) for k in range(LINES)]
    spark.createDataFrame(parts, PART).write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks of few rows, so that a small table already asks for many."""
    monkeypatch.setattr(domain, "dealt", partial(sizing.dealt, task_rows=TASK))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_number_of_parts_follows_the_rows(spark):
    few, least = spark.range(10).withColumn("k", F.col("id") % 7), spark.sparkContext.defaultParallelism
    assert sizing.dealt(few, ["k"], 10).rdd.getNumPartitions() == least
    made = sizing.dealt(few, ["k"], 1000 * least + 1, task_rows=100)
    assert made.rdd.getNumPartitions() == 10 * least + 1 and made.count() == 10


def test_a_fit_is_given_parts_of_bounded_rows(spark, tables, small_tasks):
    rows = model_queries._monthly(spark, tables)
    assert rows.rdd.getNumPartitions() == LINES // TASK
    cube, parts = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("lineitem", "part"))
    assert rows.count() == cube.select("l_partkey", F.year("l_shipdate"), F.month("l_shipdate")).distinct().count()
    assert rows.agg(F.sum("price")).first()[0] == pytest.approx(
        cube.select("l_partkey", F.year("l_shipdate"), F.month("l_shipdate")).distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).agg(F.sum("p_retailprice")).first()[0]
    )


def test_month_cells_are_dealt_by_cell(spark, tables, small_tasks):
    cells = model_queries._month_cells(spark, tables)
    assert cells.rdd.getNumPartitions() == LINES // TASK and "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
    where = F.col("p_size") != 4
    months = spark.read.parquet(f"{tables}/lineitem.parquet").join(spark.read.parquet(f"{tables}/part.parquet").where(where), F.col("l_partkey") == F.col("p_partkey"))
    assert cells.count() == months.select("l_partkey", F.year("l_shipdate"), F.month("l_shipdate")).distinct().count()


def test_products_are_dealt_by_cell(spark, tables, small_tasks):
    made = grid_queries.composite_catalogue(spark, tables)
    assert f", {LINES // TASK})" in made._jdf.queryExecution().executedPlan().toString()
    sums = {r.dataset: r.value for r in made.groupBy("dataset").agg(F.sum("value").alias("value")).collect()}
    names = F.element_at(F.array(*[F.lit(n) for n in grid_queries.DEALT]), (1 + (F.col("k1") + F.col("k2")) % len(grid_queries.DEALT)).cast("int"))
    want = {r.dataset: r.value for r in domain.cube(spark, tables).groupBy(names.alias("dataset")).agg(F.sum("value").alias("value")).collect()}
    assert sums["PPT"] == pytest.approx(want["PPT"]) and sums["MOD16"] == pytest.approx(0.1 * want["MOD16"])


def test_a_cover_repeated_for_its_years_is_not_broadcast(spark):
    water = spark.createDataFrame([(0, 0, 2014, 5, 2.0), (0, 1, 2014, 5, 4.0), (0, 1, 2015, 3, 9.0), (None, 1, 2015, 5, 9.0)], "row int, col int, year int, month int, value double")
    cover = spark.createDataFrame([(0, 0, 1), (0, 1, 3)], "row int, col int, value int").withColumn("year", F.explode(F.array(F.lit(2014), F.lit(2015))))
    used = cropstats.crop_use(water, cover)
    assert "Broadcast" not in used._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.crop, r.month, r.value) for r in used.collect()) == [("Corn", 5, 2.0), ("Rice", 5, 4.0)]


def test_monthly_values_meet_their_cells_before_the_months_are_made(spark):
    spec = grid.GridSpec(0.0, 10.0, 1.0, 1.0, 10, 10)
    cover = spark.createDataFrame([(2014, 0, 0, 1), (2014, 0, 1, 3), (2015, 0, 0, 0), (2014, 0, 1, 3)], "year int, row int, col int, value int")
    told = [("PPT", 2014, 1, 0, 0, 5.0), ("PPT", 2014, 2, 0, 0, None), ("PPT", 2015, 1, 0, 0, 7.0), ("PPT", 2014, 3, 0, 1, 8.0), ("TMAX", 2014, 2, 0, 0, 30.0), ("SWB_AWC", None, None, 0, 0, 0.5), ("PPT", None, 1, 0, 1, 6.0)]
    predictors = spark.createDataFrame(told, "dataset string, year int, month int, row int, col int, value double")
    frame = scoring.predictor_frame(cover, spec, predictors, ["PPT", "TMAX", "SWB_AWC"], [1, 2])
    assert frame.columns[:4] == ["year", "month", "row", "col"]
    lines = _plan(frame).splitlines()
    at = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert at("Generate explode") < at("Join LeftOuter")
    got = sorted((r.year, r.month, r.row, r.col, r.PPT, r.TMAX, r.SWB_AWC) for r in frame.na.fill(-1.0).collect())
    one, two = (2014, 1, 0, 1, -1.0, -1.0, -1.0), (2014, 2, 0, 1, -1.0, -1.0, -1.0)
    assert got == [
        (2014, 1, 0, 0, 5.0, -1.0, 0.5), one, one, (2014, 2, 0, 0, -1.0, 30.0, 0.5), two, two,
        (2015, 1, 0, 0, -1.0, -1.0, 0.5), (2015, 2, 0, 0, -1.0, -1.0, 0.5),
    ]
