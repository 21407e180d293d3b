"""Day totals of a stream whose readings come late and in many batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldwater.streaming import meters

SCHEMA = "site string, ts timestamp, value double"


def readings(count=600, seed=2):
    draw = random.Random(seed)
    start = datetime.datetime(2020, 1, 1)
    rows = [(draw.choice("abc"), start + datetime.timedelta(minutes=draw.randrange(150 * 1440)), float(draw.randrange(100))) for _ in range(count)]
    return [*rows, ("a", start, -5.0), ("a", start, None), ("b", None, 3.0), ("c", start, float("nan"))]


def monthly(rows):
    made = {}
    for site, ts, value in rows:
        if ts is not None and value is not None and value >= 0:
            key = site, datetime.date(ts.year, ts.month, 1)
            made[key] = made.get(key, 0.0) + value
    return made


def found(log, spark):
    return {(r.site, r.month): r.value for r in log.months(spark).collect()}


def feed(spark, log, rows, number):
    log.write(meters.daily_changes(spark.createDataFrame(rows, SCHEMA)), number)


@pytest.mark.parametrize("every", [1, 2, 3, 100])
def test_many_batches_in_any_order_add_up(spark, tmp_path, every):
    rows, log = readings(), meters.DayLog(f"{tmp_path}/log", compact_every=every)
    for k in range(7):
        feed(spark, log, rows[k::7], k)
        assert found(log, spark) == monthly([r for j in range(k + 1) for r in rows[j::7]])
    # The log doesn't grow with the batches.
    assert len(log._finished(spark, "base")) <= 2 and len(log._finished(spark, "changes")) <= max(2 * every, 2) or every == 100


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rows, log = readings(90), meters.DayLog(f"{tmp_path}/log", compact_every=2)
    for k, number in enumerate((0, 0, 1, 1, 1, 2, 3, 3, 4)):
        feed(spark, log, rows[number::5], number)
    assert found(log, spark) == monthly(rows)


def test_a_base_without_marker_is_not_read(spark, tmp_path):
    rows, log = readings(60), meters.DayLog(f"{tmp_path}/log", compact_every=2)
    for number in range(3):
        feed(spark, log, rows[number::3], number)
    spark.createDataFrame([("a", datetime.date(2020, 1, 1), 1e9, 1)], "site string, day date, value double, readings long").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{tmp_path}/log/base/2")
    assert found(log, spark) == monthly(rows)


def test_late_readings_correct_finished_days(spark, tmp_path):
    rows = sorted([r for r in readings(300) if r[1] is not None], key=lambda r: r[1], reverse=True)
    for k in range(5):
        spark.createDataFrame(rows[k::5] if k else rows[:10], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = meters.DayLog(f"{tmp_path}/log", compact_every=2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = meters.daily_changes(stream).writeStream.foreachBatch(log.write).trigger(availableNow=True)
    run.option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    assert max(log._finished(spark, "changes")) == 4
    assert found(log, spark) == monthly(rows[:10] + [r for k in range(1, 5) for r in rows[k::5]])


def test_nothing_written(spark, tmp_path):
    with pytest.raises(ValueError):
        meters.DayLog(f"{tmp_path}/none").days(spark)
    log = meters.DayLog(f"{tmp_path}/log", compact_every=1)
    feed(spark, log, [], 0)
    assert log.days(spark).count() == 0 == log.months(spark).where(F.lit(True)).count()
