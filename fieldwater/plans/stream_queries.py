"""Driver-table queries: the metering operators on a stream of the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwater.plans import domain
from fieldwater.plans.domain import VIEW as V
from fieldwater.plans.registry import query
from fieldwater.streaming import meters


def _events(spark, d):
    schema = domain.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return raw.select("event_id", F.col("user_id").alias("site"), "ts", F.col("event_type").alias("crop"), "value")


def _drain(writer, name: str, spark):
    """Run a stream over everything available and wait for its end."""
    run = writer.trigger(availableNow=True).option("checkpointLocation", domain.scratch(spark, f"{name}-state")).start()
    run.awaitTermination()


@query("stream_monthly", f"""
    select site, cast(year(ts) as int) as yr, cast(month(ts) as int) as mon, round(sum(value), 4) as wu
    from {V['reading']} q where value >= 0 group by 1, 2, 3""")
def stream_monthly(spark, d):
    """Running monthly totals over readings that come shuffled, in eight batches, long after their days."""
    path = domain.scratch(spark, "stream-monthly")
    events = domain.table(spark, d, "events")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(f"{path}/events")
    shuffled = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
    log = meters.DayLog(f"{path}/days", compact_every=3)
    changes = meters.daily_changes(shuffled.withColumnRenamed("user_id", "site"))
    _drain(changes.writeStream.foreachBatch(log.write), "monthly", spark)
    return log.months(spark).select("site", F.year("month").alias("yr"), F.month("month").alias("mon"), F.round("value", 4).alias("wu"))


@query("stream_daily", f"""
    select site, cast(cast(ts as date) as varchar) as day, round(sum(value), 4) as wu from {V['reading']} q
    where value >= 0 and cast(ts as date) + interval 1 day <= (select max(ts) - interval 2 day from {V['reading']} z where value >= 0)
    group by 1, 2""")
def stream_daily(spark, d):
    """Finished days only: a day is written once the watermark has passed its end."""
    path = domain.scratch(spark, "stream-daily")
    writer = meters.daily_totals(_events(spark, d)).writeStream.outputMode("append").format("parquet").option("path", path)
    _drain(writer, "daily", spark)
    made = spark.read.parquet(path)
    return made.select("site", F.col("day").cast("string").alias("day"), F.round("value", 4).alias("wu"))


@query("stream_sites", f"""
    select q.event_id, q.site, s.crop as segment, q.value from {V['reading']} q join {V['site']} s on q.site = s.site""")
def stream_sites(spark, d):
    """Every reading twice on the stream, seen once and joined to the static sites."""
    path = domain.scratch(spark, "stream-sites")
    events = _events(spark, d)
    doubled = events.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    static = domain.sites(spark, d).select("site", F.col("crop").alias("segment"))
    joined = meters.deduplicated_with_sites(doubled, static)
    writer = joined.select("event_id", "site", "segment", "value").writeStream.outputMode("append").format("parquet").option("path", path)
    _drain(writer, "sites", spark)
    return spark.read.parquet(path)
