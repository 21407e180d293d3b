"""Running meter tables on Structured Streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.operators.clean import clean_rows


def event_time(readings: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; Parquet may deliver one without a zone."""
    return readings.withColumn(ts, F.col(ts).cast("timestamp"))


def running_daily_totals(
    readings: DataFrame, site: str = "site", ts: str = "ts", value: str = "value", late: str = "2 days"
) -> DataFrame:
    """Daily totals per site so far, for update mode: each batch gives the days it changed.

    A day's state is dropped once the watermark has passed its end, so what is
    kept does not grow with the age of the stream. Readings later than ``late``
    are dropped; ``DayLog`` counts readings however late they come.
    """
    rows = clean_rows(event_time(readings, ts).select(site, ts, value)).where(F.col(value) >= 0)
    grouped = rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("_w"), site).agg(F.sum(value).alias(value))
    return grouped.select(site, F.to_date("_w.start").alias("day"), value)


def daily_changes(readings: DataFrame, site: str = "site", ts: str = "ts", value: str = "value") -> DataFrame:
    """(site, day, value) of every usable reading of a stream, for a ``DayLog``."""
    rows = clean_rows(event_time(readings, ts).select(site, ts, value)).where(F.col(value) >= 0)
    return rows.select(site, F.to_date(ts).alias("day"), value)


@dataclass(frozen=True)
class DayLog:
    """Totals per site and day of a stream whose readings may come late, early and in any number of batches.

    A batch only says what it adds: its rows are summed by site and day and
    written under the batch's number, so a batch that is repeated after a
    failure replaces itself and no total is counted twice. Totals are sums over
    the log. Finished days need no state and are corrected whenever a reading
    for them comes.

    Every ``compact_every`` batches the log is merged into a base, which counts
    once its success marker is written. A base is built from the one before it and the changes
    since, never from itself, so that a repeated batch makes the same base. What
    the new base replaces is kept until the next one, for readers under way.
    """

    path: str
    site: str = "site"
    value: str = "value"
    compact_every: int = 32

    def write(self, batch: DataFrame, number: int) -> None:
        """The ``foreachBatch`` sink; rows are (site, day, value)."""
        days = batch.groupBy(self.site, "day").agg(F.sum(self.value).alias(self.value), F.count("*").alias("readings"))
        days.write.mode("overwrite").parquet(f"{self.path}/changes/{number}")
        if (number + 1) % self.compact_every == 0:
            self._compact(batch.sparkSession, number)

    def _folder(self, spark: SparkSession, path: str):
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _finished(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the written bases or changes."""
        there, files = self._folder(spark, f"{self.path}/{kind}")
        if not files.exists(there):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(there)]
        return sorted(int(n) for n in names if files.exists(self._folder(spark, f"{self.path}/{kind}/{n}/_SUCCESS")[0]))

    def _sources(self, spark: SparkSession, upto: int | None, below: int | None = None) -> tuple[int, list[str]]:
        """The number of the base in use, -1 without one, and the folders whose sum is the table."""
        base = max([n for n in self._finished(spark, "base") if below is None or n < below], default=-1)
        after = [n for n in self._finished(spark, "changes") if n > base and (upto is None or n <= upto)]
        return base, [f"{self.path}/base/{base}"] * (base >= 0) + [f"{self.path}/changes/{n}" for n in after]

    def _compact(self, spark: SparkSession, number: int) -> None:
        former, folders = self._sources(spark, number, below=number)
        self._summed(spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{self.path}/base/{number}")
        for kind in ("changes", "base"):
            for n in self._finished(spark, kind):
                if n < former or (kind == "changes" and n == former):
                    there, files = self._folder(spark, f"{self.path}/{kind}/{n}")
                    files.delete(there, True)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.site, "day").agg(F.sum(self.value).alias(self.value), F.sum("readings").alias("readings"))

    def days(self, spark: SparkSession) -> DataFrame:
        """(site, day, value, readings) as of the last written batch; an error before the first."""
        folders = self._sources(spark, None)[1]
        if not folders:
            raise ValueError(f"{self.path} holds no batch yet")
        return self._summed(spark.read.parquet(*folders))

    def months(self, spark: SparkSession) -> DataFrame:
        """(site, month, value): the running monthly totals."""
        return self.days(spark).groupBy(self.site, F.trunc("day", "month").alias("month")).agg(F.sum(self.value).alias(self.value))


def append_updates(path: str):
    """A ``foreachBatch`` sink that keeps every batch's rows with its number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def monthly_totals_so_far(updates: DataFrame, site: str = "site", value: str = "value", batch: str = "batch") -> DataFrame:
    """Monthly totals per site from written updates: of every day, what the last batch said."""
    days = updates.groupBy(site, "day").agg(F.max_by(value, batch).alias(value))
    return days.groupBy(site, F.trunc("day", "month").alias("month")).agg(F.sum(value).alias(value))


def daily_totals(readings: DataFrame, site: str = "site", ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Finished daily totals per site, for append mode; readings later than ``late`` are dropped."""
    rows = clean_rows(event_time(readings, ts).select(site, ts, value)).where(F.col(value) >= 0)
    grouped = rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("_w"), site).agg(F.sum(value).alias(value))
    return grouped.select(site, F.to_date("_w.start").alias("day"), value)


def deduplicated_with_sites(
    readings: DataFrame, sites: DataFrame, key: str = "event_id", site: str = "site", ts: str = "ts", late: str = "2 days"
) -> DataFrame:
    """Readings seen once within the watermark, joined to the static site table."""
    once = event_time(readings, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return once.join(sites, site)
