"""Exact quantiles by group, by one path for groups of every size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwater.functions.sizing import attach
from fieldwater.session import cut_lineage

# The sketch answers a rank within one part in so many. A group of no more rows
# is its own bracket, as the sketch couldn't narrow it.
ACCURACY = 10_000


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], accuracy: int = ACCURACY
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` by ``keys`` (one row per group).

    NULL and NaN are missing and ignored; infinities are values like others, and
    the middle of an infinity and a number is that infinity.

    A sketch brackets the wanted ranks of every group (``approx_percentile``,
    merged on the map side). The rows are then counted: by value inside a
    bracket, as one number between brackets. Cut points thus come from the data,
    so infinities and heavy tails cost nothing extra, repeated values collapse,
    and the last step ranks a few ten-thousandths of a large group.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    number = F.col(value).cast("double")
    base = cut_lineage(df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    facts = cut_lineage(_brackets(base, sizes, keys, sorted(set(probs)), accuracy))
    tagged = attach(base, facts.select(*keys, "_low", "_high"), keys)
    counted = _counted(tagged, keys)
    ranked = attach(counted, facts.select(*keys, "_n"), keys) if keys else counted.withColumn("_n", facts.select("_n").scalar())
    return ranked.groupBy(*keys).agg(*[_pick(p, n) for p, n in zip(probs, names)])


def _brackets(base: DataFrame, sizes: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """(keys, _n, _low, _high): for every wanted share, values that its two neighbouring ranks lie between."""
    slack = 4.0 / accuracy
    ends = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_ends")
    large = sizes.where(F.col("_n") > accuracy)
    if keys:
        told = attach(base, large.select(*keys, F.lit(True).alias("_large")), keys).groupBy(*keys).agg(sketch)
        facts = attach(sizes, told, keys, "left")
    else:
        facts = sizes.where(F.col("_n") > 0).withColumn("_ends", base.agg(sketch).scalar())
    m = len(probs)
    use = F.col("_n") > accuracy
    pick = lambda first, whole: F.when(use, F.slice("_ends", first, m)).otherwise(F.array_repeat(F.col(whole), m))
    return facts.select(*keys, "_n", pick(1, "_least").alias("_low"), pick(m + 1, "_most").alias("_high"))


def _counted(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _v, _first, _last): the ranks each value inside a bracket takes; _v is NULL for the rows between brackets."""
    inside = F.exists(F.arrays_zip("_low", "_high"), lambda b: F.col("_v").between(b["_low"], b["_high"]))
    below = F.size(F.filter("_high", lambda h: h < F.col("_v")))
    rows = tagged.select(*keys, "_v", inside.alias("_in"), F.when(~inside, below).alias("_gap"))
    counts = rows.groupBy(*keys, F.when(F.col("_in"), F.col("_v")).alias("_at"), "_gap").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from")
    )
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_from").rowsBetween(W.unboundedPreceding, W.currentRow))
    return counts.select(*keys, F.col("_at").alias("_v"), (upto - F.col("_c") + 1).alias("_first"), upto.alias("_last"))


def _pick(p: float, name: str) -> Column:
    """The value at share p, between the two ranks next to it."""
    position = (F.col("_n") - 1) * F.lit(p)
    at = lambda rank: F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col("_v")))
    lo, hi = at(F.floor(position) + 1), at(F.ceil(position) + 1)
    part = F.max(position - F.floor(position))
    infinite = lambda c: F.abs(c) == F.lit(float("inf"))
    between = (
        F.when((part == 0) | (lo == hi) | infinite(lo), lo)
        .when(infinite(hi), hi)
        .when(infinite(hi - lo), lo * (1 - part) + hi * part)
        .otherwise(lo + part * (hi - lo))
    )
    lost = F.max("_n").isNotNull() & (lo.isNull() | hi.isNull())
    return F.when(lost, F.raise_error(F.lit("a wanted rank is outside its bracket"))).otherwise(between).alias(name)
