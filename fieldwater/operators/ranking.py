"""Exact hash-ordered ranks and cuts without a one-task window.

Rows are ordered by ``md5(seed|key)`` (ties by key) inside a stratum. A prefix
of the hash splits every stratum into equal buckets, so even a stratum holding
most of the table is ranked by thousands of independent tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.functions.sizing import attach, measured

PREFIX_DIGITS = 3  # 16^3 buckets per stratum


def hash_of(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _bucketed(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    hashed = df.withColumn("_h", hash_of(F.col(key), seed))
    return hashed.withColumn("_b", F.substring("_h", 1, PREFIX_DIGITS))


def _bucket_offsets(hashed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows (strata, bucket): rows in the bucket, rows before it, rows in the stratum."""
    counts = hashed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*strata)
    return counts.select(
        *strata,
        "_b",
        "_n",
        (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


def hash_rank(
    df: DataFrame, strata: Sequence[str], key: str, seed: int | str, rank: str = "rank", total: str | None = None
) -> DataFrame:
    """Add the 1-based rank of each row in hash order within its stratum."""
    hashed = _bucketed(df, key, seed)
    offsets = measured(_bucket_offsets(hashed, strata).drop("_n"))
    inner = W.partitionBy(*strata, "_b").orderBy("_h", key)
    placed = attach(hashed.withColumn("_r", F.row_number().over(inner)), offsets, [*strata, "_b"])
    placed = placed.withColumn(rank, F.col("_before") + F.col("_r"))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_h", "_b", "_r", "_before", "_total")


def hash_cut(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    seed: int | str,
    size: Callable[[Column], Column],
    flag: str = "selected",
) -> DataFrame:
    """Flag the first ``size(n)`` rows of every stratum in hash order; ``n`` is its row count.

    Only the bucket holding the cut is ranked. It yields one threshold per
    stratum, and every row is then compared with it where it lies, so the
    table itself is not shuffled.
    """
    hashed = _bucketed(df, key, seed)
    wanted = F.least(size(F.col("_total")).cast("bigint"), F.col("_total"))
    offsets = _bucket_offsets(hashed, strata).withColumn("_k", wanted)
    cut = measured(
        offsets.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
        .select(*strata, "_b", (F.col("_k") - F.col("_before")).alias("_left"))
    )
    slim = hashed.select(*strata, "_b", "_h", F.col(key).alias("_key"))
    order = W.partitionBy(*strata, "_b").orderBy("_h", "_key")
    at_cut = attach(slim, cut, [*strata, "_b"]).withColumn("_r", F.row_number().over(order))
    thresholds = measured(
        at_cut.where(F.col("_r") == F.col("_left")).select(
            *strata, F.col("_h").alias("_cut_h"), F.col("_key").alias("_cut_key")
        )
    )
    compared = attach(hashed, thresholds, strata, "left")
    chosen = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
    return compared.withColumn(flag, F.coalesce(chosen, F.lit(False))).drop("_h", "_b", "_cut_h", "_cut_key")
