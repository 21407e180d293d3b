"""Join helpers that broadcast only what has been measured."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and found at or below
# this bound. The frames joined this way have a handful of numeric columns, so
# the bound stays near ten megabytes.
BROADCAST_ROWS = 100_000
# Rows that one task of a dealt frame is given, on average.
TASK_ROWS = 250_000


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute ``df`` once and mark it for broadcast when it is small enough.

    The frame is persisted (memory, then disk) so the count and the later join
    share one computation. Beyond the bound the frame comes back without a
    hint and Spark joins it by shuffle, splitting skewed keys at run time.
    """
    kept = df.persist()
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def dealt(df: DataFrame, keys: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows by the hash of ``keys`` into partitions whose number follows ``rows``.

    The session's shuffle partitions are one number for tables of every size,
    and merging weighs compressed bytes. Here a task is given the same share
    however large the table is, and what is grouped or joined by the keys
    afterwards needs no further shuffle.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-rows // task_rows)), *keys)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality over the named columns of both frames."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group facts to rows. NULL group keys match each other.

    ``facts`` holds one row per group. With no keys it holds exactly one row,
    whose columns are added as scalar subqueries.
    """
    if not keys:
        names = facts.columns
        return rows.withColumns({c: facts.select(c).scalar() for c in names})
    renamed = facts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return rows.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])
