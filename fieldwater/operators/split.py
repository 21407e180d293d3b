"""Train/test splits, folds and samples. Sizes are exact and independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.operators.ranking import hash_cut, hash_rank

TRAIN, TEST = "TRAIN", "TEST"


def _label(df: DataFrame, flag: str, split_col: str) -> DataFrame:
    return df.withColumn(split_col, F.when(F.col(flag), TEST).otherwise(TRAIN)).drop(flag)


def split_ratio(
    df: DataFrame, strata: Sequence[str], key: str, test_size: float = 0.2, seed: int = 0, split_col: str = "DATA"
) -> DataFrame:
    """Hold out ceil(n * test_size) rows of every stratum."""
    flagged = hash_cut(df, strata, key, seed, lambda n: F.ceil(n * F.lit(float(test_size))), "_test")
    return _label(flagged, "_test", split_col)


def split_years(
    df: DataFrame, test_years: Sequence[int] = (2016,), year_col: str = "Year", split_col: str = "DATA"
) -> DataFrame:
    """Hold out whole years. Row order carries no meaning, so nothing is shuffled."""
    flagged = df.withColumn("_test", F.coalesce(F.col(year_col).isin(list(test_years)), F.lit(False)))
    return _label(flagged, "_test", split_col)


def split_random(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 0, split_col: str = "DATA"
) -> DataFrame:
    """Hold out ceil(n * test_size) rows of the whole table."""
    return split_ratio(df, [], key, test_size, seed, split_col)


def split_train_test(
    df: DataFrame,
    key: str,
    strategy: int = 2,
    test_size: float = 0.2,
    test_years: Sequence[int] | bool | None = None,
    year_col: str = "Year",
    crop_col: str | None = None,
    seed: int = 0,
    split_col: str = "DATA",
) -> DataFrame:
    """Pick a split: 1 holds out ``test_years``; 2 holds out a ratio of each year when
    ``test_years`` is given and of each crop otherwise; anything else is random."""
    if strategy == 1:
        return split_years(df, test_years or (2016,), year_col, split_col)
    if strategy == 2:
        stratum = year_col if test_years or crop_col is None else crop_col
        return split_ratio(df, [stratum], key, test_size, seed, split_col)
    return split_random(df, key, test_size, seed, split_col)


def sample_per_group(df: DataFrame, groups: Sequence[str], key: str, n: int = 500, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows of every group, or the whole group when it is smaller."""
    chosen = hash_cut(df, groups, key, seed, lambda total: F.lit(n), "_in")
    return chosen.where("_in").drop("_in")


def repeated_folds(
    df: DataFrame, key: str, folds: int = 5, repeats: int = 3, strata: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """Add one column ``fold_<i>`` per repeat; fold sizes in a stratum differ by at most one."""
    out = df
    for i in range(repeats):
        ranked = hash_rank(out, list(strata), key, seed + i, "_rank")
        out = ranked.withColumn(f"fold_{i}", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")
    return out
