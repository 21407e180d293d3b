"""Feature columns: indicators over a fixed vocabulary, min-max scaling, assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = tuple(range(1, 13))
# More distinct values than this is not a category and is refused.
VOCABULARY_LIMIT = 1000


def vocabulary(df: DataFrame, column: str, most: int = VOCABULARY_LIMIT) -> list:
    """Sorted distinct values of a category. More than ``most`` are refused, nothing is cut off."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return sorted(values)


def indicator_name(column: str, value) -> str:
    """Column name of one class. A whole number loses its decimals; dots would read as field access."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return f"{column}_{value}".replace(".", "_")


def one_hot(df: DataFrame, vocabularies: Mapping[str, Sequence], drop: bool = True) -> DataFrame:
    """Replace each category by 0/1 columns over its vocabulary; classes outside it give all zeros.

    The vocabulary is fixed on the training rows, so every table gets the same columns.
    """
    made = {
        indicator_name(c, v): F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
        for c, values in vocabularies.items()
        for v in values
    }
    out = df.withColumns(made)
    return out.drop(*vocabularies) if drop else out


def undo_one_hot(df: DataFrame, column: str, values: Sequence) -> Column:
    """The class whose indicator is 1, NULL when none is."""
    return F.coalesce(*[F.when(F.col(f"`{indicator_name(column, v)}`") == 1, F.lit(v)) for v in values])


class MinMaxScaler:
    """Min-max scaling held as a table (feature, lo, hi) and applied as column arithmetic.

    A constant feature scales to 0.
    """

    def __init__(self, limits: Mapping[str, tuple[float, float]]):
        self.limits = dict(limits)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> MinMaxScaler:
        """One aggregation; the result is two numbers per feature."""
        aggregates = []
        for i, c in enumerate(columns):
            value = F.col(f"`{c}`").cast("double")
            aggregates += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
        row = df.agg(*aggregates).first()
        return cls({c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)})

    def _span(self, name: str) -> float:
        lo, hi = self.limits[name]
        return (hi - lo) or 1.0

    def scale(self, name: str, value: Column) -> Column:
        return (value - self.limits[name][0]) / self._span(name)

    def unscale(self, name: str, value: Column) -> Column:
        return value * self._span(name) + self.limits[name][0]

    def unscale_error(self, name: str, error: Column) -> Column:
        """An error or residual has no offset: only the span applies."""
        return error * self._span(name)

    def transform(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return df.withColumns({c: self.scale(c, F.col(f"`{c}`")) for c in self.limits if c in present})

    def inverse(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return df.withColumns({c: self.unscale(c, F.col(f"`{c}`")) for c in self.limits if c in present})

    def table(self, spark) -> DataFrame:
        rows = [(c, float(lo), float(hi)) for c, (lo, hi) in self.limits.items()]
        return spark.createDataFrame(rows, "feature string, lo double, hi double")

    @classmethod
    def from_table(cls, table: DataFrame) -> MinMaxScaler:
        """All saved features, which are columns of one table; a feature saved twice is refused."""
        rows = table.collect()
        limits = {r["feature"]: (r["lo"], r["hi"]) for r in rows}
        if len(limits) != len(rows):
            raise ValueError("a feature is saved more than once")
        return cls(limits)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector in alphabetical column order, so training and prediction line up."""
    assembler = VectorAssembler(inputCols=sorted(columns), outputCol=out, handleInvalid="error")
    return assembler.transform(df)
