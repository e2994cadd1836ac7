"""Shapes that many operators share: a row for each column, value counts, literals from one summary row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, DATES)]


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def per_column(df: DataFrame, columns: list[str], **metrics: Callable[[Column], Column]) -> DataFrame:
    """One aggregation over all columns, then a row (column, metrics...) for each: no pass for each column."""
    row = df.agg(*[fn(q(c)).alias(f"{i}_{m}") for i, c in enumerate(columns) for m, fn in metrics.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in metrics]) for i, c in enumerate(columns)])
    return row.select(F.inline(rows))


def text_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with every value as text."""
    return df.select(*[q(c).cast("string").alias(c) for c in columns]).unpivot([], [q(c) for c in columns], "column", "value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The value-frequency table (column, value, n) of non-null values: one shuffle of combined counts for all columns."""
    return text_rows(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def no_nan(c: Column) -> Column:
    """NaN and infinities as null: Spark takes NaN for a value."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def r6(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson's r over pairs without null; null, not an error, where one of the two doesn't vary."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("double"), b.cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)
