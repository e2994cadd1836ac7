"""Cleaning: texts, important columns, fills, lists to flags, and what it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import q
from tessera.functions.ranks import quantiles
from tessera.operators.profile import missing_summary

NO_ANSWER = "no answer"


def clean_text(df: DataFrame, columns: list[str], fill: str = NO_ANSWER) -> DataFrame:
    """Trimmed lower-case texts; nulls and the words nan and none become ``fill``."""

    def one(name: str):
        t = F.lower(F.trim(q(name)))
        return F.coalesce(F.when(~t.isin("nan", "none", ""), t), F.lit(fill))

    return df.withColumns({c: one(c) for c in columns})


def drop_incomplete(df: DataFrame, important: list[str]) -> DataFrame:
    return df.dropna(subset=important)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: v[0] for c, v in quantiles(df, columns, [0.5]).items()}


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric nulls as the column's median (exact)."""
    m = medians(df, columns)
    return df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(m[c]).cast("double")) for c in columns})


def expand_lists(df: DataFrame, column: str, separator: str = ",", limit: int = 200) -> DataFrame:
    """0/1 columns column__value for the values of a list column, in order of value.

    ``limit`` bounds the width of a plan: more distinct values raise an error, none are dropped.
    """
    items = F.transform(F.split(q(column), separator), lambda x: F.lower(F.trim(x)))
    values = [r[0] for r in df.select(F.explode(items).alias("v")).where("v <> ''").distinct().orderBy("v").limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values: too many for columns, use explode")
    return df.select("*", *[F.coalesce(F.array_contains(items, v), F.lit(False)).cast("int").alias(f"{column}__{v}") for v in values])


def change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing values of each column before and after, with the rows of both (column ``*``: all cells)."""
    side = lambda df, x: missing_summary(df).select("column", F.col("missing").alias(f"missing_{x}"), F.col("cells").alias(f"cells_{x}"))
    return side(before, "before").join(side(after, "after"), "column", "full")
