"""Value frequencies of whole tables: long texts are counted by their hashes, so only short keys are shuffled.

A value of more than SHORT characters is its first SHORT characters and 128 bits of hash.  Distinct values, entropies and the like need
no more.  The k most frequent values are found by those keys first; a second pass then reads the texts of the few candidates
that are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import per_column, q, text_rows
from .tables import written

#: Characters of a value that is counted as it is.
SHORT = 64
KEY = ["column", "head", "h1", "h2"]


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, head, h1, h2) of non-null values; the hashes are null for short ones."""
    long = F.length("value") > SHORT
    rows = text_rows(df, columns).where(F.col("value").isNotNull())
    return rows.select("column", "value", F.substring("value", 1, SHORT).alias("head"), F.when(long, F.xxhash64("value")).alias("h1"), F.when(long, F.xxhash64(F.lit(1), "value")).alias("h2"))


def hashed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, head, h1, h2, n): a row for each distinct value, without the texts of long ones."""
    return _keyed(df, columns).groupBy(*KEY).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique) of the columns that have a value."""
    return hashed_counts(df, columns).groupBy("column").agg(F.count("*").alias("n_unique"))


def most_frequent(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, rank, value, n, total): the k most frequent values of each column, ties by value; ``total`` counts its values."""
    counts = written(hashed_counts(df, columns), "frequencies")
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    # All that are tied by frequency and head with the k-th one are candidates.
    first = F.rank().over(Window.partitionBy("column").orderBy(F.desc("n"), "head"))
    near = written(counts.withColumn("place", first).where(F.col("place") <= k).drop("place"), "candidates")
    found = near.where("h1 IS NULL").select("column", F.col("head").alias("value"), "n")
    long = near.where("h1 IS NOT NULL")
    if not long.isEmpty():
        keys = long.select(*[F.col(c).alias(f"_{c}") for c in KEY], "n")
        same = (F.col("column") == F.col("_column")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
        texts = _keyed(df, columns).where("h1 IS NOT NULL").join(keys, same).groupBy(*KEY, "n").agg(F.min("value").alias("value"))
        found = found.unionByName(texts.select("column", "value", "n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(F.broadcast(total), "column").select("column", "rank", "value", "n", "total")  # totals: a row for each column


def smallest_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, smallest): the k smallest distinct values of each column as texts, in order; a pass for each rank, no shuffle of values."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for _ in range(k):
        open_ = [c for c in columns if len(found[c]) == max(map(len, found.values()))]

        def least(c: str) -> Column:
            x = q(c).cast("string")
            return F.min(F.when(x > found[c][-1], x) if found[c] else x)

        row = df.agg(*[least(c).alias(str(i)) for i, c in enumerate(open_)]).first()
        if all(v is None for v in row):
            break
        for c, v in zip(open_, row, strict=True):
            if v is not None:
                found[c].append(v)
    return df.sparkSession.createDataFrame([(c, v) for c, v in found.items()], "column string, smallest array<string>")


def value_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_unique): rows of the table and distinct values, zero where a column has none."""
    rows = per_column(df, columns, n_rows=lambda c: F.count(F.lit(1)))
    return rows.join(F.broadcast(distinct_values(df, columns)), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)).cast("long"))
