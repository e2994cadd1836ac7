"""Descriptive tables and what charts need: frequencies, dates, histograms, boxes, samples, two-level counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import q
from tessera.functions.ranks import gaps, quantiles


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins have 0. A constant gets a range of 1."""
    x = q(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    w = (hi - lo) / bins
    found = df.where(x.isNotNull()).groupBy(F.least(F.floor((x - lo) / w), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(found), "bin", "left").select("bin", (F.col("bin") * w + lo).alias("lo"), ((F.col("bin") + 1) * w + lo).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box(df: DataFrame, column: str, outliers: int = 200) -> DataFrame:
    """Quartiles, and as rows of their own the ``outliers`` values farthest from the median, outside the fences."""
    x = q(column).cast("double")
    a, m, b = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    spark = df.sparkSession
    quartiles = spark.createDataFrame([("q1", a), ("median", m), ("q3", b)], "part string, value double")
    if a is None:
        return quartiles
    far = df.select(x.alias("value")).where((F.col("value") < a - 1.5 * (b - a)) | (F.col("value") > b + 1.5 * (b - a)))
    return quartiles.unionByName(far.orderBy(F.desc(F.abs(F.col("value") - m)), "value").limit(outliers).select(F.lit("outlier").alias("part"), "value"))


def sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``rows`` rows in the order of a hash of the key: the same ones on every run and partitioning."""
    return df.orderBy(F.xxhash64(q(key)), q(key)).limit(rows)


def two_levels(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of pairs and, with a null second level, of first levels: one pass by rollup."""
    found = df.where(q(first).isNotNull() & q(second).isNotNull()).rollup(q(first).alias("first"), q(second).alias("second")).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return found.where("level < 3").select("first", "second", "n")


def date_describe(df: DataFrame, column: str) -> DataFrame:
    """First and last time, span in days and how often values come by the median gap of whole days."""
    g = gaps(df, column).agg(F.percentile(F.floor(F.col("gap") / 86400), 0.5, F.col("n")).alias("median_gap"), F.max(F.floor(F.col("gap") / 86400)).alias("max_gap"))
    base = df.agg(F.count(q(column)).alias("n"), F.min(q(column)).cast("date").alias("first_day"), F.max(q(column)).cast("date").alias("last_day"))
    m = F.col("median_gap")
    often = F.when(m <= 1, "daily").when(m <= 7, "weekly").when(m <= 31, "monthly").otherwise(F.concat(m.cast("int").cast("string"), F.lit("-day")))
    return base.crossJoin(g).select("n", "first_day", "last_day", F.datediff("last_day", "first_day").alias("span_days"), "median_gap", F.col("max_gap").cast("long").alias("max_gap"), often.alias("frequency"))  # single rows


def date_shares(df: DataFrame, column: str) -> DataFrame:
    """Shares by weekday (Monday 0) and by month."""
    parts = [df.where(q(column).isNotNull()).groupBy(F.lit(name).alias("part"), fn(q(column)).cast("int").alias("value")).agg(F.count("*").alias("n")) for name, fn in (("weekday", F.weekday), ("month", F.month))]
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("part")))


def bins_of(c: Column, edges: list[float]) -> Column:
    """The right-closed bin of a value by inner edges in ascending order, from 0."""
    return reduce(lambda a, e: a + (c > e).cast("int"), edges, F.lit(0))
