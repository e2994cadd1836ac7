"""Time: sums by period, decomposition, rolling outliers, calendar features, cohorts, survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.columns import q
from tessera.functions.ranks import blocked, ranged, running
from tessera.functions.tables import written

PERIODS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def period_sums(df: DataFrame, date: str, value: str, period: str = "D") -> DataFrame:
    """Sum by day, week (from Monday), month, quarter or year; observed periods only."""
    at = F.date_trunc(PERIODS[period], q(date)).cast("date")
    return df.where(q(date).isNotNull() & q(value).isNotNull()).groupBy(at.alias("period")).agg(F.sum(q(value).cast("double")).alias("value"))


def _centred(series: DataFrame, width: int) -> tuple[DataFrame, WindowSpec]:
    """A series in blocks with halos, and the frame of ``width`` rows around each of its rows."""
    half = width // 2
    return blocked(series, "period", half), Window.partitionBy("block").orderBy("pos").rowsBetween(-half, half)


def decompose(series: DataFrame, season: int = 7) -> DataFrame:
    """Trend (centered moving average), seasonal part by position, and the rest of (period, value).

    Frames run within blocks that hold the rows of their neighbours they need: no window over the whole series.  Under ten periods there is no result.
    """
    rows, frame = _centred(series.select("period", "value"), season)
    n = series.agg(F.count("*").alias("n"))
    s = rows.withColumns({"k": F.count("*").over(frame), "ma": F.avg("value").over(frame)}).where("is_own").crossJoin(n).where("n >= 10")  # one row
    s = written(s.select("period", "value", F.when(F.col("k") == season, F.col("ma")).alias("trend"), (F.col("pos") % season).alias("slot")), "trend")
    means = s.where("trend IS NOT NULL").groupBy("slot").agg(F.avg(F.col("value") - F.col("trend")).alias("m"))
    centered = means.select("slot", (F.col("m") - F.avg("m").over(Window.partitionBy())).alias("seasonal"))  # a row for each position
    return s.join(F.broadcast(centered), "slot", "left").select("period", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def rolling_outliers(series: DataFrame, width: int = 7, threshold: float = 3.0) -> DataFrame:
    """Periods whose value is ``threshold`` rolling deviations from the rolling mean (within 7 rows at most 2.27)."""
    rows, frame = _centred(series.select("period", "value"), width)
    z = (F.col("value") - F.avg("value").over(frame)) / F.nullif(F.stddev_samp("value").over(frame), F.lit(0.0))
    return rows.withColumns({"k": F.count("*").over(frame), "z": z}).where((F.col("k") == width) & (F.abs("z") > threshold) & F.col("is_own")).select("period", "value", "z")


def outcome_by_time(df: DataFrame, date: str, outcome: str, periods: str = "YQMW") -> DataFrame:
    """Mean outcome by year, quarter, month and week: each row counted once a period by one grouping pass."""
    stamps = F.array(*[F.struct(F.lit(p).alias("unit"), F.date_trunc(PERIODS[p], q(date)).cast("date").alias("period")) for p in periods])
    rows = df.where(q(date).isNotNull()).select(F.inline(stamps), q(outcome).cast("double").alias("y"))
    return rows.groupBy("unit", "period").agg(F.avg("y").alias("mean"), F.count("y").alias("n"))


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Year, month, day and weekday (Monday 0) of a date beside the other columns."""
    return df.withColumns({f"{date}_{n}": fn(q(date)).cast("int") for n, fn in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("dayofweek", F.weekday))})


def cohort_retention(df: DataFrame, user: str, date: str, period: str = "M") -> DataFrame:
    """Distinct users of each cohort (first period) by periods since then, and their share of the cohort's first.

    Rows are made distinct by (user, period) before anything else, so that busy users weigh no more than others.
    """
    at = F.trunc(q(date), "month") if period == "M" else F.to_date(q(date))
    active = df.where(q(user).isNotNull() & q(date).isNotNull()).select(q(user).alias("user"), at.alias("at")).distinct()
    first = active.groupBy("user").agg(F.min("at").alias("cohort"))
    since = F.months_between("at", "cohort").cast("int") if period == "M" else F.datediff("at", "cohort")
    counts = active.join(first, "user").groupBy("cohort", since.alias("period_number")).agg(F.count("*").alias("users"))
    base = counts.where("period_number = 0").select("cohort", F.col("users").alias("size"))
    return counts.join(F.broadcast(base), "cohort").select("cohort", "period_number", "users", (F.col("users") / F.col("size")).alias("retention"))


def kaplan_meier(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Survival at each time with an event: at risk, events and the running product, over distinct times dealt by range.

    Products run as sums of logarithms; a time at which all at risk have the event ends them at 0.
    """
    t = df.where(q(duration).isNotNull()).groupBy(q(duration).cast("double").alias("time")).agg(F.count("*").alias("n"), F.count_if(q(event) == 1).alias("events"))
    s = running(ranged(t, "time"), "time", {"at_risk": "n"}, descending=True)
    left = 1 - F.col("events") / F.col("at_risk")
    s = s.withColumns({"all": (left == 0).cast("long"), "log": F.when(left > 0, F.log(left)).otherwise(0.0)})
    s = running(s, "time", {"logs": "log", "ended": "all"})
    return s.where("events > 0").select("time", "at_risk", "events", F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("logs")).alias("survival"))
