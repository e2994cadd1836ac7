"""Global order without one task: gaps, average ranks, running sums and exact quantiles.

Values are counted first, so ties cost one row.  Counts are dealt by range; each partition's totals (a row for a
partition) give the offsets, and windows run within partitions only.  Quantiles need no shuffle at all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import q
from .tables import written


def ranged(counts: DataFrame, column: str) -> DataFrame:
    """Rows dealt by ranges of ``column``, with ``part`` ascending with it; written, so that parts don't change."""
    return written(counts.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "ranged")


def _counted(df: DataFrame, column: str) -> DataFrame:
    """(value, n, part): distinct values dealt by range."""
    return ranged(df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(F.count("*").alias("n")), "value")


def gaps(df: DataFrame, column: str) -> DataFrame:
    """(gap, n): seconds between neighbouring times in order, with how many there are; equal times have gaps of 0."""
    counts = _counted(df.select(F.unix_seconds(q(column).cast("timestamp")).alias("t")), "t")
    # The last value before each partition: one row a partition.
    ends = counts.groupBy("part").agg(F.max("value").alias("last"))
    before = F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("part", before.alias("carried"))
    own = F.lag("value").over(Window.partitionBy("part").orderBy("value"))
    rows = counts.withColumn("previous", own).join(F.broadcast(carried), "part").withColumn("gap", F.col("value") - F.coalesce("previous", "carried"))
    steps = rows.where("gap IS NOT NULL").select("gap", F.lit(1).cast("long").alias("n"))
    ties = rows.where("n > 1").select(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n"))
    return steps.unionByName(ties).groupBy("gap").agg(F.sum("n").alias("n"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): each distinct value with the average rank of its ties, from 1."""
    counts = running(_counted(df, column), "value", {"upto": "n"})
    return counts.select("value", "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


#: Rows of a range that one task ranks: ranges become more with the rows, not larger, up to MOST_RANGES.  A shuffle to so many (Spark's
#: ``spark.shuffle.sort.bypassMergeThreshold``) writes each row straight to a file of its range; beyond, a task holds and sorts all rows
#: of the split that it deals, which are far more than those of a range.
RANGE_ROWS, MOST_RANGES = 200_000, 200


def _same(a: float, b: float) -> bool:
    """Equal as Spark orders doubles: NaN is a value."""
    return a == b or (math.isnan(a) and math.isnan(b))


def ranked_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows with ``rank`` (average of ties, from 1), ``ties`` (how many rows share the value) and ``is_first`` (one row of each value).

    Rows are dealt by ranges of the value and a number drawn for each row, so that a value of many rows is split over tasks
    evenly.  Ranks and ties are counted within a range; a row for each range tells what comes before it, and how many ties of
    its first and last value lie beyond its edges.  No join on values.  Rows without a value are left out.  A task ranks one range, in one
    sort: RANGE_ROWS rows while the number of ranges can follow the number of rows, one in MOST_RANGES of a larger table's rows.
    """
    rows = df.where(q(column).isNotNull()).withColumn("_x", q(column).cast("double"))
    ranges = min(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS)), MOST_RANGES)
    dealt = rows.withColumn("_salt", F.rand(17)).repartitionByRange(ranges, "_x", "_salt").drop("_salt")
    rows = written(dealt.withColumn("_part", F.spark_partition_id()), "ranked")
    sides = rows.groupBy("_part").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    at = lambda side: F.count_if(F.col("_x") == F.col(side)).alias(f"n_{side}")
    ends = rows.join(F.broadcast(sides), "_part").groupBy("_part", "lo", "hi").agg(F.count("*").alias("n"), at("lo"), at("hi")).orderBy("_part").collect()
    # A row for each range: what comes before it, and ties of its edges in the ranges before and after.
    base, before, after = [0] * len(ends), [0] * len(ends), [0] * len(ends)
    for i in range(1, len(ends)):
        e = ends[i - 1]
        base[i] = base[i - 1] + e["n"]
        if _same(e["hi"], ends[i]["lo"]):
            before[i] = e["n_hi"] + (before[i - 1] if _same(e["lo"], e["hi"]) else 0)
    for i in range(len(ends) - 2, -1, -1):
        e = ends[i + 1]
        if _same(e["lo"], ends[i]["hi"]):
            after[i] = e["n_lo"] + (after[i + 1] if _same(e["lo"], e["hi"]) else 0)
    carried = [(e["_part"], b, e["lo"], e["hi"], f, t) for e, b, f, t in zip(ends, base, before, after, strict=True)]
    edges = df.sparkSession.createDataFrame(carried, "_part int, _base long, _lo double, _hi double, _before long, _after long")
    # Dealt by the range's number itself: hashes of it would meet, and leave some tasks several ranges.
    within = Window.partitionBy("_part").orderBy("_x")
    told = rows.repartitionById(ranges, F.col("_part")).withColumns({"_r": F.rank().over(within), "_i": F.row_number().over(within), "_upto": F.count("*").over(within)})
    out = told.join(F.broadcast(edges), "_part")
    earlier = F.when(F.col("_x") == F.col("_lo"), F.col("_before")).otherwise(0)
    ties = F.col("_upto") - F.col("_r") + 1 + earlier + F.when(F.col("_x") == F.col("_hi"), F.col("_after")).otherwise(0)
    less = F.col("_base") + F.col("_r") - 1 - earlier
    return out.select(*[q(c) for c in df.columns], (less + (ties + 1) / 2.0).alias("rank"), ties.alias("ties"), ((F.col("_i") == F.col("_r")) & (earlier == 0)).alias("is_first"))


def ranked_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct rows with ``n`` (how many rows each stands for) and the ``rank``, ``ties`` and ``is_first`` of ``ranked_rows``: for tables of few distinct rows."""
    same = df.where(q(column).isNotNull()).groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("n"))
    values = same.groupBy(q(column).alias("_v")).agg(F.sum("n").alias("_ties"), F.collect_list(F.struct(*[q(c) for c in same.columns])).alias("_rows"))
    placed = running(ranged(values, "_v"), "_v", {"_upto": "_ties"})
    each = placed.select((F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias("rank"), F.col("_ties").alias("ties"), F.posexplode("_rows").alias("_at", "_row"))
    return each.select("_row.*", "rank", "ties", (F.col("_at") == 0).alias("is_first"))


def running(parts: DataFrame, column: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``parts`` (from ``ranged``) with running sums of columns in the order of ``column``, its own row included."""
    order = lambda c: F.desc(c) if descending else F.col(c).asc()
    totals = parts.groupBy("part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = totals.select("part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums])
    within = Window.partitionBy("part").orderBy(order(column)).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.select("*", *[F.sum(v).over(within).alias(f"_w_{k}") for k, v in sums.items()]).join(F.broadcast(carried), "part")
    return out.withColumns({k: F.col(f"_w_{k}") + F.col(f"_c_{k}") for k in sums}).drop(*[f"_{x}_{k}" for x in "wc" for k in sums])


#: Rows (of each column) that an exact percentile may hold at once, and the accuracy of the sketch that narrows more.
AT_ONCE, ACCURACY = 50_000, 10_000


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of numeric columns, nulls and NaN left out; null where there is no value.

    Columns of many values are narrowed first: a mergeable sketch brackets the wanted ranks, one pass counts what lies
    below and within, and only the values within (or one value that fills the bracket) are sorted.  No shuffle of
    values, and no buffer that grows with the table.
    """
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not columns or not probs:
        return out
    clean = lambda c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))
    step = 2.0 / ACCURACY
    edges = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-step, step)]
    first = df.agg(*[x for c in columns for x in (F.count(clean(c)), F.percentile_approx(clean(c), edges, ACCURACY))]).first()
    n = {c: first[2 * i] for i, c in enumerate(columns)}
    small = [c for c in columns if 0 < n[c] <= AT_ONCE]
    if small:
        row = df.agg(*[F.percentile(clean(c), probs) for c in small]).first()
        out.update({c: list(row[i]) for i, c in enumerate(small)})
    # (column, place in probs) -> the bracket that holds both ranks beside the wanted place.
    open_ = {(c, j): (first[2 * i + 1][2 * j], first[2 * i + 1][2 * j + 1]) for i, c in enumerate(columns) for j in range(len(probs)) if n[c] > AT_ONCE}
    while open_:
        keys = list(open_)
        x = {k: clean(k[0]) for k in keys}
        inside = {k: (x[k] >= open_[k][0]) & (x[k] <= open_[k][1]) for k in keys}
        row = df.agg(*[a for k in keys for a in (F.count_if(x[k] < open_[k][0]), F.count_if(inside[k]))]).first()
        ready, narrower, wider = {}, [], {}
        for i, k in enumerate(keys):
            c, j = k
            below, held = row[2 * i], row[2 * i + 1]
            place = probs[j] * (n[c] - 1)
            if not (below <= math.floor(place) and math.ceil(place) < below + held):
                wider[k] = (float("-inf"), float("inf"))
            elif open_[k][0] == open_[k][1]:
                out[c][j] = open_[k][0]
            elif held <= AT_ONCE:
                ready[k] = (place - below) / (held - 1) if held > 1 else 0.0
            else:
                narrower.append((k, min(max((place - below) / (held - 1), 0.0), 1.0)))
        if ready:
            row = df.agg(*[F.percentile(F.when(inside[k], x[k]), F.lit(min(max(f, 0.0), 1.0))) for k, f in ready.items()]).first()
            for i, (c, j) in enumerate(ready):
                out[c][j] = row[i]
        if narrower:
            row = df.agg(*[F.percentile_approx(F.when(inside[k], x[k]), [max(f - step, 0.0), min(f + step, 1.0)], ACCURACY) for k, f in narrower]).first()
        open_, before = dict(wider), open_
        for i, (k, f) in enumerate(narrower):
            bracket = (row[i][0], row[i][1])
            if bracket == before[k]:  # few distinct values: an exact percentile counts each once
                value = df.agg(F.percentile(F.when(inside[k], x[k]), F.lit(f))).first()[0]
                out[k[0]][k[1]] = value
            else:
                open_[k] = bracket
    return out


#: Rows of a block of an ordered series.
SERIES_BLOCK = 8192


def blocked(series: DataFrame, order: str, halo: int, rows: int = SERIES_BLOCK) -> DataFrame:
    """A series in blocks of ``rows`` for centred frames: ``pos`` (from 0, over the whole series), ``block``, and ``is_own``.

    Each block holds ``halo`` rows of its neighbours on either side as well (not its own), so a frame of that reach, within a block and in
    the order of ``pos``, sees what it would see in one window over everything.
    """
    placed = running(ranged(series.withColumn("_one", F.lit(1).cast("long")), order), order, {"_place": "_one"})
    placed = placed.withColumn("pos", F.col("_place") - 1).drop("_one", "_place", "part")
    at = lambda c: F.floor(c / rows)
    return placed.withColumn("block", F.explode(F.sequence(at(F.greatest(F.col("pos") - halo, F.lit(0))), at(F.col("pos") + halo)))).withColumn("is_own", F.col("block") == at(F.col("pos")))
