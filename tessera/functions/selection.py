"""Exact quantiles of every group, however large one group is: no buffer holds a group's values.

Where all groups are small, distinct values are counted and a running count finds the wanted ranks.  A group of more than
MOST values is narrowed first, all groups and ranks at once: a mergeable sketch gives a bracket around each rank, one pass counts
what lies below and within it, and again until a bracket holds few values or cannot shrink (then it has few distinct
ones).  Only the values within brackets are sorted, and running counts read them in order without holding them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Values that are sorted for one rank of one group; steps of a sketch's grid, and its accuracy.
MOST, STEPS, ACCURACY = 1_000_000, 1000, 10_000


def _on(keys: list[str], other: str = "_k_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _picked(counts: DataFrame, keys: list[str], j: list[str]) -> DataFrame:
    """Of (keys, [j], value, n, below, place): the value at the fractional place of each group, counted from ``below``."""
    order = Window.partitionBy(*keys, *j).orderBy("value")
    first = counts.withColumn("last", F.col("below") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda place: F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col("value")))
    lo, hi = F.floor("place"), F.ceil("place")
    found = first.groupBy(*keys, *j, "place").agg(at(lo).alias("a"), at(hi).alias("b"))
    return found.select(*keys, *j, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("quantile"))


def group_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], most: int = MOST) -> DataFrame:
    """(keys..., n, quantiles) of non-null values, NaN left out: ``quantiles`` holds the interpolated quantile of each of ``probs``.

    Null keys are groups of their own.  Groups without values have no row.
    """
    x = F.col(value).cast("double")
    rows = rows.select(*keys, x.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("total")), "groups")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])).alias("w")
    ranks = sizes.select(*keys, "total", wanted).select(*keys, "total", F.col("w.j").alias("j"), (F.col("w.p") * (F.col("total") - 1)).alias("place"))
    small = _renamed(ranks.where(F.col("total") <= most), keys)
    counts = rows.join(_renamed(sizes.where(F.col("total") <= most).select(*keys), keys), _on(keys), "left_semi").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    told = counts.join(small, _on(keys)).select(*keys, "j", "value", "n", F.lit(0).cast("long").alias("below"), "place")
    found = [_picked(told, keys, ["j"])]
    open_ = ranks.where(F.col("total") > most).select(*keys, "j", "place", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("total").alias("within"))
    while not (open_ := written(open_, "open")).isEmpty():
        counted = _narrowed(rows, open_, keys, most)
        closed = counted.where("ready")
        own = _renamed(closed.select(*keys, "j", "place", "lo", "hi", "below"), keys)
        inside = rows.join(own, _on(keys)).where("value >= lo AND value <= hi").groupBy(*keys, "j", "place", "below", "value").agg(F.count("*").alias("n"))
        found.append(_picked(inside, keys, ["j"]))
        open_ = counted.where("NOT ready").drop("ready")
    each = reduce(DataFrame.unionByName, found)
    lists = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "quantile"))), lambda s: s["quantile"]).alias("quantiles"))
    return lists.join(_renamed(sizes, keys), _on(keys)).select(*keys, F.col("total").alias("n"), "quantiles")


def _narrowed(rows: DataFrame, open_: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """The brackets after one more sketch, with what lies below and within; ``ready`` where one is small or doesn't shrink."""
    own = _renamed(open_, keys)
    inside = rows.join(own, _on(keys)).where("value >= lo AND value <= hi")
    grid = [i / STEPS for i in range(STEPS + 1)]
    sketch = inside.groupBy(*keys, "j", "place", "lo", "hi", "below", "within").agg(F.percentile_approx("value", grid, ACCURACY).alias("grid"))
    at = F.try_divide(F.col("place") - F.col("below"), F.col("within") - 1) * STEPS
    edge = lambda i: F.element_at("grid", F.greatest(F.lit(1), F.least(F.lit(STEPS + 1), i.cast("int") + 1)))
    new = sketch.select(*keys, "j", "place", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.col("below").alias("below0"), F.col("within").alias("within0"), edge(F.floor(at) - 1).alias("lo"), edge(F.ceil(at) + 1).alias("hi"))
    new = written(new, "brackets")
    v = F.col("value")
    tallied = rows.join(_renamed(new, keys), _on(keys)).groupBy(*keys, "j", "place", "lo0", "hi0", "below0", "within0", "lo", "hi").agg(F.count_if(v < F.col("lo")).alias("below"), F.count_if((v >= F.col("lo")) & (v <= F.col("hi"))).alias("within"))
    # A sketch is right within its accuracy; where it isn't, the bracket before holds.
    holds = (F.col("below") <= F.floor("place")) & (F.ceil("place") < F.col("below") + F.col("within"))
    keep = lambda c: F.when(holds, F.col(c)).otherwise(F.col(f"{c}0")).alias(c)
    ready = ~holds | (F.col("within") <= most) | (F.col("lo") == F.col("hi")) | (F.col("within") == F.col("within0"))
    return written(tallied.select(*keys, "j", "place", keep("lo"), keep("hi"), keep("below"), keep("within"), ready.alias("ready")), "narrowed")


#: Buckets of an order in [0, 1) among which the last one to take is sought.
BUCKETS = 4096


def smallest_of_groups(df: DataFrame, keys: list[str], order: str, wanted: Column) -> DataFrame:
    """Rows with ``is_taken``: of each group exactly ``wanted`` (a function of its size ``n``) rows, those of the smallest ``order`` (a number in [0, 1)); null keys are a group.

    Buckets of the order are counted by group, and only the bucket that the edge falls into is ranked: no group comes together.
    """
    at = F.floor(F.col(order) * BUCKETS)
    counts = written(df.groupBy(*keys, at.alias("_bucket")).agg(F.count("*").alias("_n")), "buckets")
    within = Window.partitionBy(*keys)
    told = counts.withColumns({"n": F.sum("_n").over(within), "_upto": F.sum("_n").over(within.orderBy("_bucket"))}).withColumn("_wanted", wanted)
    edge = told.where("_upto >= _wanted AND _upto - _n < _wanted").select(*keys, F.col("_bucket").alias("_edge"), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_left"))
    rows = df.join(_renamed(written(edge, "edges"), keys), _on(keys), "left").drop(*[f"_k_{k}" for k in keys]).withColumn("_bucket", at)
    sure = rows.where("_edge IS NULL OR _bucket <> _edge").withColumn("is_taken", F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)))
    close = rows.where("_bucket = _edge").withColumn("is_taken", F.row_number().over(within.orderBy(order)) <= F.col("_left"))
    return sure.unionByName(close).drop("_edge", "_left", "_bucket")
