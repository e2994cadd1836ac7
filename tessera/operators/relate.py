"""Relations between columns: crosstabs, correlations, significance, ranks, redundancy, group effects."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grams
from tessera.functions.columns import corr, per_column, q
from tessera.functions.distributions import chi2_sf, f_sf, normal_sf, on_rows, t_two_sided
from tessera.functions.ranks import quantiles, ranked_counts, ranked_rows
from tessera.functions.selection import group_quantiles
from tessera.functions.tables import written
from tessera.operators.describe import bins_of


def inverse(m: np.ndarray) -> np.ndarray:
    """The (pseudo-)inverse of a Gram matrix, scaled to a unit diagonal first: columns of different units would fall under its cutoff."""
    d = np.sqrt(np.diag(m))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(m / np.outer(d, d)) / np.outer(d, d)


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means, and sums of products of centered complete rows: two native aggregations, k x k numbers on the driver.

    Columns are centered first, so that large means cost no digits.
    """
    n, means, folds = _products(df, columns, None)
    return n, means, folds[0][2] if folds else np.zeros((len(columns), len(columns)))


def fold_grams(df: DataFrame, key: str, columns: list[str], folds: int = 5) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """n, sums and sums of products of each fold (by a hash of ``key``), all columns less their mean over all rows: one pass for all folds."""
    _, _, rows = _products(df, columns, F.pmod(F.xxhash64(q(key)), F.lit(folds)))
    empty = (0, np.zeros(len(columns)), np.zeros((len(columns), len(columns))))
    return [rows.get(f, empty) for f in range(folds)]


#: Columns up to which an expression for each pair is a small plan; beyond, matrices are added (``functions.grams``).
NARROW = 12


def _products(df: DataFrame, columns: list[str], fold: Column | None) -> tuple[int, np.ndarray, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    if len(columns) > NARROW:
        return grams.products(df, columns, fold)
    x = [q(c).cast("double") for c in columns]
    whole = df.where(reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in x]))
    first = whole.agg(F.count(F.lit(1)), *[F.avg(c) for c in x]).first()
    means = np.array([v or 0.0 for v in first[1:]])
    if not first[0]:
        return 0, means, {}
    x = [c - F.lit(float(m)) for c, m in zip(x, means, strict=True)]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out = {}
    for row in whole.groupBy((F.lit(0) if fold is None else fold).alias("fold")).agg(F.count(F.lit(1)), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).collect():
        products = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[2 + k :], strict=True):
            products[i, j] = products[j, i] = v or 0.0
        out[int(row[0])] = (row[1], np.array([v or 0.0 for v in row[2 : 2 + k]]), products)
    return first[0], means, out


#: Levels of each side of a table of all cells: beyond, its cells would grow with the square of the data.
MAX_LEVELS = 1_000


def crosstab(df: DataFrame, first: str, second: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Row shares of each pair of values, zero cells included; more than ``max_levels`` values a side raise an error."""
    rows = df.where(q(first).isNotNull() & q(second).isNotNull())
    counts = written(rows.groupBy(q(first).alias("first"), q(second).alias("second")).agg(F.count("*").alias("n")), "cells")
    a, b = counts.select("first").distinct(), counts.select("second").distinct()
    for side, name in ((a, first), (b, second)):
        if (k := side.count()) > max_levels:
            raise ValueError(f"{name} has {k} levels, over {max_levels}")
    cells = a.join(F.broadcast(b)).join(counts, ["first", "second"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("first")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair over the rows where both have a value; null where one of the two doesn't vary there.

    A few columns are one aggregation, more of them blocks of matrices; NaN and infinities count as missing then.
    """
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    if len(columns) > NARROW:
        r = grams.correlation_matrix(df, columns)[np.triu_indices(len(columns), 1)]
        found = pa.table({"a": pa.array([a for a, _ in pairs]), "b": pa.array([b for _, b in pairs]), "r": pa.array(r, mask=np.isnan(r))})
        return df.sparkSession.createDataFrame(found)
    row = df.agg(*[corr(q(a).cast("double"), q(b).cast("double")).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])))


def correlated(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > least)


def correlation_clusters(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Greedy clusters in the order of the columns: each takes the later ones that are near it and still free."""
    near = {(r["a"], r["b"]) for r in correlations(df, columns).where(F.abs("r") >= least).collect()}
    taken: set[str] = set()
    rows = []
    for i, a in enumerate(columns):
        own = [b for b in columns[i + 1 :] if (a, b) in near and b not in taken]
        if a not in taken and own:
            taken |= {a, *own}
            rows += [(a, x) for x in (a, *own)]
    return df.sparkSession.createDataFrame(rows, "cluster string, column string")


def by_category(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """Mean, median and count of each number for each category of each categorical column: one pass over unpivoted rows."""
    long = df.select(*[q(c).cast("string").alias(c) for c in categories], *[q(c).cast("double").alias(c) for c in numbers])
    a = long.unpivot(numbers, categories, "by", "category").where(F.col("category").isNotNull())
    b = a.unpivot(["by", "category"], numbers, "column", "value").where(F.col("value").isNotNull())
    keys = ["by", "category", "column"]
    means = b.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    medians = group_quantiles(b, keys, "value", [0.5]).select(*keys, F.col("quantiles")[0].alias("median"))
    return means.join(medians, keys, "left").select(*keys, "mean", "median", "n")


def inner_edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner quantile edges of each column, in order."""
    found = quantiles(df, columns, [i / bins for i in range(1, bins)])
    return {c: sorted({v for v in found[c] if v is not None}) for c in columns}


def sankey(df: DataFrame, category: str, column: str, bins: int = 5) -> DataFrame:
    """Counts of category by quantile bin (right-closed, equal edges merged)."""
    x = q(column).cast("double")
    edges = inner_edges(df, [column], bins)[column]
    return df.where(x.isNotNull() & q(category).isNotNull()).groupBy(q(category).alias("category"), bins_of(x, edges).alias("bin")).agg(F.count("*").alias("n"))


def chi_squares(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(first, second, chi2, degrees, p, cramers_v) of each pair of columns: independence, with Yates' correction for 2 x 2; no row where a side has one level.

    One pass counts the cells of all pairs (map-side first); sums over cells that occur are enough: chi2 = n (sum of o^2 / (r c) - 1).
    """
    empty = "first string, second string, chi2 double, degrees long, p double, cramers_v double"
    if not pairs:
        return df.sparkSession.createDataFrame([], empty)
    text = lambda c: q(c).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), text(a).alias("a"), text(b).alias("b")) for a, b in pairs])).alias("x")
    cells = df.select(each).select("x.*").where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("first", "second", "a", "b").agg(F.count("*").alias("o"))
    cells = written(cells, "cells")
    pair = ["first", "second"]
    rows, columns = cells.groupBy(*pair, "a").agg(F.sum("o").alias("r")), cells.groupBy(*pair, "b").agg(F.sum("o").alias("c"))
    sums = rows.groupBy(*pair).agg(F.sum("r").alias("n"), F.count("*").alias("k1"), F.sum(1 / F.col("r")).alias("ir")).join(columns.groupBy(*pair).agg(F.count("*").alias("k2"), F.sum(1 / F.col("c")).alias("ic")), pair)
    o, r, c = F.col("o").cast("double"), F.col("r"), F.col("c")
    parts = cells.join(rows, [*pair, "a"]).join(columns, [*pair, "b"])
    by_pair = parts.groupBy(*pair).agg(F.sum(o * o / r / c).alias("s"), F.max_by(F.struct("o", "r", "c"), F.struct("a", "b")).alias("cell"))
    s = by_pair.join(sums, pair).where((F.col("k1") > 1) & (F.col("k2") > 1))
    n = F.col("n").cast("double")
    # In a 2 x 2 table all four cells are equally far from what is expected.
    gap = F.abs(F.col("cell.o") - F.col("cell.r") * F.col("cell.c") / n)
    yates = F.pow(F.greatest(gap - 0.5, F.lit(0.0)), F.lit(2)) * n * F.col("ir") * F.col("ic")
    chi2 = F.when((F.col("k1") == 2) & (F.col("k2") == 2), yates).otherwise(F.greatest(n * (F.col("s") - 1), F.lit(0.0)))
    s = s.select(*pair, "n", "k1", "k2", chi2.alias("chi2"), ((F.col("k1") - 1) * (F.col("k2") - 1)).cast("long").alias("degrees"))
    return s.select(*pair, "chi2", "degrees", on_rows(chi2_sf)("chi2", "degrees").alias("p"), F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("k1", "k2") - 1))).alias("cramers_v"))


def chi_square(df: DataFrame, first: str, second: str) -> DataFrame:
    """Chi-square of independence (Yates correction for 2 x 2), degrees, p and Cramer's V from the corrected value; no row for one level."""
    return chi_squares(df, [(first, second)]).drop("first", "second")


def anovas(df: DataFrame, categories: list[str], columns: list[str]) -> DataFrame:
    """(category, column, f, d1, d2, p, eta2) of each category and number, from one pass over the levels of all categories.

    Nothing if a group has fewer than two values, F null without spread within groups. Within degrees count all rows.
    """
    if not categories or not columns:
        return df.sparkSession.createDataFrame([], "category string, column string, f double, d1 long, d2 long, p double, eta2 double")
    levels = F.inline(F.array(*[F.struct(F.lit(c).alias("category"), q(c).cast("string").alias("g")) for c in categories]))
    long = df.select(levels, *[q(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    x = [F.col(f"_{i}") for i in range(len(columns))]
    # Rows without a level are counted too.
    g = written(long.groupBy("category", "g").agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v")).alias(f"s{i}") for i, c in enumerate(x)]), "moments")
    rows = g.groupBy("category").agg(F.sum("rows").alias("rows"))
    each = g.where("g IS NOT NULL").select("category", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)]))).select("category", "column", "s.*").where("n > 0")
    grand = F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n"))
    s = each.groupBy("category", "column").agg(F.count("*").alias("k"), F.min("n").alias("least"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand).alias("ssb"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    s = s.where((F.col("least") >= 2) & (F.col("k") >= 2)).join(F.broadcast(rows), "category").withColumns({"d1": F.col("k") - 1, "d2": F.col("rows") - F.col("k")})
    f = F.try_divide(F.try_divide(F.greatest("ssb", F.lit(0.0)), F.col("d1")), F.try_divide("ssw", "d2"))
    return s.select("category", "column", f.alias("f"), "d1", "d2", on_rows(f_sf)(f, "d1", "d2").alias("p"), F.try_divide("ssb", F.col("ssb") + F.col("ssw")).alias("eta2"))


def anova(df: DataFrame, category: str, column: str) -> DataFrame:
    """One-way F, p and eta squared; nothing if a group has fewer than two values, F null without spread within groups. Within degrees count all rows."""
    return anovas(df, [category], [column]).drop("category", "column")


def category_impact(df: DataFrame, category: str | Column, columns: list[str], min_count: int = 10) -> DataFrame:
    """For each value and number: delta of the mean to all rows, Cohen's d and Welch p against the other rows.

    The others are the totals less the group: no pass for each value.
    """
    c = q(category) if isinstance(category, str) else category
    long = df.select(c.cast("string").alias("value"), *[q(x).cast("double").alias(x) for x in columns]).unpivot(["value"], columns, "column", "x").where(F.col("value").isNotNull() & F.col("x").isNotNull())
    x = F.col("x")
    g = long.groupBy("value", "column").agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    t = long.groupBy("column").agg(F.count("*").alias("tn"), F.avg(x).alias("tm"), F.var_samp(x).alias("tv"))
    both = g.join(F.broadcast(t), "column").where(F.col("n") >= min_count)
    rn = F.col("tn") - F.col("n")
    rm = F.try_divide(F.col("tn") * F.col("tm") - F.col("n") * F.col("m"), rn)
    ss = (F.col("tn") - 1) * F.col("tv") - (F.col("n") - 1) * F.col("v") - F.col("n") * rn / F.col("tn") * (F.col("m") - rm) * (F.col("m") - rm)
    both = both.where(rn > 1).withColumns({"rn": rn, "rm": rm, "rv": F.greatest(F.try_divide(ss, rn - 1), F.lit(0.0))})
    pooled = F.sqrt(F.try_divide((F.col("n") - 1) * F.col("v") + (F.col("rn") - 1) * F.col("rv"), F.col("n") + F.col("rn") - 2))
    a, b = F.col("v") / F.col("n"), F.col("rv") / F.col("rn")
    t_value = F.try_divide(F.col("m") - F.col("rm"), F.sqrt(a + b))
    degrees = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n") - 1) + F.try_divide(b * b, F.col("rn") - 1))
    return both.select("value", "column", "n", F.col("m").alias("group_mean"), F.col("tm").alias("overall_mean"), (F.col("m") - F.col("tm")).alias("delta"), F.try_divide(F.col("m") - F.col("rm"), pooled).alias("cohens_d"), t_value.alias("t"), degrees.alias("degrees"), on_rows(t_two_sided)(t_value, degrees).alias("p"))


def strongest_impact(impact: DataFrame) -> DataFrame:
    """The value with the largest |d| of each number, ties by value."""
    best = F.max(F.struct(F.abs("cohens_d").alias("d"), F.col("value"), F.col("cohens_d"), F.col("delta"))).alias("b")
    return impact.groupBy("column").agg(best).select("column", "b.value", "b.cohens_d", "b.delta")


def with_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows that have a number, with its average rank; no global window and no join on values."""
    return ranked_rows(df, column).drop("ties", "is_first").withColumnRenamed("rank", name)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho of complete pairs, their number, and the two-sided p of its t with n - 2 degrees (null for fewer than 3 pairs)."""
    whole = df.where(q(a).isNotNull() & q(b).isNotNull()).select(q(a).alias("a"), q(b).alias("b"))
    once = written(with_ranks(whole, "a", "ra"), "ranked-once")  # a range partitioner reads its rows twice
    out = with_ranks(once, "b", "rb").agg(corr("ra", "rb").alias("rho"), F.count("*").alias("n"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(on_rows(t_two_sided)(t, F.when(F.col("n") > 2, F.col("n") - 2)))
    return out.withColumn("p", F.when(F.col("n") > 2, p))


#: Pairs of a group and a value (by a sketch) up to which equal rows are counted before they are ranked; a task's table of more would grow with its rows.
COUNTED = 100_000


def _rank_sums(df: DataFrame, group: str, column: str) -> DataFrame:
    """(g, n, rank_sum, ties): of each group its rows, the sum of their ranks, and of the values first met in it the sum of t^3 - t over their ties.

    Few values are counted first, so that no row is dealt; of more, each row is ranked.
    """
    whole = df.where(q(group).isNotNull() & q(column).isNotNull()).select(q(group).cast("string").alias("g"), q(column).cast("double").alias("x"))
    few = whole.agg(F.approx_count_distinct(F.struct("g", "x"))).first()[0] <= COUNTED
    ranked = ranked_counts(whole, "x") if few else ranked_rows(whole, "x").withColumn("n", F.lit(1).cast("long"))
    t = F.col("ties").cast("double")
    return ranked.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"), F.sum(F.when(F.col("is_first"), t * t * t - t)).alias("ties"))


def kruskal(df: DataFrame, group: str, column: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, degrees and p; H null where all values are equal, no row without values."""
    s = _rank_sums(df, group, column).agg(F.count("*").alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("r2"), F.sum("n").cast("double").alias("total"), F.sum("ties").alias("ties")).where("k > 0")
    n = F.col("total")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("r2") - 3 * (n + 1), 1 - F.try_divide("ties", n * n * n - n))
    degrees = (F.col("k") - 1).cast("long")
    return s.select(h.alias("h"), degrees.alias("degrees"), on_rows(chi2_sf)(h, degrees).alias("p"))


def mann_whitney(df: DataFrame, group: str, column: str) -> DataFrame:
    """U of the smaller group name, z with tie and continuity correction (null where all values are equal), two-sided p; two groups only."""
    s = _rank_sums(df, group, column).agg(F.count("*").alias("k"), F.min_by("n", "g").cast("double").alias("n1"), F.max_by("n", "g").cast("double").alias("n2"), F.min_by("rank_sum", "g").alias("r1"), F.sum("n").cast("double").alias("total"), F.sum("ties").alias("ties")).where("k = 2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean, n = F.col("n1") * F.col("n2") / 2, F.col("total")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * F.greatest(n + 1 - F.try_divide("ties", n * (n - 1)), F.lit(0.0)))
    z = F.try_divide(F.abs(u - mean) - 0.5, sd)
    return s.select(u.alias("u"), z.alias("z"), F.least(F.lit(1.0), 2 * on_rows(normal_sf)(z)).alias("p"))


def group_medians(df: DataFrame, group: str, column: str) -> DataFrame:
    """Exact median and number of values of each group; a group without values has a null median."""
    rows = df.where(q(group).isNotNull()).select(q(group).alias("group"), q(column).cast("double").alias("x"))
    medians = group_quantiles(rows, ["group"], "x", [0.5]).select("group", F.col("quantiles")[0].alias("median"))
    return rows.groupBy("group").agg(F.count("x").alias("n")).join(medians, "group", "left").select("group", "median", "n")


def vif(df: DataFrame, columns: list[str], centered: bool = False) -> DataFrame:
    """Variance inflation from the inverse of the Gram matrix; uncentered (no constant) unless asked otherwise."""
    n, means, m = gram(df, columns)
    m = m if centered else m + n * np.outer(means, means)
    inv = inverse(m)
    return df.sparkSession.createDataFrame([(c, float(m[i, i] * inv[i, i])) for i, c in enumerate(columns)], "column string, vif double")


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile bins of each number with a target: a binned estimator."""
    edges = inner_edges(df, columns, bins)
    parts = [bins_of(q(c).cast("double"), edges[c]).alias(c) for c in columns]
    long = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("target"), *parts).unpivot(["target"], columns, "column", "bin").where(F.col("bin").isNotNull())
    joint = long.groupBy("column", "bin", "target").agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("column", *k))
    p = F.col("n") / by()
    each = joint.select("column", (p * F.log(F.col("n") * by() / (by("bin") * by("target")))).alias("x"))
    return each.groupBy("column").agg(F.sum("x").alias("mutual_information"))


def scale_economies(df: DataFrame, driver: str, outcome: str) -> DataFrame:
    """Correlations of a driver with the outcome and the outcome a unit, and the change of the outcome for 10 % more driver."""
    x, y = q(driver).cast("double"), q(outcome).cast("double")
    return df.agg(corr(x, y).alias("r"), corr(x, F.try_divide(y, x)).alias("r_unit"), (F.try_divide(F.regr_slope(y, x) * 0.1 * F.avg(x), F.avg(y)) * 100).alias("change_pct"))


def counterintuitive(df: DataFrame, metric: str, value: str, sign: str) -> DataFrame:
    """Rows of each metric whose value has not the expected sign."""
    positive, negative = F.lower(q(sign)).isin("positive", "+", "pos"), F.lower(q(sign)).isin("negative", "-", "neg")
    return df.where((positive & (q(value) < 0)) | (negative & (q(value) > 0))).groupBy(q(metric).alias("metric")).agg(F.count("*").alias("n"))


def list_values(df: DataFrame, column: str, separator: str = ",", k: int = 20) -> DataFrame:
    """The k most frequent items of a list column with the entropy (bits) of all of them."""
    items = df.select(F.explode(F.split(q(column), separator)).alias("v")).select(F.trim("v").alias("value")).where("value <> ''")
    counts = items.groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    entropy = counts.join(total).agg((-F.sum(p * F.log2(p))).alias("entropy"))
    return counts.orderBy(F.desc("n"), "value").limit(k).join(entropy)


def top_variance(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    return per_column(df, columns, variance=lambda c: F.var_samp(c)).orderBy(F.desc("variance"), "column").limit(k)
