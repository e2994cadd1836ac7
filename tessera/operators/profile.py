"""Profiles of whole tables: missing values, duplicates, cardinality, top values, distributions, quality."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import corr, date_columns, numeric_columns, per_column, q, r6
from tessera.functions.frequencies import hashed_counts, most_frequent, value_numbers
from tessera.functions.ranks import quantiles


def numeric_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, min, max, mean, median, std (n - 1), quartiles, population skew and excess kurtosis, values outside the IQR fences."""
    base = per_column(
        df,
        columns,
        n=lambda c: F.count(c),
        lo=lambda c: F.min(c).cast("double"),
        hi=lambda c: F.max(c).cast("double"),
        mean=lambda c: F.avg(c),
        std=lambda c: F.stddev_samp(c),
        skew=lambda c: F.skewness(c),
        kurtosis=lambda c: F.kurtosis(c),
        zeros=lambda c: F.count_if(c == 0),
    )
    at = quantiles(df, columns, [0.25, 0.5, 0.75])

    def outside(name: str) -> Column:
        a, _, b = at[name]
        return F.lit(0).cast("long") if a is None else F.count_if((q(name) < a - 1.5 * (b - a)) | (q(name) > b + 1.5 * (b - a)))

    counts = df.agg(*[outside(c).alias(str(i)) for i, c in enumerate(columns)])
    fixed = lambda c: [F.lit(v).cast("double").alias(k) for k, v in zip(("q1", "median", "q3"), at[c], strict=True)]
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{i}`").alias("outliers"), *fixed(c)) for i, c in enumerate(columns)])))
    return base.join(F.broadcast(rows), "column").select("column", "n", "lo", "q1", "median", "q3", "hi", "mean", "std", "skew", "kurtosis", "zeros", "outliers")


def corrected_moments(df: DataFrame) -> DataFrame:
    """Bias-corrected skew and kurtosis beside the population ones of ``numeric_describe``."""
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("skew") * F.try_divide(F.sqrt(n * (n - 1)), n - 2))
    kurtosis = F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("kurtosis") + 6))
    return df.withColumns({"skew_corrected": skew, "kurtosis_corrected": kurtosis})


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells of each column and, as column ``*``, of the table."""
    columns = df.columns
    base = per_column(df, columns, missing=lambda c: F.count_if(c.isNull()), n=lambda c: F.count(F.lit(1)))
    rows = base.select("column", "missing", F.col("n").alias("cells"))
    total = rows.agg(F.lit("*").alias("column"), F.sum("missing").alias("missing"), F.sum("cells").alias("cells"))
    pct = F.try_divide(F.col("missing"), F.col("cells")) * 100
    return rows.unionByName(total).withColumns({"missing_pct": pct, "over_half": F.coalesce(pct > 50, F.lit(False))})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, duplicates beyond the first of each group (nulls equal), groups of several and the largest group.

    Groups are of two 64-bit hashes of the row, so whole rows aren't shuffled.
    """
    keys = [F.coalesce(q(c).cast("string"), F.lit("\0")).alias(c) for c in df.columns]
    hashed = df.select(F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(1), *reversed(keys)).alias("h2"))
    groups = hashed.groupBy("h1", "h2").agg(F.count("*").alias("k"))
    return groups.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("k") > 1).alias("repeated_groups"), F.max("k").alias("largest_group"))


def duplicate_sample(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first ``rows`` distinct rows that occur more than once, with their counts."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n_copies")).where("n_copies > 1").orderBy(*df.columns).limit(rows)


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, their share of all rows, and a class: constant, id, high (> 0.7), low (< 0.05) or medium."""
    share = F.try_divide("n_unique", "n_rows")
    kind = F.when(F.col("n_unique") <= 1, "constant").when(share == 1, "id").when(share > 0.7, "high").when(share < 0.05, "low").otherwise("medium")
    return value_numbers(df, columns).select("column", "n_unique", share.alias("unique_share"), kind.alias("cardinality"))


def file_summary(df: DataFrame) -> DataFrame:
    """A row for each column: numeric, datetime or categorical, unique values of the categorical ones, and the table's rows and columns."""
    numbers, dates = numeric_columns(df), date_columns(df)
    texts = [c for c in df.columns if c not in numbers and c not in dates]
    kind = lambda c: "numeric" if c in numbers else "datetime" if c in dates else "categorical"
    out = df.sparkSession.createDataFrame([(i, c, kind(c)) for i, c in enumerate(df.columns)], "at int, column string, kind string")
    n = df.agg(F.count("*").alias("n_rows"))
    unique = cardinality(df, texts).select("column", "n_unique") if texts else df.sparkSession.createDataFrame([], "column string, n_unique long")
    return out.join(F.broadcast(unique), "column", "left").join(F.broadcast(n)).select("at", "column", "kind", "n_unique", "n_rows", F.lit(len(df.columns)).alias("n_columns"))  # n is one row


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column, ties by value, with their share of the non-null rows."""
    return most_frequent(df, columns, k).select("column", "rank", "value", "n", (F.col("n") / F.col("total") * 100).alias("percent"))


def diversity(df: DataFrame, columns: list[str], rare: float = 0.01) -> DataFrame:
    """Entropy (bits), Gini impurity, categories and the share of rare ones."""
    counts = hashed_counts(df, columns)
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total), "column").groupBy("column").agg(F.count("*").alias("n_unique"), (-F.sum(p * F.log2(p))).alias("entropy"), (1 - F.sum(p * p)).alias("gini"), F.avg((p < rare).cast("double")).alias("rare_share"))


def parse_fractions(df: DataFrame, columns: list[str], date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The shares of all rows that parse as numbers and as dates."""
    share = lambda c: F.try_divide(F.count(c), F.count(F.lit(1)))
    return per_column(df, columns, numeric=lambda c: share(F.trim(c.cast("string")).try_cast("double")), dates=lambda c: share(F.try_to_timestamp(c.cast("string"), F.lit(date_format))))


MULTI = r"[,;|]| / "


def multi_select(df: DataFrame, columns: list[str], least: float = 0.2) -> DataFrame:
    """Columns where more than ``least`` of the rows hold a list separator."""
    out = per_column(df, columns, share=lambda c: F.avg(F.coalesce(c.rlike(MULTI), F.lit(False)).cast("double")))
    return out.withColumn("is_multi", F.col("share") > least)


def numeric_advanced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentiles 1 and 99, coefficient of variation, |z| over 2 and 3, largest |z|, and the shape by skew.

    What a constant column or few rows leave undefined is null (the shape: strong).
    """
    base = per_column(df, columns, n=lambda c: F.count(c), mean=lambda c: F.avg(c), std=lambda c: F.stddev_samp(c), skew=lambda c: F.skewness(c), lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"))
    at = {r["column"]: (r["mean"], r["std"]) for r in base.select("column", "mean", "std").collect()}
    tails = quantiles(df, columns, [0.01, 0.99])

    def over(name: str, z: int) -> Column:
        mean, std = at[name]
        return F.lit(0).cast("long") if not std else F.count_if(F.abs((q(name) - mean) / std) > z)

    counts = df.agg(*[over(c, z).alias(f"{i}_{z}") for i, c in enumerate(columns) for z in (2, 3)])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{i}_2").alias("z2"), F.col(f"{i}_3").alias("z3"), F.lit(tails[c][0]).cast("double").alias("p01"), F.lit(tails[c][1]).cast("double").alias("p99")) for i, c in enumerate(columns)])))
    n = F.col("n").cast("double")
    skew = F.col("skew") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    shape = F.when(F.abs(skew) < 0.5, "symmetric").when(F.abs(skew) < 1, "moderate").otherwise("strong")
    top = F.try_divide(F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")), F.col("std"))
    return base.join(F.broadcast(rows), "column").select("column", "p01", "p99", F.try_divide("std", "mean").alias("cv"), "z2", "z3", top.alias("max_z"), shape.alias("shape"))


def benford(df: DataFrame, column: str, flag: float = 0.15) -> DataFrame:
    """First digits against Benford's law: the summed deviation, flagged beyond ``flag``.

    A value below 1 counts in the total alone, as its text begins with 0.
    """
    x = F.abs(q(column).cast("double"))
    digit = F.when(x < 1, 0).otherwise(F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x) + 1e-12))).cast("int"))
    counts = df.where(x > 0).groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    law = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1 / F.col("id")).alias("expected"))
    shares = law.join(counts.withColumn("share", F.col("n") / total), "digit", "left").select("digit", "expected", F.coalesce("share", F.lit(0.0)).alias("share"))
    deviation = F.sum(F.abs(F.col("share") - F.col("expected")))
    return shares.agg(deviation.alias("deviation"), (deviation > flag).alias("is_unusual"))


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last day, parsed values, and whether years lie before 1900 or after 2100."""
    out = per_column(df, columns, first_day=lambda c: F.min(c).cast("date"), last_day=lambda c: F.max(c).cast("date"), n=lambda c: F.count(c))
    return out.withColumn("is_odd", (F.year("first_day") < 1900) | (F.year("last_day") > 2100))


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation of each number, or of a date as an epoch, with the target."""
    kinds = dict(df.dtypes)
    as_number = lambda c: F.unix_seconds(q(c).cast("timestamp")).cast("double") if kinds[c].startswith(("timestamp", "date")) else q(c).cast("double")
    row = df.agg(*[corr(as_number(c), q(target).cast("double")).alias(str(i)) for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{i}`").alias("r")) for i, c in enumerate(columns)])))


def suggested_actions(profile: DataFrame) -> DataFrame:
    """(column, rule) from a ``column_profile``, in the order of the rules."""
    number = F.coalesce(F.col("numeric") > 0.5, F.lit(False))
    rules = {
        "drop_or_impute": F.col("missing_pct") > 50,
        "identifier": F.col("is_id"),
        "constant": F.col("n_unique") <= 1,
        "review_outliers": number & (F.col("outlier_share") > 0.01),
        "multi_select": F.col("multi"),
        "mixed_types": F.col("mixed"),
        "high_cardinality": (F.col("unique_share") > 0.95) & (F.col("n_unique") > 50) & (F.col("numeric") < 0.2),
        "transform_skew": F.abs("skew") > 2,
        "odd_dates": (F.col("first_day") < F.lit("1900-01-01").cast("date")) | (F.col("last_day") > F.lit("2100-01-01").cast("date")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return profile.select("column", F.explode(found).alias("rule"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """What the rules need to know about columns of any type: a row for each.

    Shares are of all rows; numbers are native ones or texts that parse as such, dates likewise.
    """
    from tessera.operators.types import as_date, mixed_types

    kinds = dict(df.dtypes)
    view = df.select(*[q(x) for x in columns])
    text = lambda x: q(x).cast("string")
    dates = [x for x in columns if kinds[x].startswith(("date", "timestamp"))]
    native = set(numeric_columns(view))
    numbers = view.select(*[(q(x).cast("double") if x in native else F.lit(None).cast("double") if x in dates else F.trim(text(x)).try_cast("double")).alias(x) for x in columns])
    days = view.select(*[(q(x).cast("date") if x in dates else F.lit(None).cast("date") if x in native else as_date(text(x)).cast("date")).alias(x) for x in columns])
    d = numeric_describe(numbers, columns)
    c = cardinality(view, columns)
    m = missing_summary(view).where(F.col("column") != "*").select("column", "missing_pct", F.col("cells").alias("n_rows"))
    r = date_ranges(days, columns).select("column", "first_day", "last_day")
    texts = [x for x in columns if kinds[x] == "string"]
    base = corrected_moments(d).select("column", "n", F.col("skew_corrected").alias("skew"), "outliers")
    out = base.join(F.broadcast(c), "column").join(F.broadcast(m), "column").join(F.broadcast(r), "column")
    if texts:
        out = out.join(F.broadcast(multi_select(view, texts).select("column", F.col("is_multi").alias("multi"))), "column", "left").join(F.broadcast(mixed_types(view, texts).select("column", F.col("is_mixed").alias("mixed"))), "column", "left")
    else:
        out = out.withColumns({"multi": F.lit(False), "mixed": F.lit(False)})
    share = lambda x: F.try_divide(x, "n_rows")
    none = F.lit(False)
    is_id = (F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 1)
    return out.select("column", "n", "n_rows", "skew", share("outliers").alias("outlier_share"), share("n").alias("numeric"), "n_unique", "unique_share", "cardinality", is_id.alias("is_id"), "missing_pct", F.coalesce("multi", none).alias("multi"), F.coalesce("mixed", none).alias("mixed"), "first_day", "last_day")


def quality_score(df: DataFrame) -> DataFrame:
    """10 less what missing cells (20 %: 4, 5 %: 2), duplicate rows (5 %: 3, any: 1) and constant columns (over 2: 2, any: 1) cost, with a grade."""
    m = missing_summary(df).where(F.col("column") == "*").select("missing_pct")
    d = duplicate_rows(df).select((F.try_divide("duplicates", "n_rows") * 100).alias("duplicate_pct"))
    c = cardinality(df, df.columns).agg(F.count_if(F.col("cardinality") == "constant").alias("constants"))
    one = m.crossJoin(d).crossJoin(c)  # three single rows
    steps = lambda x, hard, soft, a, b: F.when(F.col(x) > hard, a).when(F.col(x) > soft, b).otherwise(0)
    score = 10 - steps("missing_pct", 20, 5, 4, 2) - steps("duplicate_pct", 5, 0, 3, 1) - steps("constants", 2, 0, 2, 1)
    grade = F.when(score >= 9, "very good").when(score >= 7, "good").when(score >= 5, "fair").otherwise("poor")
    return one.select("missing_pct", "duplicate_pct", "constants", score.cast("int").alias("score"), grade.alias("grade"))


def _level(value: Column, steps: dict[str, float], least: str) -> Column:
    return reduce(lambda w, k: w.when(value >= steps[k], k), steps, F.when(F.lit(False), "")).otherwise(least)


ETA = {"large": 0.14, "medium": 0.06, "small": 0.01}
CRAMER = {"very strong": 0.5, "moderate to strong": 0.3, "weak to moderate": 0.1}


def insight_flags(df: DataFrame, numeric: list[str], categorical: list[str], tested: int = 3, silhouette: float | None = None, anomaly_share: float | None = None) -> DataFrame:
    """(rule, column, value, level) of what stands out in a table.

    Significance is tested between the first ``tested`` columns of each kind.  A clustering's silhouette and the share of
    anomalies count where they are given (see ``models``).
    """
    from tessera.operators.relate import anovas, chi_squares, vif

    n = column_profile(df, numeric)
    t = top_values(df, categorical, 1)
    c = cardinality(df, categorical)
    m = missing_summary(df.select(*[q(x) for x in numeric + categorical])).where(F.col("column") != "*")
    d = duplicate_rows(df)
    none = F.lit(None).cast("string").alias("level")
    v = lambda x: F.col(x).cast("double").alias("value")
    rule = lambda name: F.lit(name).alias("rule")
    found = [
        m.where("missing_pct > 30").select(rule("missing"), "column", v("missing_pct"), none),
        d.where("duplicates > 0").select(rule("duplicates"), F.lit("*").alias("column"), v("duplicates"), none),
        n.where(F.abs("skew") > 1).select(rule("skew"), "column", v("skew"), F.when(F.col("skew") > 0, "right").otherwise("left").alias("level")),
        n.where("outlier_share * n_rows > 0.05 * n").select(rule("outliers"), "column", (F.col("outlier_share") * F.col("n_rows") / F.col("n")).alias("value"), none),
        t.where("percent > 80").select(rule("dominant_value"), "column", v("percent"), none),
        c.where("cardinality = 'constant'").select(rule("constant"), "column", v("n_unique"), none),
        c.where("unique_share > 0.9 AND n_unique > 50").select(rule("near_unique"), "column", v("unique_share"), none),
        d.where("n_rows < 50").select(rule("few_rows"), F.lit("*").alias("column"), v("n_rows"), none),
    ]
    levels = {r["column"]: r["n_unique"] for r in c.collect()}
    groups = [x for x in categorical if 2 <= levels[x] <= 50][:tested]
    # All pairs together: a fixed number of passes, whatever the columns.
    f = anovas(df, groups, numeric[:tested]).where("p < 0.05")
    found.append(f.select(rule("anova"), F.concat_ws("~", "category", "column").alias("column"), v("eta2"), _level(F.col("eta2"), ETA, "very small").alias("level")))
    x = chi_squares(df, list(combinations(groups, 2))).where("p < 0.05")
    found.append(x.select(rule("chi_square"), F.concat_ws("~", "first", "second").alias("column"), v("cramers_v"), _level(F.col("cramers_v"), CRAMER, "very weak").alias("level")))
    if len(numeric) > 1:
        found.append(vif(df, numeric).where("vif > 5").select(rule("vif"), "column", v("vif"), none))
    given = [("silhouette", silhouette, "clear" if silhouette > 0.5 else "weak")] if silhouette is not None and not 0.2 <= silhouette <= 0.5 else []
    given += [("anomalies", anomaly_share, None)] if anomaly_share else []
    if given:
        found.append(df.sparkSession.createDataFrame([(k, "*", float(x), y) for k, x, y in given], "rule string, column string, value double, level string"))
    return reduce(DataFrame.unionByName, found)


def footprint(df: DataFrame) -> DataFrame:
    """Bytes of each column: octets of text, width of fixed types."""
    width = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
    kinds = dict(df.dtypes)
    row = df.agg(*[(F.sum(F.octet_length(q(c))) if kinds[c] == "string" else F.count(q(c)) * width.get(kinds[c], 8)).cast("long").alias(str(i)) for i, c in enumerate(df.columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("long").alias("n_bytes")) for i, c in enumerate(df.columns)])))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for results that are compared as values."""
    return df.select(*[r6(q(c), digits).alias(c) if t == "double" else q(c) for c, t in df.dtypes])
