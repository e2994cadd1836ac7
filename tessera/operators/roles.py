"""Roles of columns by scores over their summaries: outcome, treatment, time, instrument, group, id; and a configuration from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import corr, date_columns, numeric_columns, per_column, q
from tessera.functions.frequencies import hashed_counts
from tessera.functions.distributions import f_sf, on_rows
from tessera.operators.relate import chi_squares, correlations
from tessera.operators.types import as_date

#: Levels of a treatment at most, of a group at least and at most.
TREATMENT_LEVELS, GROUP_LEVELS = 5, (2, 20)
EPS = 1e-9


def _within(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _skew(n: Column, g: Column) -> Column:
    """The bias-corrected skew."""
    n = n.cast("double")
    return g * F.try_divide(F.sqrt(n * (n - 1)), n - 2)


def _uniques(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_unique, entropy (bits), the count of the most and of the least frequent value, and of all."""
    c = hashed_counts(df, columns)
    t = c.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.max("n").alias("most"), F.min("n").alias("least"), (F.sum(F.col("n") * F.log2("n"))).alias("s"))
    return t.withColumn("entropy", F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).drop("s")


def outcome_ranking(df: DataFrame, columns: list[str], top: int = 5, near_unique: float = 0.9) -> DataFrame:
    """Variance plus a tenth of |skew| of the numbers that aren't near-unique (of all, if all are)."""
    s = per_column(df, columns, v=lambda c: F.var_samp(c), n=lambda c: F.count(c), g=lambda c: F.skewness(c), rows=lambda c: F.count(F.lit(1)))
    u = s.join(F.broadcast(_uniques(df, columns).select("column", "n_unique")), "column")
    fit = F.col("n_unique") < near_unique * F.col("rows")
    u = u.withColumn("fit", fit | ~F.max(fit).over(Window.partitionBy(F.lit(1))))  # a row for each column
    score = F.col("v") + 0.1 * F.abs(_skew(F.col("n"), F.col("g")))
    return u.where("fit").select("column", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "column").limit(top)


def outcome_scores(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """0.5 spread + 0.3 skew + 0.2 distinctness + 0.1 binned entropy - 0.1 mean |r| with the others - 0.1 what looks like a plain attribute; 0 under ten values."""
    s = per_column(df, columns, v=lambda c: F.var_samp(c), lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"), g=lambda c: F.skewness(c), n=lambda c: F.count(c))
    at = {r["column"]: (r["lo"], r["hi"]) for r in s.collect()}
    bin_of = lambda c: F.least(F.floor((q(c) - at[c][0]) / ((at[c][1] - at[c][0]) / bins)), F.lit(bins - 1)).cast("int").alias(c)
    live = [c for c in columns if at[c][0] is not None and at[c][0] < at[c][1]]
    out = s.join(F.broadcast(_uniques(df, columns).select("column", "n_unique")), "column")
    if live:
        shape = _uniques(df.select(*[bin_of(c) for c in live]), live).select("column", (F.col("entropy") / F.log2(F.lit(float(bins)))).alias("entropy"))
        out = out.join(F.broadcast(shape), "column", "left")
    else:
        out = out.withColumn("entropy", F.lit(0.0))
    if len(columns) > 1:
        c = correlations(df, columns)
        both = c.select(F.col("a").alias("column"), "r").unionByName(c.select(F.col("b").alias("column"), "r")).groupBy("column").agg(F.avg(F.abs("r")).alias("mean_r"))
        out = out.join(F.broadcast(both), "column", "left")
    else:
        out = out.withColumn("mean_r", F.lit(0.0))
    zero = F.lit(0.0)
    spread = F.when(F.col("hi") > F.col("lo"), F.least(F.col("v") / (F.col("hi") - F.col("lo") + EPS), F.lit(1.0))).otherwise(0.0)
    skew = F.least(F.abs(F.coalesce(_skew(F.col("n"), F.col("g")), zero)) / 3, F.lit(1.0))
    distinct, entropy = F.try_divide("n_unique", "n"), F.coalesce("entropy", zero)
    plain = 0.5 * (1 - entropy) + 0.5 * (1 - distinct)
    score = 0.5 * spread + 0.3 * skew + 0.2 * distinct + 0.1 * entropy - 0.1 * F.coalesce("mean_r", zero) - 0.1 * plain
    return out.select("column", F.when(F.col("n") < 10, 0.0).otherwise(_within(score)).alias("score"))


def level_moments(df: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """For columns of few levels and a number: association by column, in one pass over the rows.

    r of the levels' codes (their places in order, numbers as numbers) with the outcome, and one-way F with its degrees
    (null where a level has one value).
    """
    y = q(outcome).cast("double")
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    rows = df.where(y.isNotNull()).select((y - F.lit(mean)).alias("_y"), *[q(c).cast("string").alias(c) for c in columns]).unpivot(["_y"], [q(c) for c in columns], "column", "value").where("value IS NOT NULL")
    s = rows.groupBy("column", "value").agg(F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("sq"))
    s = s.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy(F.col("value").try_cast("double"), "value")) - 1)
    n, c, k, y = F.sum("n"), F.col("code").cast("double"), F.count("*"), F.sum("sy")
    t = s.groupBy("column").agg(n.alias("n"), k.alias("k"), F.min("n").alias("least"), F.sum(F.col("n") * c).alias("sc"), F.sum(F.col("n") * c * c).alias("scc"), y.alias("sy"), F.sum("sq").alias("syy"), F.sum(c * F.col("sy")).alias("scy"), F.sum(F.col("sy") * F.col("sy") / F.col("n")).alias("between"))
    n = F.col("n")
    cov, vc, vy = (F.col(a) - F.col(b) * F.col(d) / n for a, b, d in (("scy", "sc", "sy"), ("scc", "sc", "sc"), ("syy", "sy", "sy")))
    ssb, ssw = F.greatest(F.col("between") - F.col("sy") * F.col("sy") / n, F.lit(0.0)), F.greatest(F.col("syy") - F.col("between"), F.lit(0.0))
    f = F.when((F.col("least") > 1) & (F.col("k") > 1), F.try_divide(F.try_divide(ssb, F.col("k") - 1), F.try_divide(ssw, n - F.col("k"))))
    return t.select("column", F.try_divide(cov, F.sqrt(F.greatest(vc * vy, F.lit(0.0)))).alias("r"), f.alias("f"), (F.col("k") - 1).alias("d1"), (n - F.col("k")).alias("d2"))


def _relation(df: DataFrame, columns: list[str], outcome: str | None, by_r: bool) -> DataFrame | None:
    """(column, relation) of columns of few levels: |r| of codes or 1 - p of F for a number, 1 - p of chi-square for a text."""
    columns = [c for c in columns if c != outcome]
    if outcome is None or not columns:
        return None
    if outcome in numeric_columns(df):
        m = level_moments(df, columns, outcome)
        value = F.abs("r") if by_r else 1 - on_rows(f_sf)("f", "d1", "d2")
    else:
        m = chi_squares(df, [(c, outcome) for c in columns]).select(F.col("first").alias("column"), "p")
        value = 1 - F.col("p")
    return m.select("column", F.coalesce(value, F.lit(0.0)).alias("relation"))


def _with_relation(scores: DataFrame, relation: DataFrame | None) -> DataFrame:
    if relation is None:
        return scores.withColumn("relation", F.lit(0.0))
    return scores.join(F.broadcast(relation), "column", "left").withColumn("relation", F.coalesce("relation", F.lit(0.0)))


def treatment_scores(df: DataFrame, columns: list[str], outcome: str | None = None, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Columns of two to five levels: how near the most frequent one is to a half, and the relation with the outcome."""
    u = _uniques(df, columns).where(F.col("n_unique").between(2, TREATMENT_LEVELS))
    names = [r["column"] for r in u.select("column").collect()]  # columns of the table
    s = _with_relation(u, _relation(df, names, outcome, True))
    balance = 1 - F.abs(F.col("most") / F.col("n") - 0.5) / 0.5
    return s.select("column", F.col("n_unique").alias("levels"), balance.alias("balance"), "relation", _within(weights[0] * balance + weights[1] * F.col("relation")).alias("score"))


def time_scores(df: DataFrame) -> DataFrame:
    """Dates (texts too, if 0.8 of them parse) by the share that parses, 0.3 out of 1900 to 2100; ordered numbers 0.8."""
    dates, numbers = date_columns(df), numeric_columns(df)
    texts = [c for c, t in df.dtypes if t == "string"]
    out = []
    if dates or texts:
        view = df.select(*[q(c).cast("timestamp").alias(c) for c in dates], *[as_date(q(c)).alias(c) for c in texts])
        filled = per_column(df, dates + texts, n=lambda c: F.count(c))
        s = per_column(view, dates + texts, lo=lambda c: F.year(F.min(c)), hi=lambda c: F.year(F.max(c)), parsed=lambda c: F.count(c)).join(F.broadcast(filled), "column")
        share = F.coalesce(F.try_divide("parsed", "n"), F.lit(0.0))
        out.append(s.select("column", F.when(share < 0.8, 0.0).when((F.col("lo") < 1900) | (F.col("hi") > 2100), 0.3).otherwise(share).alias("score")))
    if numbers:
        out.append(per_column(df, numbers, n=lambda c: F.count(c)).select("column", F.when(F.col("n") > 10, 0.8).otherwise(0.0).alias("score")))
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], "column string, score double")


def instrument_scores(df: DataFrame, columns: list[str], treatment: str, outcome: str) -> DataFrame:
    """|r(z, t)| (1 - |r(z, y)|)."""
    s = per_column(df, columns, rt=lambda c: corr(c.cast("double"), q(treatment).cast("double")), ry=lambda c: corr(c.cast("double"), q(outcome).cast("double")))
    return s.select("column", F.coalesce(_within(F.abs("rt") * (1 - F.abs("ry"))), F.lit(0.0)).alias("score"))


def group_scores(df: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """Columns of 2 to 20 levels: half their normalized entropy, half 1 - p of their relation with the outcome (F, or chi-square for a text)."""
    u = _uniques(df, [c for c in columns if c != outcome]).where(F.col("n_unique").between(*GROUP_LEVELS))
    names = [r["column"] for r in u.select("column").collect()]  # columns of the table
    entropy = F.least(F.col("entropy") / F.log2(F.col("n_unique").cast("double")), F.lit(1.0))
    return _with_relation(u, _relation(df, names, outcome, False)).select("column", F.col("n_unique").alias("levels"), entropy.alias("entropy"), "relation", _within(0.5 * entropy + 0.5 * F.col("relation")).alias("score"))


def id_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """0.7 share of distinct values in all rows + 0.3 normalized entropy, less for numbers of little spread and skew."""
    u = _uniques(df, columns)
    rows = F.lit(df.count())
    numbers = [c for c in columns if c in numeric_columns(df)]
    if numbers:
        s = per_column(df, numbers, v=lambda c: F.var_samp(c), w=lambda c: (F.max(c) - F.min(c)).cast("double"), g=lambda c: F.skewness(c), m=lambda c: F.count(c))
        plain = F.coalesce((F.col("v") / (F.col("w") + EPS) < 0.01) & (F.abs(_skew(F.col("m"), F.col("g"))) < 0.3), F.lit(False))
        u = u.join(F.broadcast(s.select("column", F.when(plain, 0.3).otherwise(0.0).alias("plain"))), "column", "left")
    else:
        u = u.withColumn("plain", F.lit(0.0))
    entropy = F.coalesce(F.least(F.try_divide("entropy", F.log2(F.col("n_unique").cast("double"))), F.lit(1.0)), F.lit(0.0))
    score = 0.7 * F.least(F.try_divide("n_unique", rows), F.lit(1.0)) + 0.3 * entropy - 0.2 * F.coalesce("plain", F.lit(0.0))
    return u.select("column", _within(score).alias("score"))


def pick_user_id(df: DataFrame, taken: list[str | None]) -> DataFrame:
    """The column, neither taken nor a date, with at least half as many values as rows, of the best 0.7 distinct share + 0.3 (1 - normalized entropy)."""
    columns = [c for c in df.columns if c not in taken and c not in date_columns(df)]
    rows = F.lit(df.count())
    k = F.col("n_unique").cast("double")
    score = 0.7 * F.try_divide(k, rows) + 0.3 * (1 - F.col("entropy") / F.log2(F.greatest(k, F.lit(2.0))))
    return _uniques(df, columns).where(k >= 0.5 * rows).select("column", score.alias("score")).orderBy(F.desc("score"), "column").limit(1)


#: Roles in the order in which ties are decided.
ROLES = ("outcome", "treatment", "id", "time", "instrument", "group")


def decide(scores: DataFrame) -> DataFrame:
    """The role of the largest score of each column of (column, role, score), and how sure it is."""
    place = reduce(lambda w, i: w.when(F.col("role") == ROLES[i], -i), range(len(ROLES)), F.when(F.lit(False), 0))
    best = scores.groupBy("column").agg(F.max(F.struct("score", place.alias("at"), "role")).alias("b")).select("column", "b.role", "b.score")
    return best.withColumn("confidence", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.5, "low").otherwise("very_low"))


def encode(df: DataFrame, column: str) -> DataFrame:
    """Rows with an integer code of a category: its place among the distinct values in order, from 0."""
    levels = df.select(q(column).alias("_v")).where("_v IS NOT NULL").distinct()
    codes = levels.withColumn(f"{column}_code", F.row_number().over(Window.orderBy("_v")) - 1)  # levels only
    return df.join(F.broadcast(codes) if codes.count() <= 100_000 else codes, q(column) == F.col("_v"), "left").drop("_v")


def auto_config(df: DataFrame) -> DataFrame:
    """(role, column) that the effect analyses would take: outcome, treatment, group, instrument, time, user, duration, event, covariates.

    Numbers, dates and texts by their types in Spark (infer them first); a text of two values can be a treatment or an
    event.  Instruments are numbers, or texts of at most 20 levels by their codes.  A role that nothing fits has no row,
    where the reference makes up a random group and a running number as time.
    """
    numbers, dates = numeric_columns(df), date_columns(df)
    texts = [c for c, t in df.dtypes if t in ("string", "boolean")]
    first = lambda x: next((r["column"] for r in x.take(1)), None)
    u = {r["column"]: r for r in _uniques(df, numbers + texts).collect()} if numbers or texts else {}  # a row for each column
    levels = lambda c: u[c]["n_unique"] if c in u else 0
    two = [c for c in texts if levels(c) == 2]
    outcome = first(outcome_ranking(df, numbers, 1)) if numbers else None
    treatment = first(treatment_scores(df, two, outcome, (0.65, 0.35)).orderBy(F.desc("score"), "column")) if two else None
    groups = sorted((c for c in texts if GROUP_LEVELS[0] <= levels(c) <= GROUP_LEVELS[1] and dict(df.dtypes)[c] == "string"), key=lambda c: (-u[c]["entropy"], c))
    group = groups[0] if groups else None
    instrument = None
    if treatment:
        coded = encode(df, treatment)
        t = f"{treatment}_code"
        few = [c for c in texts if 2 <= levels(c) <= GROUP_LEVELS[1] and c != treatment]
        plain = [c for c in numbers if levels(c) >= 2 and c != outcome]
        parts = []
        if plain:
            parts.append(per_column(coded, plain, t=lambda c: corr(c.cast("double"), q(t).cast("double")), y=lambda c: corr(c.cast("double"), q(outcome).cast("double")) if outcome else F.lit(0.0)))
        if few:
            own = level_moments(coded, few, t).select("column", F.col("r").alias("t"))
            parts.append(own.join(level_moments(coded, few, outcome).select("column", F.col("r").alias("y")), "column") if outcome else own.withColumn("y", F.lit(0.0)))
        if parts:
            gain = F.abs("t") - F.coalesce(F.abs("y"), F.lit(0.0))
            instrument = first(reduce(DataFrame.unionByName, parts).select("column", gain.alias("gain")).where("gain > 0.05").orderBy(F.desc("gain"), "column"))
    lasting = None
    if numbers:
        s = per_column(df, numbers, n=lambda c: F.count(c), lo=lambda c: F.min(c).cast("double"), g=lambda c: F.skewness(c)).where("n > 5 AND lo >= 0")
        lasting = first(s.select("column", F.abs(_skew(F.col("n"), F.col("g"))).alias("x")).orderBy(F.desc_nulls_last("x"), "column"))
    time = dates[0] if dates else lasting
    user = first(pick_user_id(df, [outcome, treatment, time]))
    rare = sorted(two, key=lambda c: (u[c]["least"] / u[c]["n"], c))
    event = rare[0] if rare else None
    found = {"outcome": outcome, "treatment": treatment, "group": group, "instrument": instrument, "time": time, "user": user, "duration": lasting, "event": event}
    rows = [(r, c) for r, c in found.items() if c] + [("covariate", c) for c in numbers if c not in found.values()]
    return df.sparkSession.createDataFrame(rows, "role string, column string")
