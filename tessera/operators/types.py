"""Types of raw columns: null tokens, inference by parse ratios, dates, schema reports, patterns, names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import no_nan, numeric_columns, per_column, q, value_counts
from tessera.functions.frequencies import distinct_values, most_frequent, smallest_values
from tessera.functions.tables import written
from tessera.operators.dates import as_date, date_figures, read_values

#: Texts that mean null when tables are read, and when columns are understood.
NULL_TOKENS = ("", "null", "NULL", "n/a", "N/A")
LOOSE_NULL_TOKENS = ("", " ", "NA", "N/A", "null", "NULL", "-", "--")
#: The formats among which the commonest is sought.
FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXX")
PATTERNS = {"email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$", "phone": r"^\+?[0-9][0-9 ()-]{6,}$", "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", "zipcode": r"^[0-9]{5}(-[0-9]{4})?$"}
BOOLEAN = ("true", "false", "0", "1")


def normalize_nulls(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Trims texts and turns null tokens, NaN and infinities into nulls."""
    kinds = dict(df.dtypes)

    def one(name: str) -> Column:
        c = q(name)
        if kinds[name] == "string":
            t = F.trim(c)
            return F.when(~t.isin(*tokens), t)
        return no_nan(c) if kinds[name] in ("double", "float") else c

    return df.select(*[one(c).alias(c) for c in df.columns])


def parse_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each text column: non-null values and the shares that parse as number, date and boolean, unique values, and whether dates put the month first.

    Dates are sought among distinct values.
    """
    share = lambda c, x: F.try_divide(F.count(x), F.count(c))
    base = per_column(
        df,
        columns,
        n=lambda c: F.count(c),
        numeric=lambda c: share(c, c.try_cast("double")),
        booleans=lambda c: share(c, F.when(F.lower(c).isin(*BOOLEAN), 1)),
    )
    out = base.join(F.broadcast(date_figures(df, columns)), "column", "left").withColumns({"n_unique": F.coalesce("n_unique", F.lit(0)).cast("long"), "month_first": F.coalesce("month_first", F.lit(False))})
    return out.select("column", "n", "numeric", F.try_divide(F.coalesce("n_dates", F.lit(0)), F.col("n")).alias("dates"), "booleans", "n_unique", "month_first", "first", "last")


def infer_types(df: DataFrame, columns: list[str], numeric: float = 0.9, dates: float = 0.9) -> DataFrame:
    """numeric, datetime, boolean, categorical or string for each text column, in that order of tests; ``month_first`` is the order of its dates."""
    r = parse_ratios(df, columns).drop("first", "last")
    kind = (
        F.when(F.col("n") == 0, "categorical")
        .when(F.col("numeric") >= numeric, "numeric")
        .when(F.col("dates") >= dates, "datetime")
        .when(F.col("booleans") > 0.95, "boolean")
        .when(F.col("n_unique") / F.col("n") < 0.1, "categorical")
        .otherwise("string")
    )
    return r.withColumn("type", kind)


def standardize(df: DataFrame) -> DataFrame:
    """Text columns cast to their inferred types; values that don't parse become null; native types stay.

    Dates are read in the order of day and month that the column's own values show, day first where they show none.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    found = infer_types(df, texts).select("column", "type", "month_first").collect() if texts else []
    kinds = {r["column"]: r["type"] for r in found}
    month_first = {r["column"] for r in found if r["month_first"]}
    boolean = lambda c: F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False)

    def cast(name: str) -> Column:
        kind, c = kinds.get(name, ""), q(name)
        return c.try_cast("double") if kind == "numeric" else as_date(c, name in month_first) if kind == "datetime" else boolean(c) if kind == "boolean" else c

    return df.select(*[cast(c).alias(c) for c in df.columns])


def date_readings(df: DataFrame, column: str) -> DataFrame:
    """Values, the share that parses, and the share whose day-first and month-first readings differ."""
    share = lambda x: F.try_divide(F.sum(F.when(x, F.col("n")).otherwise(0)), F.sum("n"))
    return read_values(df, [column]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), share(F.col("read").isNotNull()).alias("success_ratio"), share(F.col("read.either")).alias("ambiguous_ratio"))


#: Values that a column's enumeration holds at most; a column of more has none.
MAX_ENUM = 1000


def column_schema(df: DataFrame, examples: int = 3) -> DataFrame:
    """Type, format, smallest and largest value, examples (the smallest texts), enumeration, non-nulls, nulls, unique values and average length of each column.

    A text whose values are less than a tenth unique is categorical and has its values, in order, as its enumeration.
    """
    columns = df.columns
    kinds = dict(df.dtypes)
    base = per_column(df, columns, lo=lambda c: F.min(c).cast("string"), hi=lambda c: F.max(c).cast("string"), non_null=lambda c: F.count(c), nulls=lambda c: F.count_if(c.isNull()), avg_length=lambda c: F.avg(F.length(c.cast("string"))))
    unique = distinct_values(df, columns)
    kind = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])[F.col("column")]
    out = base.join(F.broadcast(unique), "column", "left").withColumns({"type": kind, "n_unique": F.coalesce("n_unique", F.lit(0)).cast("long")})
    out = written(out.withColumn("listed", (F.col("type") == "string") & (F.col("n_unique") < 0.1 * F.col("non_null")) & (F.col("n_unique") <= MAX_ENUM)), "schema")
    # Only columns of few values are listed; the smallest values of the others are found without listing them.
    lists = [r["column"] for r in out.where("listed").select("column").collect()]
    if lists:
        values = value_counts(df, lists).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
        out = out.join(F.broadcast(values), "column", "left")
    else:
        out = out.withColumn("values", F.lit(None).cast("array<string>"))
    out = out.join(F.broadcast(smallest_values(df, columns, examples)), "column", "left")
    form = F.when(F.col("type").rlike("^(date|timestamp)"), "date-time")
    return out.select("column", "type", form.alias("format"), "lo", "hi", F.coalesce("smallest", F.array()).alias("examples"), F.when(F.col("listed"), F.col("values")).alias("enum"), "non_null", "nulls", "avg_length", "n_unique")


def date_format(df: DataFrame, column: str, key: str, formats: tuple[str, ...] = FORMATS, rows: int = 100, least: float = 0.5) -> DataFrame:
    """The format that most of the first ``rows`` values (by key) follow, if ``least`` of them do; ties by order of the list."""
    first = df.where(q(column).isNotNull()).orderBy(key).limit(rows)
    shares = first.agg(*[(F.count(F.try_to_timestamp(q(column), F.lit(f))) / F.count(q(column))).alias(str(i)) for i, f in enumerate(formats)])
    rows_ = shares.select(F.inline(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(i).alias("i"), F.col(f"`{i}`").alias("share")) for i, f in enumerate(formats)])))
    return rows_.where(F.col("share") >= least).orderBy(F.desc("share"), "i").limit(1).select("format", "share")


def understand(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """numeric, datetime, boolean, categorical, multi-select or text, after loose null tokens are dropped, with the figures of that kind.

    lo, hi, mean and std of numbers, first and last day of dates, the ``top`` values of categories, the average length of others.
    """
    native = set(numeric_columns(df))
    clean = normalize_nulls(df.select(*[q(c).cast("string").alias(c) for c in columns]), LOOSE_NULL_TOKENS)
    r = parse_ratios(clean, columns)
    number = lambda c: c.try_cast("double")
    stats = per_column(
        clean,
        columns,
        multi=lambda c: F.coalesce(F.bool_or(c.rlike("[;,|]")), F.lit(False)),
        n_rows=lambda c: F.count(F.lit(1)),
        lo=lambda c: F.min(number(c)),
        hi=lambda c: F.max(number(c)),
        mean=lambda c: F.avg(number(c)),
        std=lambda c: F.stddev_samp(number(c)),
        avg_length=lambda c: F.avg(F.length(c)),
    )
    best = most_frequent(clean, columns, top).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("top"))
    kind = (
        F.when(F.col("column").isin(*native), "numeric")
        .when((F.col("booleans") == 1) & (F.col("n_unique") <= 2), "boolean")
        .when(F.col("numeric") > 0.6, "numeric")
        .when(F.col("dates") > 0.8, "datetime")
        .when((F.col("n_unique") <= 50) | ((F.col("n_rows") > 100) & (F.col("n_unique") / F.col("n_rows") < 0.05)), "categorical")
        .when(F.col("multi"), "multi-select")
        .otherwise("text")
    )
    out = r.join(F.broadcast(stats), "column").join(best, "column", "left").withColumns({"kind": kind, "first_day": F.col("first").cast("date"), "last_day": F.col("last").cast("date")})
    only = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), F.col(c)).alias(c)
    return out.select("column", "n", "n_unique", "kind", *[only(c, "numeric") for c in ("lo", "hi", "mean", "std")], only("first_day", "datetime"), only("last_day", "datetime"), only("top", "categorical"), only("avg_length", "text", "multi-select", "boolean"))


def semantic_types(df: DataFrame) -> DataFrame:
    """id_like, time_series, boolean, numeric, text or categorical, in that order of tests, with role, average length and unique values."""
    kinds = dict(df.dtypes)
    base = per_column(df, df.columns, n=lambda c: F.count(c), n_rows=lambda c: F.count(F.lit(1)), avg_length=lambda c: F.avg(F.length(c.cast("string"))), others=lambda c: F.count_if(~c.cast("string").isin("0", "1", "true", "false")))
    unique = distinct_values(df, df.columns)
    native = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit("date" if kinds[c].startswith(("date", "timestamp")) else "text" if kinds[c] == "string" else "number"))])[F.col("column")]
    kind = (
        F.when(F.try_divide("n_unique", "n_rows") >= 0.9, "id_like")
        .when(native == "date", "time_series")
        .when(F.col("others") == 0, "boolean")
        .when(native == "number", "numeric")
        .when((F.col("avg_length") > 50) | (F.col("n_unique") > 100), "text")
        .otherwise("categorical")
    )
    role = F.create_map(*[F.lit(x) for pair in {"id_like": "id", "time_series": "time_index", "boolean": "categorical", "numeric": "numeric", "text": "text", "categorical": "categorical"}.items() for x in pair])
    out = base.join(F.broadcast(unique), "column", "left").withColumns({"n_unique": F.coalesce("n_unique", F.lit(0)).cast("long")}).withColumn("semantic_type", kind)
    return out.select("column", "n", "n_unique", "avg_length", "semantic_type", role[F.col("semantic_type")].alias("role"))


def downcast_plan(df: DataFrame, columns: list[str]) -> DataFrame:
    """The smallest integer type that holds each column, or float where it loses nothing, else double."""
    r = per_column(df, columns, lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"), broken=lambda c: F.count_if(c.cast("double") != F.floor(c.cast("double"))), lossy=lambda c: F.count_if(c.cast("float").cast("double") != c.cast("double")))
    within = lambda b: (F.col("lo") >= -(2 ** (b - 1))) & (F.col("hi") <= 2 ** (b - 1) - 1)
    kind = F.when(F.col("broken") == 0, F.when(within(8), "tinyint").when(within(16), "smallint").when(within(32), "int").otherwise("bigint")).when(F.col("lossy") == 0, "float").otherwise("double")
    return r.select("column", "lo", "hi", kind.alias("smallest_type"))


def patterns(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """The first pattern that more than ``least`` of the non-null values match."""
    shares = per_column(df, columns, **{k: (lambda p: lambda c: F.avg(c.rlike(p).cast("double")))(p) for k, p in PATTERNS.items()})
    found = F.coalesce(*[F.when(F.col(k) > least, F.lit(k)) for k in PATTERNS])
    return shares.select("column", found.alias("pattern"))


def mixed_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that read as integers, other numbers, booleans, dates and texts; mixed if more than one kind occurs. A value's kind is found once."""
    c_int, c_num = r"^[+-]?[0-9]+$", r"^[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"
    kind = lambda c: F.when(c.rlike(c_int), "int").when(c.rlike(c_num), "double").when(F.lower(c).isin("true", "false"), "bool").when(as_date(c).isNotNull(), "date").when(c.isNotNull(), "text")
    names = ("int", "double", "bool", "date", "text")
    long = df.select(*[kind(q(c)).alias(c) for c in columns]).unpivot([], [q(c) for c in columns], "column", "kind")
    out = long.groupBy("column").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in names])
    n = sum(((F.col(f"n_{k}") > 0).cast("int") for k in names), F.lit(0))
    return out.withColumn("is_mixed", n > 1)


def clean_name(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", name.strip().lower())).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    """Clean column names; later ones that collide get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = clean_name(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)
