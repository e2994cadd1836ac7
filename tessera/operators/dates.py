"""Dates in texts: the shapes of a column's values, its order of day and month, and its values as timestamps.

A value is brought into one canonical row of parts (year, month, day, clock, zone) by a few patterns; what no pattern fits is
no date.  ``shapes`` counts the shapes of all columns in one pass: digit runs, separators, month names and zones, hence a
number of rows that doesn't grow with the table.  Parts over 12 can only be days: they tell the order of a column, and values
that could be read either way follow it.

Plain numbers are no dates.  A month without a day is its first day; years of two digits are 1969 to 2068; a value with a
zone is that instant, one without is a time of the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.frequencies import SHORT, hashed_counts

#: Names of months and days of the week, in full or by three letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _named(names: tuple[str, ...]) -> str:
    return "|".join(n if len(n) == 3 else f"{n[:3]}(?:{n[3:]})?" for n in names).replace("sep(?:tember)?", "sep(?:t(?:ember)?)?")


_MON, _DAY = f"({_named(MONTHS)})", f"(?:{_named(WEEKDAYS)})"
_LEAD = rf"^\s*(?:{_DAY}[.,]?\s+)?"
#: hours, minutes, seconds, fraction, half of the day, zone
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\.?)?"
_ZONE = r"(?:\s*(z|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{2}))?"
_CLOCK = rf"(?:(?:t|,?\s+(?:at\s+)?){_TIME}{_ZONE})?\s*$"
_ORDINAL = r"(?:st|nd|rd|th)?"
#: Pattern -> the places of year, first part, second part, and of the clock's first part; a kind for each: y year first, n numbers, d day and name, m name and day.
_FAMILIES = (
    (rf"{_LEAD}(\d{{4}})([-/.])(\d{{1,2}})(?:\2(\d{{1,2}}))?{_CLOCK}", "y", 1, 3, 4, 5),
    (rf"{_LEAD}(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_CLOCK}", "n", 4, 1, 3, 5),
    (rf"{_LEAD}(\d{{1,2}}){_ORDINAL}[-\s/.]*(?:of\s+)?{_MON}\.?[-,\s/]*(\d{{4}}|\d{{2}}){_CLOCK}", "d", 3, 1, 2, 4),
    (rf"{_LEAD}{_MON}\.?[-\s/]*(\d{{1,2}}){_ORDINAL}(?:,\s*|[-\s/]+)(\d{{4}}){_CLOCK}", "m", 3, 1, 2, 4),
    (rf"{_LEAD}{_MON}\.?[-,\s/]*()(\d{{4}}){_CLOCK}", "m", 3, 1, 2, 4),
    (rf"{_LEAD}(\d{{4}})[-\s/.]{_MON}\.?[-\s/.](\d{{1,2}}){_CLOCK}", "m", 1, 2, 3, 4),
)
#: 20200105T030405, and "Wed Aug 27 13:08:45 +0000 2008".
_COMPACT = (r"^\s*(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?" + _ZONE + r"\s*$", "y|$1|$2|$3|$4|$5|$6|||$7")
_UNIX = (rf"^\s*{_DAY}\s+{_MON}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})\s*$", "m|$9|$1|$2|$3|$4|$5|$6|$7|$8")
_REWRITES = (
    *((p, f"{kind}|${y}|${a}|${b}|" + "|".join(f"${t + i}" for i in range(6))) for p, kind, y, a, b, t in _FAMILIES),
    _COMPACT,
    _UNIX,
)
#: Longer texts are no dates, nor are those that don't begin with a number or a name; told before any pattern is tried.
LONGEST, _START = SHORT, r"^\s*(?:\d{1,4}\D|\d{8}t|[a-z]{3})"


def _let(c: Column, body: str) -> Column:
    """``body``, SQL of ``p``, for a value that is computed once; text, since a tree of columns for each use is slow to build."""
    return F.call_function("transform", F.array(c), F.expr(f"p -> {body}"))[0]


_SPLIT = "split(CASE " + f"WHEN length(p) > {LONGEST} OR NOT rlike(p, r'{_START}') THEN NULL " + " ".join(f"WHEN rlike(p, r'{x}') THEN regexp_replace(p, r'{x}', r'{to}')" for x, to in _REWRITES) + " END, '[|]', -1)"


def parts(c: Column) -> Column:
    """kind, year, first, second, hour, minute, second, fraction, half, zone as an array of texts; null for what is no date."""
    return _let(F.lower(c), _SPLIT)


def _number(i: int) -> str:
    return f"try_cast(nullif(p[{i}], '') AS INT)"


_LETTERS = "".join(m[:3] for m in MONTHS)


def _month(i: int) -> str:
    """Of a name by its first three letters."""
    return f"CAST((instr('{_LETTERS}', left(p[{i}], 3)) + 2) / 3 AS INT)"


def _time(month_first: bool) -> str:
    """SQL of the timestamp of parts ``p``, null where there is no such time."""
    a, b, hour = _number(2), _number(3), _number(4)
    first, second = (a, b) if month_first else (b, a)  # month and day of two numbers, exchanged where only that can be
    swap = f"({first} > 12 AND {second} <= 12)"
    year = f"{_number(1)} + CASE WHEN length(p[1]) <> 2 THEN 0 WHEN {_number(1)} >= 69 THEN 1900 ELSE 2000 END"
    month = f"CASE p[0] WHEN 'y' THEN {a} WHEN 'n' THEN IF({swap}, {second}, {first}) WHEN 'd' THEN {_month(3)} ELSE {_month(2)} END"
    day = f"CASE p[0] WHEN 'n' THEN IF({swap}, {first}, {second}) WHEN 'd' THEN {a} ELSE coalesce({b}, 1) END"
    half = f"CASE WHEN p[8] = '' THEN {hour} WHEN {hour} NOT BETWEEN 1 AND 12 THEN NULL ELSE {hour} % 12 + IF(p[8] = 'p', 12, 0) END"  # 13 PM is none
    seconds = f"CAST(coalesce({_number(6)}, 0) + coalesce(try_cast('0.' || nullif(left(p[7], 6), '') AS DECIMAL(8,6)), 0) AS DECIMAL(16,6))"
    clock = f"IF(p[4] = '', 0, {half}), coalesce({_number(5)}, 0), {seconds}"
    digits = "rpad(regexp_replace(p[9], '[^0-9]', ''), 4, '0')"
    zone = f"CASE WHEN rlike(p[9], '^[a-z]') THEN 'UTC' WHEN left({digits}, 2) <= '17' AND right({digits}, 2) <= '59' THEN left(p[9], 1) || left({digits}, 2) || ':' || right({digits}, 2) END"
    return f"CASE WHEN p IS NULL THEN NULL WHEN p[9] = '' THEN try_make_timestamp({year}, {month}, {day}, {clock}) ELSE try_make_timestamp({year}, {month}, {day}, {clock}, {zone}) END"


_DAY_FIRST, _MONTH_FIRST = _time(False), _time(True)


def as_date(c: Column, month_first: bool = False) -> Column:
    """A text as a timestamp, null where it is no date; a part over 12 is the day in either order."""
    return _let(parts(c), _MONTH_FIRST if month_first else _DAY_FIRST)


def reading(c: Column) -> Column:
    """day_first, month_first (timestamps), day_over, month_over (a number over 12 tells the order), either (both orders are days); null for what is no date."""
    over = lambda i: f"p[0] = 'n' AND {_number(i)} > 12"
    either = f"p[0] = 'n' AND {_number(2)} <= 12 AND {_number(3)} <= 12 AND {_number(2)} <> {_number(3)}"
    fields = f"named_struct('day_first', {_DAY_FIRST}, 'month_first', {_MONTH_FIRST}, 'day_over', {over(2)}, 'month_over', {over(3)}, 'either', {either})"
    return _let(parts(c), f"CASE WHEN ({_DAY_FIRST}) IS NOT NULL THEN {fields} END")


def shape(c: Column) -> Column:
    """The shape of a date: year (yyyy), other digits (d), names (Mon, Day), AM or PM (am), zone; ``other`` for what is no date."""
    out = F.lower(F.trim(c))
    for pattern, to in (
        (rf"\b{_MON}\b", "Mon"),
        (rf"\b{_DAY}\b", "Day"),
        (r"(?<=\d)\s*[ap]\.?m\.?(?![a-z])", " am"),
        (r"(?<=:\d{2}|m|[.,]\d{1,9})\s*(z|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{2})(?=$| \d{4}$)", " zone"),
        (r"(?<=\d)(st|nd|rd|th)\b", ""),
        (r"\d{5,}", "D"),
        (r"\d{4}", "yyyy"),
        (r"\d{1,3}", "d"),
        (r"\s+", " "),
    ):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return out


def read_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, read) of distinct texts, ``read`` as of ``reading``: a value that is repeated is read once.

    Texts that are too long to be a date are counted by their hash; their value is null.
    """
    counts = hashed_counts(df, columns)
    return counts.select("column", F.when(F.col("h1").isNull(), F.col("head")).alias("value"), "n").withColumn("read", reading(F.col("value")))


def _sum(where: str) -> Column:
    return F.coalesce(F.sum(F.when(F.expr(where), F.col("n"))), F.lit(0)).cast("long")


def shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shape, n, day_over, month_over, either) of non-null texts: one pass over all columns.

    Of values of two numbers and a year: ``day_over`` have a first number over 12 alone (day first), ``month_over`` a second one
    (month first), ``either`` can be read both ways with different results.  Values that are no date are of the shape ``other``.
    """
    told = read_values(df, columns).withColumn("shape", F.when(F.col("read").isNotNull(), shape(F.col("value"))).otherwise("other"))
    return told.groupBy("column", "shape").agg(F.sum("n").alias("n"), *[_sum(f"read.{c}").alias(c) for c in ("day_over", "month_over", "either")])


def date_figures(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique, n_dates, month_first, first, last) of each column that has a value: dates in the order that the column shows."""
    over = F.coalesce(_sum("read.month_over") > _sum("read.day_over"), F.lit(False))
    edge = lambda f: F.when(over, f(F.col("read.month_first"))).otherwise(f(F.col("read.day_first")))
    return read_values(df, columns).groupBy("column").agg(F.count("*").alias("n_unique"), _sum("read IS NOT NULL").alias("n_dates"), over.alias("month_first"), edge(F.min).alias("first"), edge(F.max).alias("last"))


def orders(counted: DataFrame) -> DataFrame:
    """Of ``shapes``: (column, n, dates, n_shapes, day_over, month_over, either, month_first); month first where more parts tell so than the other way."""
    dates = F.col("shape") != "other"
    out = counted.groupBy("column").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(dates, F.col("n"))), F.lit(0)).alias("dates"), F.count_if(dates).alias("n_shapes"), *[F.sum(c).alias(c) for c in ("day_over", "month_over", "either")]
    )
    return out.withColumn("month_first", F.col("month_over") > F.col("day_over"))
