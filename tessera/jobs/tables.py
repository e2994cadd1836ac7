"""Queries of sources, types, cleaning and descriptive tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import per_column
from tessera.functions.tables import new_path
from tessera.jobs.profiles import missing_sql, union
from tessera.operators import clean as c
from tessera.operators import describe as d
from tessera.operators import profile as p
from tessera.operators import types as t
from tessera.operators.dates import orders, shapes
from tessera.sources import head, json_column, read_csv, read_json, sink, table, tail


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as texts, with bad tokens mixed in."""
    bad = F.when(F.col("o_orderkey") % 50 == 0, F.lit("N/A")).when(F.col("o_orderkey") % 50 == 1, F.lit("  "))
    o = table(spark, sf, "orders")
    # Days come with and without a time, ISO and day-first.
    k = F.col("o_orderkey") % 5
    stamp = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy HH:mm"))
    o = o.withColumn("stamp", F.coalesce(bad, stamp))
    return o.select("stamp", F.col("o_orderkey").cast("string").alias("key"), F.coalesce(bad, F.col("o_custkey").cast("string")).alias("cust"), F.coalesce(bad, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"), F.col("o_orderpriority").alias("priority"), F.concat(F.lit("flag"), F.col("o_orderkey").cast("string")).alias("note"))


RAW = """(SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' WHEN o_orderkey % 50 = 1 THEN '  ' ELSE o_custkey::VARCHAR END AS cust,
 CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' WHEN o_orderkey % 50 = 1 THEN '  ' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day, o_orderpriority AS priority, 'flag' || o_orderkey AS note,
 CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' WHEN o_orderkey % 50 = 1 THEN '  ' WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
 WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%d-%m-%Y %H:%M') END AS stamp FROM orders)"""
RAW_CLEAN = f"(SELECT {', '.join(f'''CASE WHEN trim({x}) NOT IN ('', 'null', 'NULL', 'n/a', 'N/A') THEN trim({x}) END AS {x}''' for x in ('key', 'cust', 'day', 'priority', 'note', 'stamp'))} FROM {RAW})"


def read_csv_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "customer-csv")
    table(spark, sf, "customer").write.csv(path, header=True)
    return t.standardize(read_csv(spark, path)).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def read_json_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "nested-json")
    table(spark, sf, "supplier").select("s_suppkey", F.struct(F.col("s_nationkey").alias("nation"), F.struct(F.col("s_acctbal").alias("balance")).alias("money")).alias("at")).write.json(path)
    flat = read_json(spark, path, lines=True)
    return flat.select("s_suppkey", F.col("`at.nation`").alias("nation"), F.col("`at.money.balance`").alias("balance"))


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of records as the lines of one array."""
    first, line = True, lambda *x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])
    yield line("[")
    for b in batches:
        values = b.column(0).to_pylist()
        yield line(*[v if first and not i else f", {v}" for i, v in enumerate(values)])
        first = first and not values
    yield line("]")


def as_arrays(df: DataFrame, path: str) -> None:
    """Writes rows as JSON files that each hold one array of records."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_bracketed, "value string").write.text(path)


def read_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Files of arrays of nested records, with braces, quotes and backslashes in texts."""
    path = new_path(spark, "json-array")
    c = table(spark, sf, "customer")
    as_arrays(c.select("c_custkey", F.concat(F.lit('{"\\} ['), "c_name", F.lit("\n]")).alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_acctbal").alias("balance")).alias("money")).alias("at")), path)
    flat = read_json(spark, path)
    return flat.select("c_custkey", F.length("name").cast("long").alias("length"), F.col("`at.nation`").alias("nation"), F.col("`at.money.balance`").alias("balance"))


def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A text column of JSON as columns of its own: events and the sum of ids by its value."""
    e = json_column(table(spark, sf, "events").select("event_id", "props"), "props", "k long")
    return e.groupBy(F.col("`props.k`").alias("k")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    keys = F.json_object_keys("props")
    return e.select(F.explode(keys).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def head_and_tail(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return head(o, "o_orderkey").unionByName(tail(o, "o_orderkey"))


def sink_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "sink")
    l = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))
    sink(l, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.round(F.sum("l_tax"), 4).alias("tax"))


def null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return per_column(t.normalize_nulls(raw_orders(spark, sf)), list(COLS), n=lambda x: F.count(x))


def inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(t.infer_types(t.normalize_nulls(raw_orders(spark, sf)), list(COLS)).drop("month_first"))


def date_readings(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(t.date_readings(t.normalize_nulls(raw_orders(spark, sf)), "day"))


#: Ways that exports write a day, with the same in SQL; the columns of ``exported``.
WRITTEN = {
    "us": ("MM/dd/yyyy", "strftime(o_orderdate, '%m/%d/%Y')"),
    "us_short": ("M/d/yy", "month(o_orderdate) || '/' || day(o_orderdate) || '/' || strftime(o_orderdate, '%y')"),
    "clock": ("MM/dd/yyyy h:mm a", "strftime(o_orderdate, '%m/%d/%Y') || ' 3:04 PM'"),
    "single": ("yyyy-M-d", "year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)"),
    "named": ("MMM d, yyyy", "strftime(o_orderdate, '%b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y')"),
    "spelled": ("d MMMM yyyy", "day(o_orderdate) || strftime(o_orderdate, ' %B %Y')"),
    "zoned": ("yyyy-MM-dd HH:mm:ss+00:00", "strftime(o_orderdate, '%Y-%m-%d 23:04:05+02:00')"),
    "basic": ("yyyy-MM-ddTHH:mm:ss+0000", "strftime(o_orderdate, '%Y-%m-%dT01:04:05-0330')"),
    "european": ("dd.MM.yyyy", "strftime(o_orderdate, '%d.%m.%Y')"),
}


def exported(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as texts in nine ways; every fiftieth is missing."""
    day = F.col("o_orderdate")
    text = lambda f: F.date_format(day, f)
    own = {"clock": F.concat(text("MM/dd/yyyy"), F.lit(" 3:04 PM")), "zoned": F.concat(text("yyyy-MM-dd"), F.lit(" 23:04:05+02:00")), "basic": F.concat(text("yyyy-MM-dd"), F.lit("T01:04:05-0330"))}
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", *[F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a")).otherwise(own.get(k, text(f))).alias(k) for k, (f, _) in WRITTEN.items()])


EXPORTED = "(SELECT o_orderkey, o_orderdate, " + ", ".join(f"CASE WHEN o_orderkey % 50 <> 0 THEN {x} END AS {k}" for k, (_, x) in WRITTEN.items()) + " FROM orders)"


def date_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The order of day and month of each exported column."""
    return orders(shapes(t.normalize_nulls(exported(spark, sf)), list(WRITTEN)))


def date_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of the dates of mixed columns."""
    o = exported(spark, sf)
    k = F.col("o_orderkey") % 6
    mixed = o.select(F.when(k == 0, F.col("us")).when(k == 1, F.col("named")).when(k == 2, F.col("clock")).when(k == 3, F.col("basic")).when(k == 4, F.lit("soon")).otherwise(F.col("spelled")).alias("mixed"), F.col("us_short"))
    return shapes(t.normalize_nulls(mixed), ["mixed", "us_short"])


def exported_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Exported columns after standardizing: their types, and how many values are the day they were written from."""
    s = t.standardize(t.normalize_nulls(exported(spark, sf)))
    kinds = dict(s.dtypes)
    one = per_column(s, list(WRITTEN), n=lambda x: F.count(x), right_day=lambda x: F.count_if(F.to_date(x) == F.to_date("o_orderdate")), hours=lambda x: F.coalesce(F.sum(F.hour(x)), F.lit(0)))
    kind = F.create_map(*[x for c in WRITTEN for x in (F.lit(c), F.lit(kinds[c]))])[F.col("column")]
    return one.withColumn("type", kind)


def standardized_times(spark: SparkSession, sf: str) -> DataFrame:
    s = t.standardize(t.normalize_nulls(raw_orders(spark, sf)).select("key", "stamp"))
    return s.groupBy(F.year("stamp").alias("year"), F.month("stamp").alias("month")).agg(F.count("*").alias("n"), F.sum(F.dayofmonth("stamp")).alias("days"))


def file_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p.file_summary(table(spark, sf, "orders"))


def column_schema(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(t.column_schema(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_type").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")))))


def date_format(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(t.date_format(table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")), "day", "o_orderkey"))


def understood(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(t.understand(raw_orders(spark, sf).withColumn("list", F.concat_ws(",", "priority", "key")), [*COLS, "list"]))


def semantic_types(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(t.semantic_types(table(spark, sf, "orders").withColumn("late", (F.col("o_orderkey") % 2).cast("int"))))


def downcast_plan(spark: SparkSession, sf: str) -> DataFrame:
    return t.downcast_plan(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"])


def pattern_columns(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    x = table(spark, sf, "customer").select(F.concat(F.lit("c"), k, F.lit("@shop.example.com")).alias("mail"), F.concat(F.lit("+1 212 "), F.lpad(k, 7, "5")).alias("call"), F.lpad(k, 5, "1").alias("zip"), "c_name")
    return t.patterns(x, ["mail", "call", "zip", "c_name"])


def mixed_types(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    v = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.lit("true")).otherwise(F.col("o_orderpriority"))
    return t.mixed_types(o.select(v.alias("v"), "o_orderpriority"), ["v", "o_orderpriority"])


def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return t.clean_names(table(spark, sf, "nation").toDF(" Nation Key ", "N--Name!", "n name"))


def cleaned_texts(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.lit("None")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("  "), F.upper("o_orderpriority"))).alias("v"))
    return c.clean_text(x, ["v"]).groupBy("v").agg(F.count("*").alias("n"))


def without_discount(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"))


def dropped_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return c.drop_incomplete(without_discount(spark, sf), ["l_discount"]).agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 4).alias("total"))


def filled_median(spark: SparkSession, sf: str) -> DataFrame:
    return c.fill_median(without_discount(spark, sf), ["l_discount"]).groupBy("l_discount").agg(F.count("*").alias("n"))


def expanded_lists(spark: SparkSession, sf: str) -> DataFrame:
    x = c.expand_lists(table(spark, sf, "part").select(F.regexp_replace("p_name", " ", ",").alias("p_name")), "p_name")
    flags = [n for n in x.columns if n != "p_name"]
    return x.agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in flags]).unpivot([], [F.col(f"`{n}`") for n in flags], "flag", "n")


def change_report(spark: SparkSession, sf: str) -> DataFrame:
    x = without_discount(spark, sf)
    return c.change_report(x, c.fill_median(x, ["l_discount"]))


def describe_categories(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(p.top_values(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"], 10))


def describe_dates(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.rounded(d.date_describe(table(spark, sf, n), x)).withColumn("of", F.lit(x)) for n, x in (("orders", "o_orderdate"), ("events", "ts"))])


def date_shares(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(d.date_shares(table(spark, sf, "orders"), "o_orderdate"))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(d.histogram(table(spark, sf, "customer"), "c_acctbal"), 4)


def box_plot(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(d.box(table(spark, sf, "lineitem").withColumn("v", F.pow("l_extendedprice", F.lit(3.0)) / 1e9), "v"), 4)


def bar_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p.rounded(p.top_values(table(spark, sf, "events"), ["event_type", "user_id"], 15))


def density_sample(spark: SparkSession, sf: str) -> DataFrame:
    return d.sample(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 5000)


def two_levels(spark: SparkSession, sf: str) -> DataFrame:
    return d.two_levels(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


QUERIES = {f.__name__: f for f in (read_csv_table, read_json_table, read_json_array, json_columns, json_props, head_and_tail, sink_round_trip, null_tokens, inferred_types, standardized_times, date_orders, date_shapes, exported_dates, file_summary, date_readings, column_schema, date_format, understood, semantic_types, downcast_plan, pattern_columns, mixed_types, clean_names, cleaned_texts, dropped_incomplete, filled_median, expanded_lists, change_report, describe_categories, describe_dates, date_shares, histogram, box_plot, bar_counts, density_sample, two_levels)}

COLS = ("key", "cust", "day", "priority", "note", "stamp")
NUMBER = r"regexp_matches({}, '^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$')"
CLOCKS = ("", " %H:%M", " %H:%M:%S", "T%H:%M", "T%H:%M:%S")


def parsed_sql(*days: str) -> str:
    """A text, if it isn't a plain number, by the first of the formats of a day, with or without a time."""
    formats = ", ".join(f"'{d}{c}'" for d in days for c in CLOCKS)
    return "CASE WHEN NOT regexp_matches({0}, '^\\s*[+-]?[0-9]+(\\.[0-9]*)?\\s*$') THEN try_strptime({0}, [" + formats + "]) END"


DAY = parsed_sql("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y")
MONTH = parsed_sql("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y")


def ratios_sql(columns, source) -> str:
    return union(f"""SELECT '{x}' AS "column", count({x}) AS n, count(try_cast({x} AS DOUBLE))::DOUBLE / count({x}) AS numeric, count({DAY.format(x)})::DOUBLE / count({x}) AS dates,
 count(*) FILTER (WHERE lower({x}) IN ('true', 'false', '0', '1'))::DOUBLE / count({x}) AS booleans, count(DISTINCT {x}) AS n_unique FROM {source}""" for x in columns)


def gaps_sql(column: str, source: str) -> str:
    return f"SELECT floor((epoch({column})::BIGINT - lag(epoch({column})::BIGINT) OVER (ORDER BY {column})) / 86400) AS g FROM {source} WHERE {column} IS NOT NULL"


def dates_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS of, count({column}) AS n, min({column})::DATE AS first_day, max({column})::DATE AS last_day, (max({column})::DATE - min({column})::DATE)::INT AS span_days,
 (SELECT quantile_cont(g, 0.5) FROM ({gaps_sql(column, source)}))::DOUBLE AS median_gap, (SELECT max(g) FROM ({gaps_sql(column, source)}))::BIGINT AS max_gap,
 (SELECT CASE WHEN m <= 1 THEN 'daily' WHEN m <= 7 THEN 'weekly' WHEN m <= 31 THEN 'monthly' ELSE m::INT || '-day' END FROM (SELECT quantile_cont(g, 0.5) AS m FROM ({gaps_sql(column, source)}))) AS frequency FROM {source}"""


def top_sql(columns, source: str, k: int) -> str:
    counts = union(f"SELECT '{x}' AS \"column\", {x}::VARCHAR AS value, count(*) AS n FROM {source} WHERE {x} IS NOT NULL GROUP BY ALL" for x in columns)
    return f"""SELECT "column", rank::INT AS rank, value, n, round(percent, 6) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY "column") AS percent FROM ({counts})) WHERE rank <= {k}"""


SPARSE = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount END AS l_discount FROM lineitem)"
FILLED = f"(SELECT l_orderkey, l_linenumber, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {SPARSE} AS m)) AS l_discount FROM {SPARSE} AS s)"
MIXED = "(SELECT CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN 'true' ELSE o_orderpriority END AS v, o_orderpriority FROM orders)"


def mixed_sql(x: str) -> str:
    kind = f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches({x}, '^[+-]?[0-9]*\\.?[0-9]+([eE][+-]?[0-9]+)?$') THEN 'double' WHEN lower({x}) IN ('true', 'false') THEN 'bool' WHEN ({DAY.format(x)}) IS NOT NULL THEN 'date' WHEN {x} IS NOT NULL THEN 'text' END"
    each = ", ".join(f"count(*) FILTER (WHERE k = '{n}') AS n_{n}" for n in ("int", "double", "bool", "date", "text"))
    return f"SELECT '{x}' AS \"column\", {each}, count(DISTINCT k) > 1 AS is_mixed FROM (SELECT {kind} AS k FROM {MIXED})"


ORACLES = {
    "read_csv_table": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
    "read_json_table": "SELECT s_suppkey, s_nationkey::BIGINT AS nation, s_acctbal AS balance FROM supplier",
    "read_json_array": "SELECT c_custkey, (length(c_name) + 8)::BIGINT AS length, c_nationkey::BIGINT AS nation, c_acctbal AS balance FROM customer",
    "json_columns": "SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "json_props": "SELECT name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS name FROM events) GROUP BY 1",
    "head_and_tail": "(SELECT o_orderkey, o_custkey FROM orders ORDER BY 1 LIMIT 10) UNION ALL (SELECT o_orderkey, o_custkey FROM orders ORDER BY 1 DESC LIMIT 10)",
    "sink_round_trip": "SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 1) AS n_tax, round(sum(l_tax) FILTER (WHERE l_linenumber <> 1), 4) AS tax FROM lineitem",
    "null_tokens": union(f"SELECT '{x}' AS \"column\", count({x}) AS n FROM {RAW_CLEAN}" for x in COLS),
    "inferred_types": f"""SELECT "column", n, round(numeric, 6) AS numeric, round(dates, 6) AS dates, round(booleans, 6) AS booleans, n_unique,
 CASE WHEN n = 0 THEN 'categorical' WHEN numeric >= 0.9 THEN 'numeric' WHEN dates >= 0.9 THEN 'datetime' WHEN booleans > 0.95 THEN 'boolean' WHEN n_unique::DOUBLE / n < 0.1 THEN 'categorical' ELSE 'string' END AS type FROM ({ratios_sql(COLS, RAW_CLEAN)})""",
    "date_readings": f"SELECT count(day) AS n, round(count(coalesce({DAY.format('day')}, {MONTH.format('day')}))::DOUBLE / count(day), 6) AS success_ratio, round(count(*) FILTER (WHERE ({DAY.format('day')}) <> ({MONTH.format('day')}))::DOUBLE / count(day), 6) AS ambiguous_ratio FROM {RAW_CLEAN}",
    "standardized_times": f"SELECT year(d)::INT AS year, month(d)::INT AS month, count(*) AS n, sum(day(d))::BIGINT AS days FROM (SELECT {DAY.format('stamp')} AS d FROM {RAW_CLEAN}) GROUP BY 1, 2",
    "date_orders": union(
        f"""SELECT '{x}' AS "column", count({x}) AS n, count({x}) AS dates, {1} AS n_shapes, {day} AS day_over, {month} AS month_over, {either} AS either, {first} AS month_first FROM {EXPORTED}"""
        for x, day, month, either, first in (
            (k, *(("0::BIGINT",) * 3 if k not in ("us", "us_short", "clock", "european") else (over if k == "european" else "0::BIGINT", "0::BIGINT" if k == "european" else over, f"count({k}) FILTER (day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate))")), str(k in ("us", "us_short", "clock")).lower())
            for k in WRITTEN
            for over in (f"count({k}) FILTER (day(o_orderdate) > 12)",)
        )
    ),
    "date_shapes": f"""WITH m AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'd/d/yyyy' WHEN 1 THEN 'Mon d, yyyy' WHEN 2 THEN 'd/d/yyyy d:d am' WHEN 3 THEN 'yyyy-d-dtd:d:d zone' WHEN 4 THEN 'other' ELSE 'd Mon yyyy' END AS shape, o_orderkey % 6 IN (0, 2) AS numbers FROM {EXPORTED} WHERE us IS NOT NULL OR o_orderkey % 6 = 4)
SELECT 'mixed' AS "column", shape, count(*) AS n, 0::BIGINT AS day_over, count(*) FILTER (numbers AND day(o_orderdate) > 12) AS month_over, count(*) FILTER (numbers AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) AS either FROM m GROUP BY shape
UNION ALL SELECT 'us_short', 'd/d/d', count(*), 0, count(*) FILTER (day(o_orderdate) > 12), count(*) FILTER (day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) FROM {EXPORTED} WHERE us IS NOT NULL""",
    "exported_dates": union(f"""SELECT '{k}' AS "column", count({k}) AS n, count({k}) AS right_day, (count({k}) * { {'clock': 15, 'zoned': 21, 'basic': 4}.get(k, 0) })::BIGINT AS hours, 'timestamp' AS type FROM {EXPORTED}""" for k in WRITTEN),
    "file_summary": union(f"SELECT {i} AS at, '{x}' AS \"column\", '{k}' AS kind, {f'count(DISTINCT {x})' if k == 'categorical' else 'NULL::BIGINT'} AS n_unique, count(*) AS n_rows, 6 AS n_columns FROM orders" for i, (x, k) in enumerate((("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical")))),
    "column_schema": "WITH s AS (SELECT p_partkey, p_name, p_size, p_type, DATE '2020-01-01' + p_size AS day FROM part)\n" + union(f"""SELECT '{x}' AS "column", '{k}' AS type, {"'date-time'" if k == "date" else "NULL"} AS format, min({x})::VARCHAR AS lo, max({x})::VARCHAR AS hi, list_sort(list(DISTINCT {x}::VARCHAR))[1:3] AS examples, CASE WHEN '{k}' = 'string' AND count(DISTINCT {x}) < 0.1 * count({x}) AND count(DISTINCT {x}) <= 1000 THEN list_sort(list(DISTINCT {x}::VARCHAR)) END AS enum,
 count({x}) AS non_null, count(*) - count({x}) AS nulls, round(avg(length({x}::VARCHAR)), 6) AS avg_length, count(DISTINCT {x}) AS n_unique FROM s""" for x, k in (("p_partkey", "bigint"), ("p_name", "string"), ("p_size", "int"), ("p_type", "string"), ("day", "date"))),
    "date_format": """WITH f AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders ORDER BY o_orderkey LIMIT 100),
s AS (SELECT * FROM (SELECT 'dd/MM/yyyy' AS format, 1 AS i, count(try_strptime(day, '%d/%m/%Y'))::DOUBLE / count(*) AS share FROM f UNION ALL SELECT 'MM/dd/yyyy', 2, count(try_strptime(day, '%m/%d/%Y'))::DOUBLE / count(*) FROM f) WHERE share >= 0.5)
SELECT format, round(share, 6) AS share FROM s ORDER BY share DESC, i LIMIT 1""",
    "understood": f"""WITH w AS (SELECT {', '.join(f"CASE WHEN trim({x}) NOT IN ('', ' ', 'NA', 'N/A', 'null', 'NULL', '-', '--') THEN trim({x}) END AS {x}" for x in (*COLS, 'list'))} FROM (SELECT *, priority || ',' || key AS list FROM {RAW})),
r AS ({ratios_sql((*COLS, 'list'), 'w')}), m AS ({union(f"SELECT '{x}' AS " + '"column"' + f", coalesce(bool_or(regexp_matches({x}, '[;,|]')), false) AS multi, count(*) AS n_rows, min(try_cast({x} AS DOUBLE)) AS lo, max(try_cast({x} AS DOUBLE)) AS hi, round(avg(try_cast({x} AS DOUBLE)), 6) AS mean, round(stddev_samp(try_cast({x} AS DOUBLE)), 6) AS std, min({DAY.format(x)})::DATE AS first_day, max({DAY.format(x)})::DATE AS last_day, round(avg(length({x})), 6) AS avg_length, (SELECT list(v ORDER BY n DESC, v)[1:5] FROM (SELECT {x} AS v, count(*) AS n FROM w WHERE {x} IS NOT NULL GROUP BY 1)) AS top FROM w" for x in (*COLS, 'list'))}),
k AS (SELECT *, CASE WHEN booleans = 1 AND n_unique <= 2 THEN 'boolean' WHEN numeric > 0.6 THEN 'numeric' WHEN dates > 0.8 THEN 'datetime' WHEN n_unique <= 50 OR (n_rows > 100 AND n_unique::DOUBLE / n_rows < 0.05) THEN 'categorical' WHEN multi THEN 'multi-select' ELSE 'text' END AS kind FROM r JOIN m USING ("column"))
SELECT "column", n, n_unique, kind, CASE WHEN kind = 'numeric' THEN lo END AS lo, CASE WHEN kind = 'numeric' THEN hi END AS hi, CASE WHEN kind = 'numeric' THEN mean END AS mean, CASE WHEN kind = 'numeric' THEN std END AS std, CASE WHEN kind = 'datetime' THEN first_day END AS first_day, CASE WHEN kind = 'datetime' THEN last_day END AS last_day,
 CASE WHEN kind = 'categorical' THEN top END AS top, CASE WHEN kind IN ('text', 'multi-select', 'boolean') THEN avg_length END AS avg_length FROM k""",
    "semantic_types": "SELECT *, CASE semantic_type WHEN 'id_like' THEN 'id' WHEN 'time_series' THEN 'time_index' WHEN 'numeric' THEN 'numeric' WHEN 'text' THEN 'text' ELSE 'categorical' END AS role FROM (" + union(
        f"""SELECT '{x}' AS "column", count({x}) AS n, count(DISTINCT {x}) AS n_unique, round(avg({"19" if k == "date" else f"length({x}::VARCHAR)"}), 6) AS avg_length, CASE WHEN count(DISTINCT {x})::DOUBLE / count(*) >= 0.9 THEN 'id_like' WHEN '{k}' = 'date' THEN 'time_series' WHEN count(*) FILTER (WHERE {x}::VARCHAR NOT IN ('0', '1', 'true', 'false')) = 0 THEN 'boolean'
 WHEN '{k}' = 'number' THEN 'numeric' WHEN avg(length({x}::VARCHAR)) > 50 OR count(DISTINCT {x}) > 100 THEN 'text' ELSE 'categorical' END AS semantic_type FROM (SELECT *, o_orderkey % 2 AS late FROM orders)"""
        for x, k in (("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "date"), ("o_orderpriority", "text"), ("late", "number"))
    )
    + ")",
    "downcast_plan": union(
        f"""SELECT '{x}' AS "column", min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, CASE WHEN count(*) FILTER (WHERE {x}::DOUBLE <> floor({x}::DOUBLE)) = 0 THEN CASE WHEN min({x}) >= -128 AND max({x}) <= 127 THEN 'tinyint' WHEN min({x}) >= -32768 AND max({x}) <= 32767 THEN 'smallint'
 WHEN min({x}) >= -2147483648 AND max({x}) <= 2147483647 THEN 'int' ELSE 'bigint' END WHEN count(*) FILTER (WHERE {x}::FLOAT::DOUBLE <> {x}::DOUBLE) = 0 THEN 'float' ELSE 'double' END AS smallest_type FROM lineitem"""
        for x in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    ),
    "pattern_columns": """WITH s AS (SELECT 'c' || c_custkey || '@shop.example.com' AS mail, '+1 212 ' || lpad(c_custkey::VARCHAR, 7, '5') AS call, lpad(c_custkey::VARCHAR, 5, '1') AS zip, c_name FROM customer)
"""
    + union(
        f"""SELECT '{x}' AS "column", CASE WHEN avg(regexp_matches({x}, '^[\\w.+-]+@[\\w-]+\\.[\\w.-]+$')::INT) > 0.8 THEN 'email' WHEN avg(regexp_matches({x}, '^\\+?[0-9][0-9 ()-]{{6,}}$')::INT) > 0.8 THEN 'phone'
 WHEN avg(regexp_matches({x}, '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$')::INT) > 0.8 THEN 'uuid' WHEN avg(regexp_matches({x}, '^[0-9]{{5}}(-[0-9]{{4}})?$')::INT) > 0.8 THEN 'zipcode' END AS pattern FROM s"""
        for x in ("mail", "call", "zip", "c_name")
    ),
    "mixed_types": union(mixed_sql(x) for x in ("v", "o_orderpriority")),
    "clean_names": "SELECT n_nationkey AS nation_key, n_name AS n_name, n_regionkey AS n_name_2 FROM nation",
    "cleaned_texts": "SELECT v, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 1 THEN lower(trim(o_orderpriority)) ELSE 'no answer' END AS v FROM orders) GROUP BY 1",
    "dropped_incomplete": f"SELECT count(*) AS n, round(sum(l_discount), 4) AS total FROM {SPARSE} AS s WHERE l_discount IS NOT NULL",
    "filled_median": f"SELECT l_discount, count(*) AS n FROM {FILLED} GROUP BY 1",
    "expanded_lists": "SELECT 'p_name__' || v AS flag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS v FROM part) GROUP BY 1",
    "change_report": f"""SELECT coalesce(a."column", b."column") AS "column", a.missing AS missing_before, a.cells AS cells_before, b.missing AS missing_after, b.cells AS cells_after
FROM ({missing_sql(['l_orderkey', 'l_linenumber', 'l_discount'], SPARSE)}) a FULL JOIN ({missing_sql(['l_orderkey', 'l_linenumber', 'l_discount'], FILLED)}) b ON a."column" = b."column" """,
    "describe_categories": top_sql(("p_brand", "p_type", "p_name"), "part", 10),
    "describe_dates": union(dates_sql(x, s) for x, s in (("o_orderdate", "orders"), ("ts", "events"))),
    "date_shares": """SELECT part, value::INT AS value, n, round(n / sum(n) OVER (PARTITION BY part)::DOUBLE, 6) AS share FROM (SELECT 'weekday' AS part, isodow(o_orderdate) - 1 AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'month', month(o_orderdate), count(*) FROM orders GROUP BY ALL)""",
    "histogram": """WITH r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 20 AS w FROM customer), f AS (SELECT least(floor((c_acctbal - lo) / w), 19)::INT AS bin, count(*) AS n FROM customer, r GROUP BY 1)
SELECT k::INT AS bin, round(lo + k * w, 4) AS lo, round(lo + (k + 1) * w, 4) AS hi, coalesce(n, 0) AS n FROM range(20) g(k) CROSS JOIN r LEFT JOIN f ON bin = k""",
    "box_plot": """WITH s AS (SELECT pow(l_extendedprice, 3.0) / 1e9::DOUBLE AS v FROM lineitem), q AS (SELECT quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM s)
SELECT part, round(value, 4) AS value FROM (SELECT 'q1' AS part, q[1] AS value FROM q UNION ALL SELECT 'median', q[2] FROM q UNION ALL SELECT 'q3', q[3] FROM q
UNION ALL (SELECT 'outlier', v FROM s, q WHERE v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1]) ORDER BY abs(v - q[2]) DESC, v LIMIT 200))""",
    "bar_counts": top_sql(("event_type", "user_id"), "events", 15),
    "two_levels": """SELECT l_returnflag AS first, l_linestatus AS second, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, NULL, count(*) FROM lineitem GROUP BY ALL""",
}
