"""Queries of the profile operators on the test tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import profile as p
from tessera.sources import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["o_orderstatus", "o_orderpriority"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.corrected_moments(p.numeric_describe(table(spark, d, "lineitem"), NUM)), 4)


def missing_tables(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return p.rounded(p.missing_summary(docs))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return p.duplicate_rows(table(spark, d, "orders").select("o_custkey", *CAT))


def duplicate_sample(spark: SparkSession, d: str) -> DataFrame:
    return p.duplicate_sample(table(spark, d, "orders").select("o_custkey", *CAT))


def cardinality(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.cardinality(table(spark, d, "orders"), ["o_orderkey", "o_custkey", *CAT]))


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.top_values(table(spark, d, "orders"), ["o_custkey", *CAT]))


def diversity(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.diversity(table(spark, d, "orders"), ["o_custkey", *CAT]))


def parse_fractions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    bad = F.when(F.col("o_orderkey") % 50 == 0, F.lit("N/A"))
    return p.rounded(p.parse_fractions(o.select(F.coalesce(bad, F.col("o_custkey").cast("string")).alias("key"), F.coalesce(bad, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.col("o_orderpriority").alias("priority")), ["key", "day", "priority"]))


def multi_select(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.multi_select(table(spark, d, "part").select(F.regexp_replace("p_name", " ", ",").alias("p_name"), "p_brand"), ["p_name", "p_brand"]))


def numeric_advanced(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.numeric_advanced(table(spark, d, "lineitem"), NUM))


def benford(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.benford(table(spark, d, "lineitem"), "l_extendedprice"))


def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    return p.date_ranges(table(spark, d, "lineitem"), ["l_shipdate"]).unionByName(p.date_ranges(table(spark, d, "events"), ["ts"]))


def target_correlation(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.target_correlation(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_shipdate"], "l_extendedprice"))


def suggested_actions(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_extendedprice")).alias("cubed"), F.lit(1.0).alias("one"), F.when(F.col("l_discount") < 0.01, F.col("l_discount")).alias("rarely"))
    return p.suggested_actions(p.column_profile(l, l.columns))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return p.rounded(p.quality_score(table(spark, d, "documents").select("doc_id", "lang", "source", F.lit("x").alias("one")).join(table(spark, d, "labels"), "doc_id", "left")))


def insight_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumns({"one": F.lit(1), "skewed": F.pow("o_totalprice", F.lit(3.0))})
    return p.rounded(p.insight_flags(c.withColumn("gap", F.when(F.col("o_orderkey") % 2 == 0, F.col("c_acctbal"))), ["o_totalprice", "skewed", "gap"], ["o_orderstatus", "one", "c_name"], tested=0), 4)


def tested_flags(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return p.rounded(p.insight_flags(l, ["l_extendedprice", "l_quantity", "net"], ["l_returnflag", "l_linestatus"], silhouette=0.6, anomaly_share=0.05).where(F.col("rule").isin("anova", "chi_square", "silhouette", "anomalies")).drop("value"), 4)


def footprint(spark: SparkSession, d: str) -> DataFrame:
    return p.footprint(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (profile_numeric, missing_tables, duplicates, duplicate_sample, cardinality, top_values, diversity, parse_fractions, multi_select, numeric_advanced, benford, date_ranges, target_correlation, suggested_actions, quality_score, insight_flags, tested_flags, footprint)}


def describe_sql(columns: list[str], source: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", count({c}) AS n, min({c})::DOUBLE AS lo, q[1] AS q1, q[2] AS median, q[3] AS q3, max({c})::DOUBLE AS hi, avg({c}) AS mean, stddev_samp({c}) AS std,
 skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS skew, kurtosis_pop({c}) AS kurtosis, count(*) FILTER (WHERE {c} = 0) AS zeros,
 count(*) FILTER (WHERE {c} < q[1] - 1.5 * (q[3] - q[1]) OR {c} > q[3] + 1.5 * (q[3] - q[1])) AS outliers, skewness({c}) AS skew_corrected, kurtosis({c}) AS kurtosis_corrected
FROM {source} AS s, (SELECT quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM {source} AS t) GROUP BY q"""
        for c in columns
    )


def counts_sql(columns: list[str], source: str) -> str:
    return union(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY ALL" for c in columns)


def cardinality_sql(columns: list[str], source: str) -> str:
    return f"""SELECT *, CASE WHEN n_unique <= 1 THEN 'constant' WHEN unique_share = 1 THEN 'id' WHEN unique_share > 0.7 THEN 'high' WHEN unique_share < 0.05 THEN 'low' ELSE 'medium' END AS cardinality FROM (
{union(f"SELECT '{c}' AS " + '"column"' + f", count(DISTINCT {c}) AS n_unique, count(DISTINCT {c})::DOUBLE / count(*) AS unique_share FROM {source}" for c in columns)})"""


def missing_sql(columns: list[str], source: str) -> str:
    each = union(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS cells FROM {source}" for c in columns)
    return f"""SELECT *, missing * 100.0::DOUBLE / cells AS missing_pct, missing * 100.0::DOUBLE / cells > 50 AS over_half FROM (
WITH e AS ({each}) SELECT * FROM e UNION ALL SELECT '*', sum(missing)::BIGINT, sum(cells)::BIGINT FROM e)"""


def rounding(sql: str, doubles: str, others: str, digits: int = 6) -> str:
    return f"SELECT {', '.join(others.split())}, {', '.join(f'round({x}, {digits}) AS {x}' for x in doubles.split())} FROM ({sql})"


DUPLICATES = "SELECT sum(k)::BIGINT AS n_rows, sum(k - 1)::BIGINT AS duplicates, count(*) FILTER (WHERE k > 1) AS repeated_groups, max(k) AS largest_group FROM (SELECT count(*) AS k FROM {} AS r GROUP BY r)"
LABELLED = "(SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
SCORED = "(SELECT doc_id, lang, source, 'x' AS one, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
CUBED = "(SELECT l_orderkey, l_quantity, l_extendedprice * l_extendedprice * l_extendedprice AS cubed, 1.0::DOUBLE AS one, CASE WHEN l_discount < 0.01 THEN l_discount END AS rarely FROM lineitem)"
FLAGGED = "(SELECT *, 1 AS one, pow(o_totalprice, 3.0) AS skewed, CASE WHEN o_orderkey % 2 = 0 THEN c_acctbal END AS gap FROM orders JOIN customer ON o_custkey = c_custkey)"
PROFILE = 'SELECT d."column", d.n, d.skew_corrected AS skew, d.outliers::DOUBLE / m.cells AS outlier_share, m.cells AS n_rows, c.n_unique, c.unique_share, m.missing_pct FROM ({describe}) d JOIN ({cardinality}) c USING ("column") JOIN ({missing}) m USING ("column")'


def profile_sql(columns: list[str], source: str) -> str:
    return PROFILE.format(describe=describe_sql(columns, source), cardinality=cardinality_sql(columns, source), missing=missing_sql(columns, source))


FLAG_NUM, FLAG_CAT = ["o_totalprice", "skewed", "gap"], ["o_orderstatus", "one", "c_name"]
ORACLES = {
    "profile_numeric": rounding(describe_sql(NUM, "lineitem"), "lo q1 median q3 hi mean std skew kurtosis skew_corrected kurtosis_corrected", '"column" n zeros outliers', 4),
    "missing_tables": rounding(missing_sql(["doc_id", "lang", "quality", "toxic"], LABELLED), "missing_pct", '"column" missing cells over_half'),
    "duplicates": DUPLICATES.format("(SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders)"),
    "duplicate_sample": "SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n_copies FROM orders GROUP BY ALL HAVING count(*) > 1 ORDER BY 1, 2, 3 LIMIT 5",
    "cardinality": rounding(cardinality_sql(["o_orderkey", "o_custkey", *CAT], "orders"), "unique_share", '"column" n_unique cardinality'),
    "top_values": f"""SELECT "column", rank::INT AS rank, value, n, round(percent, 6) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY "column") AS percent FROM ({counts_sql(["o_custkey", *CAT], "orders")})) WHERE rank <= 5""",
    "diversity": f"""WITH c AS ({counts_sql(["o_custkey", *CAT], "orders")}), s AS (SELECT *, n / sum(n) OVER (PARTITION BY "column")::DOUBLE AS p FROM c)
SELECT "column", count(*) AS n_unique, round(-sum(p * log2(p)), 6) AS entropy, round(1 - sum(p * p), 6) AS gini, round(avg((p < 0.01)::INT), 6) AS rare_share FROM s GROUP BY 1""",
    "parse_fractions": f"""WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' ELSE o_custkey::VARCHAR END AS key, CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderpriority AS priority FROM orders)
{union(f"SELECT '{c}' AS " + '"column"' + f", round(count(try_cast({c} AS DOUBLE))::DOUBLE / count(*), 6) AS numeric, round(count(try_strptime({c}, '%Y-%m-%d'))::DOUBLE / count(*), 6) AS dates FROM s" for c in ("key", "day", "priority"))}""",
    "multi_select": f"""WITH s AS (SELECT replace(p_name, ' ', ',') AS p_name, p_brand FROM part)
{union(f"SELECT '{c}' AS " + '"column"' + f", round(avg(regexp_matches({c}, '[,;|]| / ')::INT), 6) AS share, avg(regexp_matches({c}, '[,;|]| / ')::INT) > 0.2 AS is_multi FROM s" for c in ("p_name", "p_brand"))}""",
    "numeric_advanced": union(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.99), 6) AS p99, round(stddev_samp({c}) / avg({c}), 6) AS cv,
 count(*) FILTER (WHERE abs(({c} - m) / s) > 2) AS z2, count(*) FILTER (WHERE abs(({c} - m) / s) > 3) AS z3, round(max(abs(({c} - m) / s)), 6) AS max_z,
 CASE WHEN abs(skewness({c})) < 0.5 THEN 'symmetric' WHEN abs(skewness({c})) < 1 THEN 'moderate' ELSE 'strong' END AS shape
FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"""
        for c in NUM
    ),
    "benford": """WITH d AS (SELECT CASE WHEN abs(l_extendedprice) < 1 THEN 0 ELSE substr(printf('%.6e', abs(l_extendedprice)), 1, 1)::INT END AS digit FROM lineitem WHERE abs(l_extendedprice) > 0),
s AS (SELECT digit, count(*)::DOUBLE / (SELECT count(*) FROM d) AS share FROM d GROUP BY 1)
SELECT round(sum(abs(coalesce(share, 0) - log10(1 + 1.0::DOUBLE / k))), 6) AS deviation, sum(abs(coalesce(share, 0) - log10(1 + 1.0::DOUBLE / k))) > 0.15 AS is_unusual FROM range(1, 10) r(k) LEFT JOIN s ON digit = k""",
    "date_ranges": union(f"""SELECT '{c}' AS "column", min({c})::DATE AS first_day, max({c})::DATE AS last_day, count({c}) AS n, year(min({c})) < 1900 OR year(max({c})) > 2100 AS is_odd FROM {t}""" for c, t in (("l_shipdate", "lineitem"), ("ts", "events"))),
    "target_correlation": union(f"""SELECT '{c}' AS "column", round(corr({x}, l_extendedprice), 6) AS r FROM lineitem""" for c, x in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_shipdate", "epoch(l_shipdate)::DOUBLE"))),
    "suggested_actions": f"""SELECT "column", unnest(list_filter([CASE WHEN missing_pct > 50 THEN 'drop_or_impute' END, CASE WHEN n_unique = n_rows AND n_rows > 1 THEN 'identifier' END, CASE WHEN n_unique <= 1 THEN 'constant' END,
 CASE WHEN n::DOUBLE / n_rows > 0.5 AND outlier_share > 0.01 THEN 'review_outliers' END, CASE WHEN unique_share > 0.95 AND n_unique > 50 AND n::DOUBLE / n_rows < 0.2 THEN 'high_cardinality' END, CASE WHEN abs(skew) > 2 THEN 'transform_skew' END], lambda x: x IS NOT NULL)) AS rule FROM ({profile_sql(["l_orderkey", "l_quantity", "cubed", "one", "rarely"], CUBED)})""",
    "quality_score": f"""WITH v AS (SELECT (SELECT missing_pct FROM ({missing_sql(["doc_id", "lang", "source", "one", "quality", "toxic"], SCORED)}) WHERE "column" = '*') AS missing_pct,
 (SELECT duplicates * 100.0::DOUBLE / n_rows FROM ({DUPLICATES.format(SCORED)})) AS duplicate_pct, (SELECT count(*) FILTER (WHERE cardinality = 'constant') FROM ({cardinality_sql(["doc_id", "lang", "source", "one", "quality", "toxic"], SCORED)})) AS constants),
s AS (SELECT *, (10 - CASE WHEN missing_pct > 20 THEN 4 WHEN missing_pct > 5 THEN 2 ELSE 0 END - CASE WHEN duplicate_pct > 5 THEN 3 WHEN duplicate_pct > 0 THEN 1 ELSE 0 END - CASE WHEN constants > 2 THEN 2 WHEN constants > 0 THEN 1 ELSE 0 END)::INT AS score FROM v)
SELECT round(missing_pct, 6) AS missing_pct, round(duplicate_pct, 6) AS duplicate_pct, constants, score, CASE WHEN score >= 9 THEN 'very good' WHEN score >= 7 THEN 'good' WHEN score >= 5 THEN 'fair' ELSE 'poor' END AS grade FROM s""",
    "insight_flags": f"""WITH s AS {FLAGGED}, n AS ({profile_sql(FLAG_NUM, "s")}), c AS ({cardinality_sql(FLAG_CAT, "s")}), m AS ({missing_sql(FLAG_NUM + FLAG_CAT, "s")}),
v AS ({counts_sql(FLAG_CAT, "s")}), t AS (SELECT "column", max(n) * 100.0::DOUBLE / sum(n) AS percent FROM v GROUP BY 1), d AS ({DUPLICATES.format("s")}),
g AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM (SELECT o_totalprice / 1e5 AS a, skewed / 1e15 AS b, gap / 1e4 AS c FROM s WHERE gap IS NOT NULL)),
e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g),
f AS (SELECT 'o_totalprice' AS "column", aa * (bb * cc - bc * bc) / det AS vif FROM e UNION ALL SELECT 'skewed', bb * (aa * cc - ac * ac) / det FROM e UNION ALL SELECT 'gap', cc * (aa * bb - ab * ab) / det FROM e)
SELECT rule, "column", round(value, 4) AS value, CASE WHEN rule = 'skew' THEN CASE WHEN value > 0 THEN 'right' ELSE 'left' END END AS level FROM (
SELECT 'missing' AS rule, "column", missing_pct::DOUBLE AS value FROM m WHERE "column" <> '*' AND missing_pct > 30 UNION ALL SELECT 'duplicates', '*', duplicates FROM d WHERE duplicates > 0
UNION ALL SELECT 'skew', "column", skew FROM n WHERE abs(skew) > 1 UNION ALL SELECT 'outliers', "column", outlier_share * n_rows / n FROM n WHERE outlier_share * n_rows > 0.05 * n UNION ALL SELECT 'dominant_value', "column", percent FROM t WHERE percent > 80
UNION ALL SELECT 'constant', "column", n_unique FROM c WHERE cardinality = 'constant' UNION ALL SELECT 'near_unique', "column", unique_share FROM c WHERE unique_share > 0.9 AND n_unique > 50 UNION ALL SELECT 'vif', "column", vif FROM f WHERE vif > 5 UNION ALL SELECT 'few_rows', '*', n_rows FROM d WHERE n_rows < 50)""",
    "footprint": union(f"""SELECT '{c}' AS "column", coalesce(sum({x}), 0)::BIGINT AS n_bytes FROM documents""" for c, x in (("doc_id", "8"), ("text", "octet_length(encode(text))"), ("lang", "octet_length(encode(lang))"), ("source", "octet_length(encode(source))"), ("n_chars", "8"))),
}
