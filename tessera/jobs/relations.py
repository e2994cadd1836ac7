"""Queries of relations and time series, with the same in SQL."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.selection import group_quantiles
from tessera.jobs.profiles import union
from tessera.operators import profile as p
from tessera.operators import relate as r
from tessera.operators import timeseries as ts
from tessera.sources import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


LINES = "(SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


def crosstab(spark, sf):
    return p.rounded(r.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def correlations(spark, sf):
    return p.rounded(r.correlations(lines(spark, sf), [*NUM, "net"]))


#: Columns of ``wide``: as many as make an expression for each pair a large plan; some have nulls, one doesn't vary.
WIDE = {f"w{i}": f"nullif(({x} * {7 * i + 3}) % {11 + i}, {i % 5})" for i, x in enumerate(["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"] * 6)} | {"same": "l_linenumber * 0 + 3"}


def wide(spark, sf):
    return table(spark, sf, "lineitem").select(*[F.expr(x).cast("double").alias(k) for k, x in WIDE.items()])


WIDE_SQL = "(SELECT " + ", ".join(f"({x})::DOUBLE AS {k}" for k, x in WIDE.items()) + " FROM lineitem)"


def wide_correlations(spark, sf):
    """Correlations of 25 columns with nulls, by blocks of matrices."""
    return p.rounded(r.correlations(wide(spark, sf), list(WIDE)))


def group_quartiles(spark, sf):
    """Exact quartiles of prices by ship mode, the groups narrowed as large ones are."""
    found = group_quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 1.0], most=500)
    return found.select("l_returnflag", "l_linestatus", "n", *[F.round(F.col("quantiles")[i], 6).alias(f"q{i}") for i in range(5)])


def correlated_pairs(spark, sf):
    return p.rounded(r.correlated(lines(spark, sf), [*NUM, "net"]))


def correlation_clusters(spark, sf):
    return r.correlation_clusters(lines(spark, sf), [*NUM, "net"])


def numbers_by_category(spark, sf):
    return p.rounded(r.by_category(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]), 4)


def sankey(spark, sf):
    return r.sankey(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


def chi_square(spark, sf):
    o = table(spark, sf, "orders").withColumns({"urgent": F.col("o_orderpriority").startswith("1"), "final": F.col("o_orderstatus") == "F"})
    return p.rounded(reduce(DataFrame.unionByName, [r.chi_square(o, a, b).drop("p").withColumn("pair", F.lit(f"{a}-{b}")) for a, b in (("o_orderstatus", "o_orderpriority"), ("urgent", "final"))]))


def chi_square_p(spark, sf):
    """Status by priority has 8 degrees: an even number, for which the tail is a finite sum."""
    return p.rounded(r.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def anova(spark, sf):
    return p.rounded(r.anova(table(spark, sf, "events"), "event_type", "value").drop("p"))


def chi_squares(spark, sf):
    """All pairs of five columns at once, one of them of two levels with another."""
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 2).alias("odd"), F.nullif(F.col("o_custkey") % 7, F.lit(3)).alias("rest"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    return p.rounded(r.chi_squares(o, list(combinations(o.columns, 2))).drop("p"), 5)


def anovas(spark, sf):
    """Four numbers by three categories at once."""
    x = lines(spark, sf).withColumn("sparse", F.when(F.col("l_linenumber") > 1, F.col("l_tax")))
    return p.rounded(r.anovas(x, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "net", "l_tax", "sparse"]).drop("p"), 5)


def category_impact(spark, sf):
    return p.rounded(r.category_impact(lines(spark, sf), "l_returnflag", ["l_quantity", "net"]).drop("p"), 4)


def strongest_impact(spark, sf):
    return p.rounded(r.strongest_impact(r.category_impact(lines(spark, sf), "l_returnflag", ["l_quantity", "net"])), 4)


def anova_p(spark, sf):
    return p.rounded(r.anovas(table(spark, sf, "events"), ["event_type"], ["value"]).select("category", "p"), 4)


def impact_p(spark, sf):
    """Welch p-values of each group against the others."""
    return p.rounded(r.category_impact(lines(spark, sf), "l_returnflag", ["l_quantity", "net"]).select("value", "column", "p"), 5)


def mann_whitney_p(spark, sf):
    return p.rounded(r.mann_whitney(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity").select("p"), 4)


def spearman_p(spark, sf):
    return p.rounded(r.spearman(table(spark, sf, "customer"), "c_acctbal", "c_nationkey").select("p"), 4)


def spearman(spark, sf):
    return p.rounded(r.spearman(lines(spark, sf), "l_quantity", "net").drop("p"))


def kruskal(spark, sf):
    """Three groups: two degrees, for which the tail is exp(-h / 2)."""
    return p.rounded(r.kruskal(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


def mann_whitney(spark, sf):
    return p.rounded(r.mann_whitney(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity").drop("p"))


def group_medians(spark, sf):
    return p.rounded(r.group_medians(table(spark, sf, "events"), "event_type", "value"))


def vif_two(spark, sf):
    return p.rounded(r.vif(lines(spark, sf), ["l_quantity", "net"]))


def mutual_information(spark, sf):
    return p.rounded(r.mutual_information(lines(spark, sf), ["l_quantity", "net"], "l_returnflag"))


def scale_economies(spark, sf):
    return p.rounded(r.scale_economies(lines(spark, sf), "l_extendedprice", "net"))


def counterintuitive(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") - 50).alias("effect"), F.when(F.length("event_type") % 2 == 0, "positive").otherwise("neg").alias("sign"))
    return r.counterintuitive(e, "event_type", "effect", "sign")


def list_values(spark, sf):
    return p.rounded(r.list_values(table(spark, sf, "part").select(F.regexp_replace("p_name", " ", ",").alias("p_name")), "p_name"))


def top_variance(spark, sf):
    return p.rounded(r.top_variance(lines(spark, sf), [*NUM, "net"]), 2)


def scatter_sample(spark, sf):
    from tessera.operators.describe import sample

    return sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey", 500)


def period_sums(spark, sf):
    return reduce(DataFrame.unionByName, [p.rounded(ts.period_sums(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", x), 2).withColumn("unit", F.lit(x)) for x in "DWMQY"])


def daily(spark, sf):
    return ts.period_sums(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def decomposition(spark, sf):
    return p.rounded(ts.decompose(daily(spark, sf)), 2)


def rolling_outliers(spark, sf):
    return p.rounded(ts.rolling_outliers(daily(spark, sf), threshold=2.0), 4)


def outcome_by_time(spark, sf):
    return p.rounded(ts.outcome_by_time(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 4)


def impact_by_year(spark, sf):
    return p.rounded(r.category_impact(table(spark, sf, "orders"), F.year("o_orderdate"), ["o_totalprice"]).drop("p"), 4)


def calendar(spark, sf):
    return ts.calendar(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


def cohorts_monthly(spark, sf):
    return p.rounded(ts.cohort_retention(table(spark, sf, "orders"), "o_custkey", "o_orderdate"))


def cohorts_daily(spark, sf):
    return p.rounded(ts.cohort_retention(table(spark, sf, "events"), "user_id", "ts", "D"))


def lifetimes(spark, sf):
    o = table(spark, sf, "orders")
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))
    return o.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("duration"), (last["o_orderstatus"] == "F").cast("int").alias("event"))


def kaplan_meier(spark, sf):
    return p.rounded(ts.kaplan_meier(lifetimes(spark, sf), "duration", "event"))


QUERIES = {f.__name__: f for f in (crosstab, correlations, wide_correlations, group_quartiles, correlated_pairs, correlation_clusters, numbers_by_category, sankey, chi_square, chi_square_p, chi_squares, anova, anovas, anova_p, impact_p, mann_whitney_p, spearman_p, category_impact, strongest_impact, spearman, kruskal, mann_whitney, group_medians, vif_two, mutual_information, scale_economies, counterintuitive, list_values, top_variance, scatter_sample, period_sums, decomposition, rolling_outliers, outcome_by_time, impact_by_year, calendar, cohorts_monthly, cohorts_daily, kaplan_meier)}


def corr_sql(source: str) -> str:
    return union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {source}" for a, b in combinations([*NUM, "net"], 2))


def chi_sql(a: str, b: str, source: str) -> str:
    return f"""SELECT sum(pow(greatest(abs(n - e) - CASE WHEN k1 = 2 AND k2 = 2 THEN 0.5 ELSE 0 END, 0), 2) / e) AS chi2, ((any_value(k1) - 1) * (any_value(k2) - 1))::BIGINT AS degrees, any_value(t) AS t, any_value(k1) AS k1, any_value(k2) AS k2 FROM (
SELECT coalesce(c.n, 0) AS n, x.n * y.n / t.t::DOUBLE AS e, t, k1, k2 FROM (SELECT {a} AS a, count(*) AS n FROM {source} GROUP BY 1) x CROSS JOIN (SELECT {b} AS b, count(*) AS n FROM {source} GROUP BY 1) y
LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2) c ON c.a = x.a AND c.b = y.b, (SELECT count(*) AS t, count(DISTINCT {a}) AS k1, count(DISTINCT {b}) AS k2 FROM {source}) t)"""


URGENT = "(SELECT *, starts_with(o_orderpriority, '1') AS urgent, o_orderstatus = 'F' AS final FROM orders)"


def impact_sql(value: str, columns: list[str], source: str) -> str:
    long = union(f"SELECT ({value})::VARCHAR AS value, '{c}' AS \"column\", {c}::DOUBLE AS x FROM {source}" for c in columns)
    return f"""WITH l AS ({long}), v AS (SELECT DISTINCT value, "column" FROM l), s AS (SELECT v.value, v."column", count(*) FILTER (WHERE l.value = v.value) AS n, avg(x) FILTER (WHERE l.value = v.value) AS m, var_samp(x) FILTER (WHERE l.value = v.value) AS w, avg(x) AS tm,
 count(*) FILTER (WHERE l.value <> v.value) AS rn, avg(x) FILTER (WHERE l.value <> v.value) AS rm, var_samp(x) FILTER (WHERE l.value <> v.value) AS rw FROM v JOIN l ON l."column" = v."column" GROUP BY 1, 2)
SELECT value, "column", n, m AS group_mean, tm AS overall_mean, m - tm AS delta, (m - rm) / sqrt(((n - 1) * w + (rn - 1) * rw) / (n + rn - 2)) AS cohens_d, (m - rm) / sqrt(w / n + rw / rn) AS t,
 pow(w / n + rw / rn, 2) / (pow(w / n, 2) / (n - 1) + pow(rw / rn, 2) / (rn - 1)) AS degrees FROM s WHERE n >= 10"""


def rounded_sql(sql: str, others: str, doubles: str, digits: int = 6) -> str:
    return f"SELECT {', '.join([*others.split(), *(f'round({x}, {digits}) AS {x}' for x in doubles.split())])} FROM ({sql})"


IMPACT = "group_mean overall_mean delta cohens_d t degrees"
RANKS = "(SELECT *, avg(i) OVER (PARTITION BY x) AS rank FROM (SELECT *, row_number() OVER (ORDER BY x) AS i FROM ({}) b) c)"
DAILY = "(SELECT o_orderdate::DATE AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1)"
UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
LIFE = "(SELECT o_custkey, (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INT AS duration, (arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F')::INT AS event FROM orders GROUP BY 1)"


def cohort_sql(user: str, date: str, source: str, month: bool) -> str:
    at = f"date_trunc('month', {date})::DATE" if month else f"{date}::DATE"
    since = "((year(day) - year(cohort)) * 12 + month(day) - month(cohort))::INT" if month else "(day - cohort)::INT"
    return f"""WITH a AS (SELECT DISTINCT {user} AS u, {at} AS day FROM {source}), f AS (SELECT *, min(day) OVER (PARTITION BY u) AS cohort FROM a), c AS (SELECT cohort, {since} AS period_number, count(*) AS users FROM f GROUP BY 1, 2)
SELECT c.cohort, c.period_number, c.users, round(c.users::DOUBLE / b.users, 6) AS retention FROM c JOIN c b ON b.cohort = c.cohort AND b.period_number = 0"""


def integral_sql(f: str, upper: str) -> str:
    """Simpson's rule from 0 to ``upper`` of ``f``, SQL with ``{x}`` for its variable."""
    return f"(list_sum(list_transform(range(4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({f.format(x=f'(i * ({upper}) / 4000)')}))) * ({upper}) / 12000)"


def t_p_sql(t: str, v: str) -> str:
    """Two-sided p of Student's t by its density."""
    density = f"exp(lgamma((({v}) + 1) / 2) - lgamma(({v}) / 2)) / sqrt(({v}) * pi()) * pow(1 + {{x}} * {{x}} / ({v}), -(({v}) + 1) / 2)"
    return f"greatest(0, 1 - 2 * {integral_sql(density, f'least(abs({t}), 40)')})"


def f_p_sql(f: str, a: str, b: str) -> str:
    """The upper tail of F by its density, in the square root of the variable."""
    density = f"2 * exp(lgamma((({a}) + ({b})) / 2) - lgamma(({a}) / 2) - lgamma(({b}) / 2)) * pow(({a}) / ({b}), ({a}) / 2) * pow({{x}}, ({a}) - 1) * pow(1 + ({a}) * {{x}} * {{x}} / ({b}), -(({a}) + ({b})) / 2)"
    return f"greatest(0, 1 - {integral_sql(density, f'sqrt({f})')})"


NORMAL_P = "least(1, greatest(0, 1 - 2 * " + integral_sql("exp(-{x} * {x} / 2) / sqrt(2 * pi())", "least(abs(z), 40)") + "))"
PAIRED = "(SELECT o_orderstatus, o_orderpriority, o_orderkey % 2 AS odd, nullif(o_custkey % 7, 3) AS rest, o_orderpriority LIKE '1%' AS urgent FROM orders)"


def pair_chi_sql(a: str, b: str) -> str:
    """Chi-square over all cells, those that don't occur included."""
    return f"""SELECT '{a}' AS first, '{b}' AS second, round(chi2, 5) AS chi2, degrees, round(sqrt(chi2 / n / least(k1 - 1, k2 - 1)), 5) AS cramers_v FROM (
 SELECT sum(pow(abs(coalesce(o, 0) - r * c / n) - CASE WHEN k1 = 2 AND k2 = 2 THEN least(0.5, abs(coalesce(o, 0) - r * c / n)) ELSE 0 END, 2) / (r * c / n)) AS chi2, (k1 - 1) * (k2 - 1) AS degrees, n, k1, k2
 FROM (SELECT {a} AS a, count(*)::DOUBLE AS r FROM {PAIRED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) CROSS JOIN (SELECT {b} AS b, count(*)::DOUBLE AS c FROM {PAIRED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)
 LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {PAIRED} GROUP BY 1, 2) USING (a, b), (SELECT count(*)::DOUBLE AS n, count(DISTINCT {a}) AS k1, count(DISTINCT {b}) AS k2 FROM {PAIRED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY n, k1, k2) WHERE degrees > 0"""


def anova_sql(g: str, x: str) -> str:
    return f"""SELECT '{g}' AS category, '{x}' AS "column", round((b / (k - 1)) / (w / (n - k)), 5) AS f, k - 1 AS d1, n - k AS d2, round(b / (b + w), 5) AS eta2 FROM (
 SELECT count(*) AS k, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum((n - 1) * v) AS w, (SELECT count(*) FROM lineitem) AS n, min(n) AS least FROM (
 SELECT {g} AS g, count({x}) AS n, avg({x}) AS m, var_samp({x}) AS v FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN l_tax END AS sparse FROM {LINES}) GROUP BY 1 HAVING count({x}) > 0)) WHERE least >= 2 AND k >= 2"""


ORACLES = {
    "chi_squares": union(pair_chi_sql(a, b) for a, b in combinations(("o_orderstatus", "o_orderpriority", "odd", "rest", "urgent"), 2)),
    "anovas": union(anova_sql(g, x) for g in ("l_returnflag", "l_linestatus", "l_linenumber") for x in ("l_quantity", "net", "l_tax", "sparse")),
    "wide_correlations": "SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': {'NULL::DOUBLE' if 'same' in (a, b) else f'round(corr({a}, {b}), 6)'}}}" for a, b in combinations(WIDE, 2)) + f"], recursive := true) FROM {WIDE_SQL}",
    "group_quartiles": "SELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {x}), 6) AS q{i}" for i, x in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))) + " FROM lineitem GROUP BY ALL",
    "crosstab": """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2) SELECT x.a AS first, y.b AS second, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY x.a)::DOUBLE, 6) AS share
FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b""",
    "correlations": rounded_sql(corr_sql(LINES), "a b", "r"),
    "correlated_pairs": rounded_sql(corr_sql(LINES), "a b", "r") + " WHERE abs(r) > 0.9",
    "correlation_clusters": f"SELECT 'l_extendedprice' AS cluster, unnest(['l_extendedprice', 'net']) AS \"column\" WHERE (SELECT abs(corr(l_extendedprice, net)) >= 0.9 FROM {LINES})",
    "numbers_by_category": union(f"SELECT '{k}' AS by, {k} AS category, '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, count(*) AS n FROM lineitem GROUP BY {k}" for k in ("l_returnflag", "l_linestatus") for c in ("l_quantity", "l_extendedprice")),
    "sankey": """WITH q AS (SELECT list_distinct(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])) AS q FROM lineitem) SELECT l_returnflag AS category, len(list_filter(q, lambda e: l_quantity > e))::INT AS bin, count(*) AS n FROM lineitem, q GROUP BY 1, 2""",
    "chi_square": union(f"SELECT '{a}-{b}' AS pair, round(chi2, 6) AS chi2, degrees, round(sqrt(chi2 / t / (least(k1, k2) - 1)), 6) AS cramers_v FROM ({chi_sql(a, b, URGENT)})" for a, b in (("o_orderstatus", "o_orderpriority"), ("urgent", "final"))),
    "chi_square_p": f"SELECT round(chi2, 6) AS chi2, degrees, round(exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6), 6) AS p, round(sqrt(chi2 / t / (least(k1, k2) - 1)), 6) AS cramers_v FROM ({chi_sql('o_orderstatus', 'o_orderpriority', 'orders')})",
    "anova": """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), s AS (SELECT count(*) AS k, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum((n - 1) * v) AS w, sum(n)::BIGINT AS n FROM g)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, k - 1 AS d1, n - k AS d2, round(b / (b + w), 6) AS eta2 FROM s""",
    "impact_p": f"SELECT value, \"column\", round({t_p_sql('t', 'degrees')}, 5) AS p FROM ({impact_sql('l_returnflag', ['l_quantity', 'net'], LINES)})",
    "anova_p": f"""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS k, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum((n - 1) * v) AS w, sum(n)::DOUBLE AS n FROM g)
SELECT 'event_type' AS category, round({f_p_sql('f', '(k - 1)', '(n - k)')}, 4) AS p FROM (SELECT *, (b / (k - 1)) / (w / (n - k)) AS f FROM s)""",
    "spearman_p": f"""WITH a AS (SELECT row_number() OVER () AS id, c_acctbal, c_nationkey FROM customer), x AS (SELECT id, rank FROM {RANKS.format("SELECT id, c_acctbal AS x FROM a")} r1), y AS (SELECT id, rank FROM {RANKS.format("SELECT id, c_nationkey AS x FROM a")} r2),
 s AS (SELECT corr(x.rank, y.rank) AS rho, count(*)::DOUBLE AS n FROM x JOIN y USING (id)) SELECT round({t_p_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}, 4) AS p FROM s""",
    "category_impact": rounded_sql(impact_sql("l_returnflag", ["l_quantity", "net"], LINES), 'value "column" n', IMPACT, 4),
    "strongest_impact": f"""SELECT "column", arg_max(value, (abs(cohens_d), value)) AS value, round(arg_max(cohens_d, (abs(cohens_d), value)), 4) AS cohens_d, round(arg_max(delta, (abs(cohens_d), value)), 4) AS delta FROM ({impact_sql("l_returnflag", ["l_quantity", "net"], LINES)}) GROUP BY 1""",
    "spearman": f"""WITH a AS (SELECT row_number() OVER () AS id, l_quantity, net FROM {LINES}), x AS (SELECT id, rank FROM {RANKS.format("SELECT id, l_quantity AS x FROM a")} r1), y AS (SELECT id, rank FROM {RANKS.format("SELECT id, net AS x FROM a")} r2)
SELECT round(corr(x.rank, y.rank), 6) AS rho, count(*) AS n FROM x JOIN y USING (id)""",
    "kruskal": f"""WITH k AS (SELECT * FROM {RANKS.format("SELECT l_returnflag AS g, l_quantity AS x FROM lineitem")} r1), t AS (SELECT sum(pow(n, 3) - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM k GROUP BY x)), s AS (SELECT sum(r * r / n) AS r2, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT sum(rank) AS r, count(*) AS n FROM k GROUP BY g)),
h AS (SELECT (12 / (n * (n + 1)) * r2 - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS h, k - 1 AS degrees FROM s, t) SELECT round(h, 6) AS h, degrees, round(exp(-h / 2), 6) AS p FROM h""",
    "mann_whitney": f"""WITH k AS (SELECT * FROM {RANKS.format("SELECT l_linestatus AS g, l_quantity AS x FROM lineitem")} r1), t AS (SELECT sum(pow(n, 3) - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM k GROUP BY x)), s AS (SELECT g, sum(rank) AS r, count(*)::DOUBLE AS n FROM k GROUP BY g),
u AS (SELECT arg_min(r, g) - arg_min(n, g) * (arg_min(n, g) + 1) / 2 AS u, arg_min(n, g) AS a, arg_max(n, g) AS b FROM s)
SELECT round(u, 6) AS u, round((abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))), 6) AS z FROM u, t""",
    "group_medians": 'SELECT event_type AS "group", round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM events GROUP BY 1',
    "vif_two": f"""WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(net * net) AS b, sum(l_quantity * net) AS c FROM {LINES}) SELECT unnest(['l_quantity', 'net']) AS "column", round(a * b / (a * b - c * c), 6) AS vif FROM g""",
    "mutual_information": union(
        f"""SELECT '{c}' AS "column", round(sum(n / t * ln(n * t / (nb * nt))), 6) AS mutual_information FROM (SELECT n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY bin)::DOUBLE AS nb, sum(n) OVER (PARTITION BY g)::DOUBLE AS nt FROM (
SELECT l_returnflag AS g, len(list_filter(q, lambda e: {c} > e)) AS bin, count(*) AS n FROM {LINES}, (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM {LINES}) GROUP BY 1, 2))"""
        for c in ("l_quantity", "net")
    ),
    "scale_economies": f"SELECT round(corr(net, l_extendedprice), 6) AS r, round(corr(l_extendedprice, net / l_extendedprice), 6) AS r_unit, round(regr_slope(net, l_extendedprice) * 0.1 * avg(l_extendedprice) / avg(net) * 100, 6) AS change_pct FROM {LINES}",
    "counterintuitive": "SELECT event_type AS metric, count(*) AS n FROM events WHERE CASE WHEN length(event_type) % 2 = 0 THEN value - 50 < 0 ELSE value - 50 > 0 END GROUP BY 1",
    "list_values": """WITH c AS (SELECT v AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part) GROUP BY 1), e AS (SELECT -sum(n / t * log2(n / t)) AS entropy FROM (SELECT n, sum(n) OVER ()::DOUBLE AS t FROM c))
SELECT value, n, round(entropy, 6) AS entropy FROM c, e ORDER BY n DESC, value LIMIT 20""",
    "top_variance": f"SELECT * FROM ({union(f'''SELECT '{c}' AS {chr(34)}column{chr(34)}, round(var_samp({c}), 2) AS variance FROM {LINES}''' for c in [*NUM, 'net'])}) ORDER BY variance DESC LIMIT 3",
    "period_sums": union(f"SELECT '{k}' AS unit, date_trunc('{u}', o_orderdate)::DATE AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2" for k, u in UNITS.items()),
    "decomposition": f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS pos, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend FROM {DAILY} WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
m AS (SELECT pos % 7 AS slot, avg(value - trend) AS m FROM s WHERE trend IS NOT NULL GROUP BY 1), c AS (SELECT slot, m - avg(m) OVER () AS seasonal FROM m)
SELECT period, round(value, 2) AS value, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(value - trend - seasonal, 2) AS resid FROM s LEFT JOIN c ON slot = pos % 7""",
    "rolling_outliers": f"""SELECT period, round(value, 4) AS value, round(z, 4) AS z FROM (SELECT *, count(*) OVER w AS k, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM {DAILY} WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE k = 7 AND abs(z) > 2""",
    "outcome_by_time": union(f"SELECT '{k}' AS unit, date_trunc('{u}', o_orderdate)::DATE AS period, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 2" for k, u in UNITS.items() if k != "D"),
    "impact_by_year": rounded_sql(impact_sql("year(o_orderdate)", ["o_totalprice"], "orders"), 'value "column" n', IMPACT, 4),
    "calendar": "SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day, (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek FROM orders",
    "cohorts_monthly": cohort_sql("o_custkey", "o_orderdate", "orders", True),
    "cohorts_daily": cohort_sql("user_id", "ts", "events", False),
    "kaplan_meier": f"""WITH t AS (SELECT duration::DOUBLE AS time, count(*) AS n, count(*) FILTER (WHERE event = 1) AS events FROM {LIFE} GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY time DESC)::BIGINT AS at_risk FROM t)
SELECT time, at_risk, events, round(survival, 6) AS survival FROM (SELECT *, product(1 - events::DOUBLE / at_risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS survival FROM s) WHERE events > 0""",
}
ORACLES["mann_whitney_p"] = f"SELECT round({NORMAL_P}, 4) AS p FROM ({ORACLES['mann_whitney']})"
