"""Queries of features, effects, roles and models, with the same in SQL where it can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import per_column
from tessera.jobs.profiles import union
from tessera.jobs.relations import LINES, f_p_sql, lifetimes, lines, t_p_sql
from tessera.operators import causal as c
from tessera.operators import features as f
from tessera.operators import models as m
from tessera.operators import profile as p
from tessera.operators import roles as ro
from tessera.operators.survival import cox
from tessera.sources import table

def treated() -> Column:
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


def post() -> Column:
    return F.col("o_orderdate") >= F.lit("1998-04-01").cast("timestamp_ntz")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customers; treatment: an urgent priority; score: a made-up propensity from the account."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    score = 0.1 + 0.8 * F.pmod(F.col("o_orderkey") * 37, F.lit(1000)) / 1000
    return o.withColumns({"treated": treated().cast("int"), "score": score, "nation": F.col("c_nationkey").cast("double")})


ORDERS = "(SELECT *, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS treated, 0.1::DOUBLE + 0.8::DOUBLE * ((o_orderkey * 37) % 1000) / 1000 AS score, c_nationkey::DOUBLE AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"

#: The four nearest controls of each treated order, by all pairs.
FOUR = f"""SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY d, control_score, control_key) AS INTEGER) AS rank FROM (
 SELECT a.o_orderkey AS key, a.o_totalprice AS y, b.o_orderkey AS control_key, b.o_totalprice AS cy, b.score AS control_score, abs(a.score - b.score) AS d FROM {ORDERS} a JOIN {ORDERS} b ON a.treated = 1 AND b.treated = 0 AND a.o_custkey % 4 = 0 AND b.o_custkey % 4 = 0)
 QUALIFY rank <= 4 AND d <= 0.001"""


def sums(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Count, mean and deviation of columns: a digest of derived columns."""
    return p.rounded(per_column(df, columns, n=lambda x: F.count(x), mean=lambda x: F.avg(x), sd=lambda x: F.stddev_samp(x)), digits)


def sums_sql(source: str, columns: dict[str, str], digits: int = 4) -> str:
    return union(f"SELECT '{k}' AS \"column\", count({x}) AS n, round(avg({x}), {digits}) AS mean, round(stddev_samp({x}), {digits}) AS sd FROM {source}" for k, x in columns.items())


def gaps(spark, sf):
    return orders(spark, sf).withColumns({"part": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")), "kind": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))})


GAPS = f"(SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS part, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS kind FROM {ORDERS})"


def imputed_numbers(spark, sf):
    return sums(f.impute_numbers(gaps(spark, sf), ["part"]), ["part"])


def imputed_categories(spark, sf):
    return f.impute_categories(gaps(spark, sf), ["kind"]).groupBy("kind").agg(F.count("*").alias("n"))


def scaled_standard(spark, sf):
    return sums(f.scale(orders(spark, sf), ["o_totalprice", "c_acctbal"]).withColumns({"o_totalprice": F.abs("o_totalprice"), "c_acctbal": F.abs("c_acctbal")}), ["o_totalprice", "c_acctbal"])


def scaled_robust(spark, sf):
    return sums(f.scale(orders(spark, sf), ["o_totalprice", "c_acctbal"], "robust"), ["o_totalprice", "c_acctbal"])


def scaled_quantile(spark, sf):
    return sums(f.scale(orders(spark, sf), ["o_totalprice"], "quantile"), ["o_totalprice"], 2)


def one_hot(spark, sf):
    x = f.one_hot(table(spark, sf, "orders").select("o_orderpriority"), "o_orderpriority")
    flags = [n for n in x.columns if "__" in n]
    return x.agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in flags]).unpivot([], [F.col(f"`{n}`") for n in flags], "flag", "n")


def feature_products(spark, sf):
    x = f.polynomials(f.interactions(orders(spark, sf).select((F.col("o_totalprice") / 1e5).alias("a"), (F.col("c_acctbal") / 1e3).alias("b")), ["a", "b"]), ["a", "b"])
    return sums(x, [n for n in x.columns if "_" in n])


def feature_crosses(spark, sf):
    return f.crosses(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"]).groupBy("o_orderstatus_x_o_orderpriority").agg(F.count("*").alias("n"))


def without_constants(spark, sf):
    x = f.drop_constant(orders(spark, sf).select("o_totalprice", "c_acctbal", F.lit(1).alias("one")))
    return sums(x, x.columns)


def lower_texts(spark, sf):
    return f.lower_text(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority")), ["priority"]).groupBy("priority").agg(F.count("*").alias("n"))


def components(spark, sf):
    return p.rounded(f.principal_components(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"], 3).select("component", "explained").distinct(), 4)


def lasso(spark, sf):
    return p.rounded(f.lasso_path(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "net", "l_orderkey"), 4)


def target_candidates(spark, sf):
    return f.target_candidates(table(spark, sf, "orders")).select("column", "n_unique", "rank")


def model_shortlist(spark, sf):
    return p.rounded(f.model_shortlist(table(spark, sf, "orders"), "o_orderpriority").unionByName(f.model_shortlist(table(spark, sf, "orders"), "o_totalprice")))


def weighted_effect(spark, sf):
    return p.rounded(c.weighted_effect(orders(spark, sf), "treated", "o_totalprice", "score"), 2)


def matched_pairs(spark, sf):
    x = c.match_nearest(orders(spark, sf).withColumn("score", F.col("score") + F.col("o_orderkey") / 1e9), "o_orderkey", "treated", "o_totalprice", "score")
    return p.rounded(x.select("key", "control_key", "control_score"), 9)


def many_controls(spark, sf):
    """The four controls nearest to each treated order, over scores that tie, within a caliper."""
    x = c.match_controls(orders(spark, sf).where("o_custkey % 4 = 0"), "o_orderkey", "treated", "o_totalprice", "score", k=4, caliper=0.001)
    return p.rounded(x.select("key", "rank", "control_key", "control_score"), 9)


def many_controls_effect(spark, sf):
    return p.rounded(c.controls_effect(c.match_controls(orders(spark, sf).where("o_custkey % 4 = 0"), "o_orderkey", "treated", "o_totalprice", "score", k=4, caliper=0.001)), 3)


def matched_effect(spark, sf):
    o = c.propensity(orders(spark, sf), "treated", ["c_acctbal", "nation"], "p")
    return p.rounded(c.matched_effect(c.match_nearest(o, "o_orderkey", "treated", "o_totalprice", "p", caliper=0.05)), 2)


def instrument(spark, sf):
    return p.rounded(c.instrument_effect(lines(spark, sf).withColumn("paid", F.col("net") * (1 + F.col("l_tax"))), "paid", "net", "l_extendedprice"), 4)


def difference_in_differences(spark, sf):
    return p.rounded(c.did(orders(spark, sf), post(), treated(), "o_totalprice"), 4)


def did_regression(spark, sf):
    return p.rounded(c.did_regression(orders(spark, sf), post(), treated(), "o_totalprice").where("term = 'post_x_treated'").select("term", "coefficient"), 3)


def pre_trend(spark, sf):
    return p.rounded(c.pre_trend(orders(spark, sf), F.date_trunc("month", "o_orderdate").cast("date"), post(), treated(), "o_totalprice"), 4)


def _difference(rows: DataFrame, by: list[Column], weight: Column | None) -> DataFrame:
    return c.mean_difference(rows, F.col("treated") == 1, "o_totalprice", by, weight)


def robustness(spark, sf):
    return p.rounded(c.robustness(orders(spark, sf), "o_orderkey", _difference, ["c_mktsegment", "o_orderstatus"], "o_orderdate", {"o_totalprice": [0.01, 0.05]}, replicates=0), 3)


def robustness_bootstrap(spark, sf):
    return p.rounded(c.robustness(orders(spark, sf), "o_orderkey", _difference), 3)


def upgraded_difference(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate", "treated", "o_totalprice", "c_acctbal", "nation")
    return p.rounded(c.upgraded_did(o, "o_orderdate", "treated", "o_totalprice", ["c_acctbal", "nation"], "o_orderkey", user="o_custkey", weighted=True), 3)


def clustered_regression(spark, sf):
    return p.rounded(c.ols(orders(spark, sf).select("o_totalprice", "c_acctbal", "o_custkey"), "o_totalprice", ["c_acctbal"], cluster="o_custkey").select("term", "coefficient", "se", "n"), 4)


def model_effects(spark, sf):
    return p.rounded(c.model_effects(lines(spark, sf), ["l_quantity", "l_extendedprice"], "net").select("column", "pct", "change", "coefficient", "linear_effect"), 2)


def forest_effects(spark, sf):
    return p.rounded(c.model_effects(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], "net").select("column", "pct", "importance", "forest_effect"), 3)


def auto_config(spark, sf):
    return ro.auto_config(orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_acctbal", "c_mktsegment", F.when(F.col("treated") == 1, "yes").otherwise("no").alias("urgent")))


def business_effect(spark, sf):
    return p.rounded(c.business_effect(lines(spark, sf), "l_discount", "l_extendedprice").drop("p"), 3)


def business_effect_p(spark, sf):
    """The p of the correlation of an effect with its base."""
    return p.rounded(c.business_effect(table(spark, sf, "customer"), "c_nationkey", "c_acctbal").select("r", "p"), 4)


def effect_candidates(spark, sf):
    return p.rounded(c.effect_candidates(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "net"]))


def category_candidates(spark, sf):
    return p.rounded(c.effect_candidates(lines(spark, sf), ["l_extendedprice", "net"], ["l_returnflag", "l_linestatus"], least=0.0))


def scenarios(spark, sf):
    return p.rounded(c.scenarios(lines(spark, sf), ["l_quantity", "l_extendedprice", "net"]), 3)


def sign_stability(spark, sf):
    return p.rounded(c.sign_stability(lines(spark, sf).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k", ["l_extendedprice", "net", "l_quantity"], replicates=200))


def coefficient_stability(spark, sf):
    return p.rounded(c.coefficient_stability(lines(spark, sf), "l_orderkey", ["l_extendedprice", "l_discount"], "net"), 3)


def driver(spark, sf):
    return p.rounded(c.pick_driver(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], "net"))


def profit_proxies(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return p.rounded(c.profit_proxies(x, F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), F.col("l_returnflag") == "R", "l_extendedprice"))


def key_results(spark, sf):
    l = lines(spark, sf)
    means = per_column(l, ["l_extendedprice", "l_discount"], mean=lambda x: F.avg(x))
    return p.rounded(c.key_results(c.coefficient_stability(l, "l_orderkey", ["l_extendedprice", "l_discount"], "net"), means), 3)


def outcome_ranking(spark, sf):
    return p.rounded(ro.outcome_ranking(lines(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 4)


def outcome_scores(spark, sf):
    return p.rounded(ro.outcome_scores(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


def treatment_scores(spark, sf):
    return p.rounded(ro.treatment_scores(orders(spark, sf), ["treated", "o_orderstatus", "o_orderpriority", "o_custkey"], "o_totalprice"))


def time_scores(spark, sf):
    return ro.time_scores(table(spark, sf, "orders").withColumn("stamp", F.date_format("o_orderdate", "dd/MM/yyyy")))


def instrument_scores(spark, sf):
    return p.rounded(ro.instrument_scores(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"], "net", "l_discount"))


GROUPED = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "o_custkey"]


def group_scores(spark, sf):
    return p.rounded(ro.group_scores(orders(spark, sf), GROUPED, "o_totalprice"), 4)


def group_parts(spark, sf):
    o = orders(spark, sf)
    f_ = ro.level_moments(o, GROUPED[:3], "o_totalprice").select("column", "f", "r")
    return p.rounded(ro.group_scores(o, GROUPED, "o_totalprice").select("column", "levels", "entropy").join(f_, "column"))


def id_scores(spark, sf):
    return p.rounded(ro.id_scores(orders(spark, sf), ["o_orderkey", "o_custkey", "o_orderstatus"]))


def role_decisions(spark, sf):
    o = orders(spark, sf)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "treated"]
    scored = [(ro.id_scores(o, cols), "id"), (ro.treatment_scores(o, cols, "o_totalprice"), "treatment"), (ro.outcome_scores(o, ["o_totalprice", "c_acctbal"]), "outcome"), (ro.time_scores(o.select("o_orderdate", "o_orderkey")), "time")]
    return p.rounded(ro.decide(reduce(DataFrame.unionByName, [s.select("column", F.lit(r).alias("role"), "score") for s, r in scored])))


def category_codes(spark, sf):
    return ro.encode(table(spark, sf, "orders"), "o_orderpriority").groupBy("o_orderpriority", "o_orderpriority_code").agg(F.count("*").alias("n"))


def clusters(spark, sf):
    return p.rounded(m.cluster(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"])[1], 3)


def anomalies(spark, sf):
    l = lines(spark, sf).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return m.anomalies(l, "k", ["l_quantity", "l_extendedprice", "l_discount"]).groupBy("is_anomaly").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score"))


def importances(spark, sf):
    return p.rounded(m.importances(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], "net"), 3)


def model_comparison(spark, sf):
    return p.rounded(m.compare_models(lines(spark, sf).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k", ["l_quantity", "l_extendedprice", "l_discount"], "net"), 2)


def class_split(spark, sf):
    """Held-out rows of each class: exactly a fifth, rounded."""
    rows = m.split(table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k", 0.2, "l_returnflag")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_validation").alias("held_out"))


def classifiers(spark, sf):
    """Candidates for a target of five classes."""
    x = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    return p.rounded(m.compare_models(x, "c_custkey", ["c_acctbal", "nation"], "c_mktsegment"), 3)


def tuned_tree(spark, sf):
    x = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    return p.rounded(m.tuned(x, "c_custkey", ["nation"], "c_acctbal", "tree", {"maxDepth": [2, 4], "maxBins": [16, 32]}), 2)


def cluster_sizes(spark, sf):
    return p.rounded(m.cluster_candidates(table(spark, sf, "part"), ["p_size", "p_retailprice"], (2, 3, 4)), 3)


def fallback_candidates(spark, sf):
    """Columns that nothing goes with: all others are candidates."""
    x = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return c.effect_candidates(x, x.columns, least=0.9).select("effect", "base", "confidence")


def nearest_rows(spark, sf):
    cust = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    return p.rounded(m.nearest_rows(cust, "c_custkey", ["c_acctbal", "nation"], "c_acctbal", 0.1, cust.orderBy("c_custkey").limit(5)), 5)


def nearest_of_each(spark, sf):
    """The customer nearest to each customer with a tenth more on the account, by a tree of cells."""
    cust = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    return p.rounded(m.nearest_rows(cust, "c_custkey", ["c_acctbal", "nation"], "c_acctbal", 0.1, cust), 5)


def cox_hazards(spark, sf):
    x = lifetimes(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("balance", F.col("c_acctbal") / 1000)
    return p.rounded(cox(x, "duration", "event", ["balance"]), 3)


QUERIES = {x.__name__: x for x in (upgraded_difference, clustered_regression, model_effects, forest_effects, auto_config, category_candidates, group_parts, imputed_numbers, imputed_categories, scaled_standard, scaled_robust, scaled_quantile, one_hot, feature_products, feature_crosses, without_constants, lower_texts, components, lasso, target_candidates, model_shortlist, weighted_effect, matched_pairs, many_controls, many_controls_effect, matched_effect, instrument, difference_in_differences, did_regression, pre_trend, robustness, robustness_bootstrap, business_effect, business_effect_p, effect_candidates, scenarios, sign_stability, coefficient_stability, driver, profit_proxies, key_results, outcome_ranking, outcome_scores, treatment_scores, time_scores, instrument_scores, group_scores, id_scores, category_codes, role_decisions, clusters, anomalies, importances, model_comparison, class_split, classifiers, tuned_tree, cluster_sizes, fallback_candidates, nearest_rows, nearest_of_each, cox_hazards)}

DID = "avg(o_totalprice) FILTER (WHERE {} (o_orderdate >= '1998-04-01') AND treated = {})"
EFFECT = "avg(o_totalprice) FILTER (WHERE treated = 1) - avg(o_totalprice) FILTER (WHERE treated = 0)"
ENTROPY = """(WITH v AS ({counts}), s AS (SELECT *, sum(n) OVER (PARTITION BY "column")::DOUBLE AS t, count(*) OVER (PARTITION BY "column") AS k FROM v) SELECT "column", any_value(k) AS k, any_value(t) AS t, min(n) AS lo, max(n) AS hi, -sum(n / t * log2(n / t)) AS e FROM s GROUP BY 1)"""


def entropy_sql(source: str, columns: list[str]) -> str:
    return ENTROPY.format(counts=union(f"SELECT '{x}' AS \"column\", {x}::VARCHAR AS value, count(*) AS n FROM {source} GROUP BY ALL" for x in columns))


ID = "greatest(0, least(1, 0.7 * least(k / t, 1) + 0.3 * coalesce(least(e / nullif(log2(k), 0), 1), 0)))"
LEVELS = {"treated": "treated", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "c_mktsegment": "c_mktsegment"}


def codes_sql(x: str) -> str:
    """r of the codes of a category with the price, and its one-way F."""
    return f"""SELECT '{x}' AS "column", any_value(rr) AS r, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM (SELECT {x} AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM {ORDERS} GROUP BY 1),
 (SELECT avg(o_totalprice) AS gm, corr(code, o_totalprice) AS rr FROM (SELECT dense_rank() OVER (ORDER BY {x}) AS code, o_totalprice FROM {ORDERS}))"""


BALANCE = "1 - abs(hi / t - 0.5) / 0.5"
TREATED = f"""(SELECT e."column", k, round({BALANCE}, 6)::DOUBLE AS balance, round(abs(r), 6) AS relation, greatest(0, least(1, 0.6 * ({BALANCE}) + 0.4 * abs(r))) AS score FROM {entropy_sql(ORDERS, ['treated', 'o_orderstatus', 'o_orderpriority'])} e JOIN ({union(codes_sql(x) for x in ('treated', 'o_orderstatus', 'o_orderpriority'))}) r USING ("column") WHERE k BETWEEN 2 AND 5)"""


def outcome_sql(columns: dict[str, str], source: str) -> str:
    """Outcome scores; columns: each with the SQL of its mean |r| with the others."""
    each = union(
        f"""SELECT '{x}' AS "column", least(var_samp({x}) / (any_value(hi - lo) + 1e-9), 1) AS spread, least(abs(skewness({x})) / 3, 1) AS skew, count(DISTINCT {x})::DOUBLE / count({x}) AS d, {r} AS r,
 (SELECT -sum(p * log2(p)) / log2(10) FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM (SELECT least(floor(({x} - lo) / ((hi - lo) / 10::DOUBLE)), 9) AS b FROM {source}, (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source})) GROUP BY b)) AS h FROM {source}, (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source})"""
        for x, r in columns.items()
    )
    return f"""SELECT "column", greatest(0, least(1, 0.5 * spread + 0.3 * skew + 0.2 * d + 0.1 * h - 0.1 * r - 0.1 * (0.5 * (1 - h) + 0.5 * (1 - d)))) AS score FROM ({each})"""


def mean_r(x: str, others: list[str]) -> str:
    return "(" + " + ".join(f"abs(corr({x}, {o}))" for o in others) + f") / {len(others)}"


SCORED_LINES = ["l_quantity", "l_extendedprice", "l_discount"]
SHORT = ("XGBRegressor LGBMRegressor CatBoostRegressor MLPRegressor", "RandomForestRegressor XGBRegressor LGBMRegressor", "LinearRegression Ridge Lasso ElasticNet SVR")
ORACLES = {
    "imputed_numbers": sums_sql(f"(SELECT coalesce(part, (SELECT quantile_cont(part, 0.5) FROM {GAPS} AS a)) AS part FROM {GAPS} AS b)", {"part": "part"}),
    "imputed_categories": f"WITH g AS {GAPS}, b AS (SELECT kind FROM g WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1) SELECT coalesce(g.kind, b.kind) AS kind, count(*) AS n FROM g, b GROUP BY 1",
    "scaled_standard": sums_sql(f"(SELECT abs(o_totalprice - a) / b AS x, abs(c_acctbal - d) / e AS y FROM {ORDERS}, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS b, avg(c_acctbal) AS d, stddev_pop(c_acctbal) AS e FROM {ORDERS}))", {"o_totalprice": "x", "c_acctbal": "y"}),
    "scaled_robust": sums_sql(f"(SELECT (o_totalprice - a[2]) / (a[3] - a[1]) AS x, (c_acctbal - b[2]) / (b[3] - b[1]) AS y FROM {ORDERS}, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS a, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS b FROM {ORDERS}))", {"o_totalprice": "x", "c_acctbal": "y"}),
    "one_hot": "SELECT 'o_orderpriority__' || o_orderpriority AS flag, count(*) AS n FROM orders GROUP BY 1",
    "feature_products": sums_sql(f"(SELECT o_totalprice / 1e5::DOUBLE AS a, c_acctbal / 1e3::DOUBLE AS b FROM {ORDERS})", {"a_x_b": "a * b", "a__a": "a * a", "a__b": "a * b", "b__b": "b * b", "a__a__a": "a * a * a", "a__a__b": "a * a * b", "a__b__b": "a * b * b", "b__b__b": "b * b * b"}),
    "feature_crosses": "SELECT o_orderstatus || '_' || o_orderpriority AS o_orderstatus_x_o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "without_constants": sums_sql(ORDERS, {"o_totalprice": "o_totalprice", "c_acctbal": "c_acctbal"}),
    "lower_texts": "SELECT lower(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY 1",
    "target_candidates": """SELECT * FROM (SELECT "column", n_unique, CASE WHEN num AND n_unique > 20 AND n_unique < 0.95 * n THEN 1 WHEN n_unique BETWEEN 2 AND 10 THEN 2 END::INT AS rank FROM ("""
    + union(f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS n_unique, count({x}) AS n, {k} AS num FROM orders" for x, k in (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)))
    + ")) WHERE rank IS NOT NULL",
    "model_shortlist": f"""WITH s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n_rows, min(n) AS lo, false AS num FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) UNION ALL SELECT count(*), sum(n)::BIGINT, min(n), true FROM (SELECT count(*) AS n FROM orders GROUP BY o_totalprice)),
x AS (SELECT CASE WHEN num AND k > 20 THEN 'regression' ELSE 'classification' END AS problem, n_rows, 5 AS features, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS a, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS b, lo / n_rows::DOUBLE AS raw FROM s)
SELECT problem, n_rows, features, CASE WHEN problem = 'regression' THEN greatest(a, b) ELSE a END AS max_categories, round(raw, 6) AS least_share, problem = 'classification' AND raw < 0.2 AS imbalanced,
 CASE WHEN problem = 'classification' THEN CASE WHEN n_rows < 1000 THEN 1 WHEN raw < 0.2 THEN 4 WHEN n_rows >= 5000 THEN 5 ELSE 17 END WHEN n_rows < 2000 THEN 7 WHEN n_rows < 10000 THEN 9 ELSE 10 END::INT AS rule,
 CASE WHEN problem = 'classification' THEN CASE WHEN n_rows < 1000 THEN 'LogisticRegression SVC KNeighborsClassifier DecisionTreeClassifier' WHEN raw < 0.2 THEN 'XGBClassifier LGBMClassifier CatBoostClassifier' WHEN n_rows >= 5000 THEN 'RandomForestClassifier XGBClassifier LGBMClassifier CatBoostClassifier' ELSE 'RandomForest' END
 WHEN n_rows < 2000 THEN '{SHORT[2]}' WHEN n_rows < 10000 THEN '{SHORT[1]}' ELSE '{SHORT[0]}' END AS models FROM x""",
    "weighted_effect": f"WITH w AS (SELECT treated AS t, o_totalprice AS y, CASE WHEN treated = 1 THEN 1 / score ELSE 1 / (1 - score) END AS w FROM {ORDERS}) SELECT round(sum(w * (2 * t - 1) * y) / sum(w), 2) AS ate_signed, round(sum(w * y * t) / sum(w * t) - sum(w * y * (1 - t)) / sum(w * (1 - t)), 2) AS ate_hajek, count(*) AS n FROM w",
    "matched_pairs": f"""WITH s AS (SELECT o_orderkey AS key, treated AS t, score + o_orderkey / 1e9::DOUBLE AS p FROM {ORDERS}), a AS (SELECT * FROM s WHERE t = 1), b AS (SELECT p, min(key) AS key FROM s WHERE t = 0 GROUP BY 1),
l AS (SELECT a.key, a.p, b.p AS l FROM a ASOF LEFT JOIN b ON a.p >= b.p), r AS (SELECT a.key, b.p AS r FROM a ASOF LEFT JOIN b ON a.p <= b.p), c AS (SELECT l.key, CASE WHEN l IS NOT NULL AND (r IS NULL OR l.p - l <= r - l.p) THEN l ELSE r END AS cp FROM l JOIN r ON l.key = r.key)
SELECT c.key, b.key AS control_key, round(c.cp, 9) AS control_score FROM c JOIN b ON b.p = c.cp""",
    "class_split": "SELECT l_returnflag, count(*) AS n, CAST(floor(count(*) * 0.2::DOUBLE + 0.5) AS BIGINT) AS held_out FROM lineitem GROUP BY 1",
    "fallback_candidates": "SELECT a AS effect, b AS base, 0.2::DOUBLE AS confidence FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) x(a), (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) y(b) WHERE a <> b",
    "business_effect_p": f"SELECT round(r, 4) AS r, round({t_p_sql('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 4) AS p FROM (SELECT corr(c_nationkey, c_acctbal) AS r, count(*)::DOUBLE AS n FROM customer)",
    "many_controls": f"SELECT key, rank, control_key, round(control_score, 9) AS control_score FROM ({FOUR})",
    "many_controls_effect": f"""WITH m AS ({FOUR})
SELECT (SELECT count(DISTINCT key) FROM m) AS treated, (SELECT count(DISTINCT control_key) FROM m) AS controls, round((SELECT avg(y) FROM (SELECT DISTINCT key, y FROM m)) - (SELECT avg(cy) FROM (SELECT DISTINCT control_key, cy FROM m)), 3) AS att, round((SELECT avg(gap) FROM (SELECT any_value(y) - avg(cy) AS gap FROM m GROUP BY key)), 3) AS att_own""",
    "nearest_of_each": """WITH s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer), z AS (SELECT c_custkey AS k, (c_acctbal - ma) / sa AS a, (c_acctbal * 1.1::DOUBLE - ma) / sa AS c, (c_nationkey - mn) / sn AS n FROM customer, s)
SELECT asked_key, arg_min(k, (d, k)) AS nearest_key, round(min(d), 5) AS distance FROM (SELECT x.k AS asked_key, y.k, sqrt(pow(x.c - y.a, 2) + pow(x.n - y.n, 2)) AS d FROM z x JOIN z y ON x.k <> y.k) GROUP BY 1""",
    "instrument": f"""WITH s AS (SELECT l_extendedprice AS z, net AS t, net * (1 + l_tax) AS y FROM {LINES}), m AS (SELECT count(*) AS n, covar_samp(z, y) / covar_samp(z, t) AS b, corr(z, t) AS r, avg(y) AS my, avg(t) AS mt, avg(z) AS mz FROM s)
SELECT round(any_value(b), 4) AS coefficient, round(any_value(r * r / (1 - r * r) * (n - 2)), 4) AS first_stage_f, round(sqrt(sum(pow((z - mz) * ((y - my) - b * (t - mt)), 2)) * any_value(n / (n - 2)::DOUBLE)) / abs(sum((z - mz) * (t - mt))), 4) AS se_hc1, count(*) AS n FROM s, m""",
    "difference_in_differences": f"""WITH c AS (SELECT {DID.format("", 1)} AS a, {DID.format("NOT", 1)} AS b, {DID.format("", 0)} AS c, {DID.format("NOT", 0)} AS d FROM {ORDERS})
SELECT round(a, 4) AS treated_post, round(b, 4) AS treated_pre, round(c, 4) AS control_post, round(d, 4) AS control_pre, round(a - b - c + d, 4) AS did FROM c""",
    "did_regression": f"SELECT 'post_x_treated' AS term, round({DID.format('', 1)} - {DID.format('NOT', 1)} - {DID.format('', 0)} + {DID.format('NOT', 0)}, 3) AS coefficient FROM {ORDERS}",
    "pre_trend": f"""WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, treated, avg(o_totalprice) AS m FROM {ORDERS} WHERE o_orderdate < '1998-04-01' GROUP BY 1, 2), x AS (SELECT treated, regr_slope(m, (p - DATE '1970-01-01')::DOUBLE) AS b FROM s GROUP BY 1),
y AS (SELECT max(b) FILTER (WHERE treated = 1) AS a, max(b) FILTER (WHERE treated = 0) AS b FROM x) SELECT round(a, 4) AS treated_slope, round(b, 4) AS control_slope, abs(a - b) > 0.1 * (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) AS warn FROM y""",
    "robustness": f"""WITH o AS {ORDERS}, cut AS (SELECT quantile_cont(o_totalprice, [0.99, 0.95]) AS q FROM o)
SELECT 'baseline' AS "check", 'all' AS name, count(*) AS n, round({EFFECT}, 3) AS effect FROM o UNION ALL SELECT 'drop_top', '0.01', count(*), round({EFFECT}, 3) FROM o, cut WHERE o_totalprice <= q[1] UNION ALL SELECT 'drop_top', '0.05', count(*), round({EFFECT}, 3) FROM o, cut WHERE o_totalprice <= q[2]
UNION ALL SELECT 'by_c_mktsegment', c_mktsegment, count(*), round({EFFECT}, 3) FROM o GROUP BY 2 UNION ALL SELECT 'by_o_orderstatus', o_orderstatus, count(*), round({EFFECT}, 3) FROM o GROUP BY 2 UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*), round({EFFECT}, 3) FROM o GROUP BY 2 HAVING count(*) > 30""",
    "model_effects": f"""WITH l AS {LINES}, m AS (SELECT regr_slope(net, l_quantity) AS x, var_samp(l_quantity) AS vq, var_samp(l_extendedprice) AS ve, covar_samp(l_quantity, l_extendedprice) AS c, covar_samp(l_quantity, net) AS qn, covar_samp(l_extendedprice, net) AS en, avg(l_quantity) AS mq, avg(l_extendedprice) AS me FROM l),
b AS (SELECT 'l_quantity' AS "column", mq AS mean, (qn * ve - en * c) / (vq * ve - c * c) AS coefficient FROM m UNION ALL SELECT 'l_extendedprice', me, (en * vq - qn * c) / (vq * ve - c * c) FROM m), g AS (SELECT -0.2 + 0.4 * i / 9::DOUBLE AS pct FROM range(10) t(i))
SELECT "column", round(pct, 2) AS pct, round(mean * pct, 2) AS change, round(coefficient, 2) AS coefficient, round(coefficient * mean * pct, 2) AS linear_effect FROM b, g""",
    "clustered_regression": f"""WITH s AS (SELECT o_totalprice AS y, c_acctbal AS x, o_custkey AS g FROM {ORDERS}), b AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, count(*) AS n, count(DISTINCT g) AS k, sum(x * x) AS xx, sum(x) AS sx FROM s),
u AS (SELECT g, sum(y - a - b * x) AS u0, sum(x * (y - a - b * x)) AS u1 FROM s, b GROUP BY 1), m AS (SELECT sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u),
i AS (SELECT *, n * xx - sx * sx AS det, (k / (k - 1.0::DOUBLE)) * ((n - 1) / (n - 2.0::DOUBLE)) AS f FROM b, m)
SELECT 'const' AS term, round(a, 4) AS coefficient, round(sqrt(f * (xx * xx * m00 - 2 * xx * sx * m01 + sx * sx * m11)) / det, 4) AS se, n FROM i UNION ALL SELECT 'c_acctbal', round(b, 4), round(sqrt(f * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11)) / det, 4), n FROM i""",
    "business_effect": "SELECT round(sum(l_discount * l_extendedprice), 3) AS total_impact, round(sum(l_extendedprice + l_discount * l_extendedprice), 3) AS new_total, round(avg(CASE WHEN l_extendedprice <> 0 THEN l_discount * l_extendedprice / l_extendedprice END), 3) AS mean_roi, round(corr(l_discount, l_extendedprice), 3) AS r FROM lineitem",
    "scenarios": "WITH l AS " + LINES + "\n" + union(
        f"SELECT '{a}' AS changed, '{b}' AS other, pct, round(ma * pct, 3) AS change, round(r * ma * pct * sb / sa, 3) AS impact FROM (SELECT avg({a}) AS ma, stddev_samp({a}) AS sa, stddev_samp({b}) AS sb, corr({a}, {b}) AS r FROM l), (SELECT round(-0.2 + 0.4 * i / 9::DOUBLE, 3) AS pct FROM range(10) t(i))"
        for a in ("l_quantity", "l_extendedprice", "net") for b in ("l_quantity", "l_extendedprice", "net") if a != b
    ).replace("ma * pct", "ma * (-0.2 + 0.4 * i / 9::DOUBLE)").replace("AS pct FROM range", "AS pct, i FROM range"),
    "driver": f"SELECT 'l_extendedprice' AS \"column\", round(corr(l_extendedprice, net), 6) AS r FROM {LINES}",
    "profit_proxies": """SELECT round(avg((l_extendedprice - l_quantity * p_retailprice) / nullif(l_extendedprice, 0)), 6) AS roi, round((avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') - avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R')) / avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R'), 6) AS att_relative
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "outcome_ranking": union(f"SELECT '{x}' AS \"column\", round(var_samp({x}) + 0.1 * abs(skewness({x})), 4) AS score FROM lineitem" for x in ("l_quantity", "l_discount", "l_tax", "l_linenumber")),
    "outcome_scores": f"""SELECT "column", round(score, 4)::DOUBLE AS score FROM ({outcome_sql({x: mean_r(x, [o for o in SCORED_LINES if o != x]) for x in SCORED_LINES}, LINES)})""",
    "treatment_scores": f"SELECT \"column\", k AS levels, balance, relation, round(score, 6)::DOUBLE AS score FROM {TREATED}",
    "time_scores": "SELECT unnest(['o_orderdate', 'stamp']) AS \"column\", 1.0::DOUBLE AS score UNION ALL SELECT unnest(['o_orderstatus', 'o_orderpriority']), 0.0::DOUBLE UNION ALL SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']), 0.8::DOUBLE",
    "group_parts": f"""SELECT e."column", k AS levels, round(e / log2(k), 6) AS entropy, round(f, 6) AS f, round(r, 6) AS r FROM {entropy_sql(ORDERS, ['o_orderstatus', 'o_orderpriority', 'c_mktsegment'])} e JOIN ({union(codes_sql(x) for x in ('o_orderstatus', 'o_orderpriority', 'c_mktsegment'))}) USING ("column")""",
    "instrument_scores": union(f"SELECT '{x}' AS \"column\", round(abs(corr({x}, net)) * (1 - abs(corr({x}, l_discount))), 6) AS score FROM {LINES}" for x in ("l_quantity", "l_extendedprice", "l_tax")),
    "id_scores": f"SELECT \"column\", round({ID}, 6) AS score FROM {entropy_sql(ORDERS, ['o_orderkey', 'o_custkey', 'o_orderstatus'])}",
    "category_codes": "WITH c AS (SELECT o_orderpriority AS v, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderpriority, code AS o_orderpriority_code, count(*) AS n FROM orders JOIN c ON v = o_orderpriority GROUP BY 1, 2",
    "role_decisions": f"""WITH e AS {entropy_sql(ORDERS, ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority', 'treated'])}, s AS (SELECT "column", 'id' AS role, {ID} AS score, 3 AS place FROM e UNION ALL SELECT "column", 'treatment', score, 2 FROM {TREATED}
UNION ALL SELECT "column", 'outcome', score, 1 FROM ({outcome_sql({'o_totalprice': mean_r('o_totalprice', ['c_acctbal']), 'c_acctbal': mean_r('o_totalprice', ['c_acctbal'])}, ORDERS)}) UNION ALL SELECT 'o_orderdate', 'time', 1.0, 4 UNION ALL SELECT 'o_orderkey', 'time', 0.8, 4),
b AS (SELECT "column", arg_max(role, (score, -place)) AS role, max(score) AS score FROM s GROUP BY 1) SELECT "column", role, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'low' ELSE 'very_low' END AS confidence FROM b""",
    "nearest_rows": """WITH s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer), z AS (SELECT c_custkey AS k, (c_acctbal - ma) / sa AS a, (c_acctbal * 1.1::DOUBLE - ma) / sa AS c, (c_nationkey - mn) / sn AS n FROM customer, s),
d AS (SELECT x.k AS asked_key, y.k AS nearest_key, sqrt(pow(x.c - y.a, 2) + pow(x.n - y.n, 2)) AS d FROM (SELECT * FROM z ORDER BY k LIMIT 5) x JOIN z y ON x.k <> y.k), r AS (SELECT *, row_number() OVER (PARTITION BY asked_key ORDER BY d, nearest_key) AS i FROM d)
SELECT asked_key, nearest_key, round(d, 5) AS distance FROM r WHERE i = 1""",
}
#: Group scores: half the entropy, half 1 - p of F with the level's degrees.
ORACLES["group_scores"] = f"""WITH n AS (SELECT count(*)::DOUBLE AS n FROM {ORDERS}), g AS (SELECT "column", levels, entropy, f FROM (SELECT e."column", k AS levels, least(e / log2(k), 1) AS entropy, f FROM {entropy_sql(ORDERS, ['o_orderstatus', 'o_orderpriority', 'c_mktsegment'])} e
 JOIN ({union(codes_sql(x) for x in ('o_orderstatus', 'o_orderpriority', 'c_mktsegment'))}) USING ("column"))), r AS (SELECT "column", levels, entropy, 1 - {f_p_sql('f', '(levels - 1)', '(n - levels)')} AS relation FROM g, n)
SELECT "column", levels, round(entropy, 4) AS entropy, round(relation, 4) AS relation, round(greatest(0, least(1, 0.5::DOUBLE * entropy + 0.5::DOUBLE * relation)), 4) AS score FROM r"""
_MADE = ("l_quantity", "l_extendedprice", "l_discount", "net")
ORACLES["effect_candidates"] = f"""WITH s AS (SELECT unnest([{', '.join(f"{{'c': '{x}', 'k': skewness({x})}}" for x in _MADE)}], recursive := true) FROM {LINES}), b AS (SELECT c, round(least(1, abs(k) / 5 + 0.5), 2)::DOUBLE AS base_confidence FROM s ORDER BY 2 DESC, 1 LIMIT 3),
r AS (SELECT unnest([{', '.join(f"{{'effect': '{x}', 'base': '{y}', 'r': corr({x}, {y})}}" for x in _MADE for y in _MADE if x != y)}], recursive := true) FROM {LINES})
SELECT effect, base, round(r, 4) AS r, round(abs(r), 2) AS confidence, base_confidence FROM r JOIN b ON base = c WHERE abs(r) >= 0.1"""
