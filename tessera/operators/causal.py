"""Effects: weighting, matching, instruments, differences, robustness, scenarios, business figures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grams
from tessera.functions.columns import corr, numeric_columns, per_column, q, value_counts
from tessera.functions.distributions import normal_ppf, on_rows, t_two_sided
from tessera.functions.ranks import ranged, running
from tessera.functions.tables import written
from tessera.operators.describe import bins_of
from tessera.operators.relate import correlations, fold_grams, gram, inverse


#: Levels of a covariate that become columns at most: a plan has one expression for each.
MAX_LEVELS = 50


def dummies(df: DataFrame, columns: list[str], max_levels: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """Rows with a 0/1 column for each level but the first (in order) of the columns that aren't numbers, and the names of all."""
    kept = numeric_columns(df)
    texts = [c for c in columns if c not in kept]
    levels: dict[str, list[str]] = {c: [] for c in texts}
    if texts:
        found = value_counts(df, texts).select("column", "value")
        over = found.groupBy("column").count().where(F.col("count") > max_levels).first()
        if over:
            raise ValueError(f"{over['column']} has {over['count']} levels, over {max_levels}")
        for r in found.collect():  # max_levels values a column
            levels[r["column"]].append(r["value"])
    flags = {f"{c}__{v}": (q(c).cast("string") == F.lit(v)).cast("double") for c in texts for v in sorted(levels[c])[1:]}
    return df.withColumns(flags) if flags else df, [*[c for c in columns if c in kept], *flags]


def propensity(df: DataFrame, treatment: str, covariates: list[str], name: str = "score", least_rows: int = 20) -> DataFrame:
    """Rows with the probability of treatment by logistic regression (L2, C = 1); covariates that aren't numbers as dummies.

    No rows where fewer than ``least_rows`` are complete, or all have the same treatment.
    """
    whole = df.dropna(subset=[treatment, *covariates]).withColumn("_label", q(treatment).cast("double"))
    whole, names = dummies(whole, covariates)
    n, kinds = whole.agg(F.count(F.lit(1)), F.countDistinct("_label")).first()
    if n < least_rows or kinds < 2 or not names:
        return df.withColumn(name, F.lit(None).cast("double")).where(F.lit(False))
    data = VectorAssembler(inputCols=names, outputCol="_features").transform(whole)
    model = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(data)
    out = model.transform(data).withColumn(name, vector_to_array("probability")[1])
    return out.select(*[q(c) for c in df.columns], name)


def weighted_effect(df: DataFrame, treatment: str, outcome: str, score: str, clip: float = 0.001) -> DataFrame:
    """Inverse-probability effects: sum(w (2t - 1) y) / sum(w), and the Hajek difference of weighted means."""
    p = F.least(F.greatest(q(score), F.lit(clip)), F.lit(1 - clip))
    t, y = q(treatment).cast("double"), q(outcome).cast("double")
    w = t / p + (1 - t) / (1 - p)
    mean = lambda x: F.try_divide(F.sum(w * y * x), F.sum(w * x))
    return df.agg(F.try_divide(F.sum(w * (2 * t - 1) * y), F.sum(w)).alias("ate_signed"), (mean(t) - mean(1 - t)).alias("ate_hajek"), F.count(F.lit(1)).alias("n"))


def match_nearest(df: DataFrame, key: str, treatment: str, outcome: str, score: str, caliper: float | None = None) -> DataFrame:
    """The control nearest by score for each treated row, with replacement; ties go to the smaller score, then key.

    Equal scores are one point.  Points are dealt by ranges of the score; within a range the last and next control are
    carried by running frames in both orders, across ranges from a row for each range: never all pairs.
    """
    rows = written(df.select(q(key).alias("key"), q(treatment).cast("int").alias("t"), q(outcome).cast("double").alias("y"), q(score).cast("double").alias("p")).where("p IS NOT NULL AND t IS NOT NULL"), "scores")
    points = rows.groupBy("p").agg(F.max(F.col("t") == 1).alias("asked"), F.min(F.when(F.col("t") == 0, F.struct("key", "y"))).alias("c"))
    points = written(points.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "points")
    own = F.when(F.col("c").isNotNull(), F.struct("p", "c"))
    ends = points.where("c IS NOT NULL").groupBy("part").agg(F.max_by("c", "p").alias("hc"), F.max("p").alias("hp"), F.min_by("c", "p").alias("lc"), F.min("p").alias("lp"))
    parts = points.select("part").distinct().join(F.broadcast(ends), "part", "left")  # a row for each range
    order = Window.orderBy("part")
    carried = parts.select("part", F.last(F.when(F.col("hp").isNotNull(), F.struct(F.col("hp").alias("p"), F.col("hc").alias("c"))), True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last(F.when(F.col("lp").isNotNull(), F.struct(F.col("lp").alias("p"), F.col("lc").alias("c"))), True).over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    upto = lambda *o: Window.partitionBy("part").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    near = points.select("part", "p", "asked", F.last(own, True).over(upto("p")).alias("l"), F.last(own, True).over(upto(F.desc("p"))).alias("r"))
    near = near.where("asked").join(F.broadcast(carried), "part").select("p", F.coalesce("l", "before").alias("l"), F.coalesce("r", "after").alias("r"))
    left = F.col("l").isNotNull() & (F.col("r").isNull() | (F.col("p") - F.col("l.p") <= F.col("r.p") - F.col("p")))
    picked = near.select("p", F.when(left, F.col("l")).otherwise(F.col("r")).alias("m")).where("m IS NOT NULL")
    if caliper is not None:
        picked = picked.where(F.abs(F.col("p") - F.col("m.p")) <= caliper)
    return rows.where("t = 1").join(picked, "p").select("key", "y", F.col("p").alias("score"), F.col("m.c.key").alias("control_key"), F.col("m.c.y").alias("control_y"), F.col("m.p").alias("control_score"))


#: Control points that are looked through together.
BLOCK = 64


def match_controls(df: DataFrame, key: str, treatment: str, outcome: str, score: str, k: int = 1, caliper: float | None = None) -> DataFrame:
    """The k controls nearest by score for each treated row, with replacement, nearest first; ties go to the smaller score, then key.

    (key, y, score, rank, control_key, control_y, control_score); all controls, if there are fewer than k.  Control scores are
    numbered in order across ranges.  A treated row needs the k points before and after its own place alone, so it is joined with
    one block of points, which holds k points of its neighbours on either side: linear in the rows, whatever k.
    """
    rows = written(df.select(q(key).alias("key"), q(treatment).cast("int").alias("t"), q(outcome).cast("double").alias("y"), q(score).cast("double").alias("p")).where("p IS NOT NULL AND t IS NOT NULL"), "scores")
    # Of many controls with one score, the k smallest keys can be chosen.
    order = F.row_number().over(Window.partitionBy("p").orderBy("key", "y"))
    few = rows.where("t = 0").withColumn("i", order).where(F.col("i") <= k).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("key", "y"))).alias("controls"))
    asked = rows.where("t = 1").select("p").distinct()
    points = asked.withColumn("asked", F.lit(True)).join(few, "p", "full").withColumn("one", F.col("controls").isNotNull().cast("long"))
    placed = written(running(ranged(points, "p"), "p", {"place": "one"}).select("p", "asked", "controls", "place"), "places")
    block = lambda place: F.floor(place / BLOCK)
    reached = F.explode(F.sequence(block(F.col("place") - k), block(F.col("place") + k))).alias("block")
    blocks = placed.where("controls IS NOT NULL").select("p", "controls", "place", reached).groupBy("block").agg(F.collect_list(F.struct("place", "p", "controls")).alias("points"))
    near = placed.where("asked").select(F.col("p").alias("at"), "place", block(F.col("place")).alias("block")).join(blocks, "block")
    within = F.filter("points", lambda x: (x["place"] > F.col("place") - k) & (x["place"] <= F.col("place") + k))
    each = F.flatten(F.transform(within, lambda x: F.transform(x["controls"], lambda c: F.struct(F.abs(F.col("at") - x["p"]).alias("d"), x["p"].alias("control_score"), c["key"].alias("control_key"), c["y"].alias("control_y")))))
    best = near.select("at", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("i", "m"))
    if caliper is not None:
        best = best.where(F.col("m.d") <= caliper)
    best = best.select(F.col("at").alias("p"), (F.col("i") + 1).alias("rank"), "m.control_key", "m.control_y", "m.control_score")
    return rows.where("t = 1").join(best, "p").select("key", "y", F.col("p").alias("score"), "rank", "control_key", "control_y", "control_score")


def controls_effect(matches: DataFrame) -> DataFrame:
    """Of ``match_controls``: mean outcome of the distinct treated less that of the distinct controls, and the mean gap of a treated row to its own controls."""
    own = matches.groupBy("key").agg(F.first("y").alias("y"), F.avg("control_y").alias("c")).agg(F.count("*").alias("treated"), F.avg("y").alias("treated_mean"), F.avg(F.col("y") - F.col("c")).alias("att_own"))
    controls = matches.groupBy("control_key").agg(F.first("control_y").alias("y")).agg(F.count("*").alias("controls"), F.avg("y").alias("control_mean"))
    return own.crossJoin(controls).select("treated", "controls", (F.col("treated_mean") - F.col("control_mean")).alias("att"), "att_own")  # single rows


def matched_effect(matches: DataFrame) -> DataFrame:
    """Mean outcome of the treated less that of the distinct matched controls, and of the pairs."""
    controls = matches.groupBy("control_key").agg(F.first("control_y").alias("y")).agg(F.avg("y").alias("control_mean"), F.count("*").alias("controls"))
    return matches.agg(F.avg("y").alias("treated_mean"), F.avg(F.col("y") - F.col("control_y")).alias("att_pairs"), F.count("*").alias("treated")).join(controls).select("treated", "controls", (F.col("treated_mean") - F.col("control_mean")).alias("att"), "att_pairs")


def instrument_effect(df: DataFrame, outcome: str, treatment: str, instrument: str, covariates: list[str] | None = None) -> DataFrame:
    """Two-stage least squares: coefficient, the first stage's overall F, and the HC1 error; covariates that aren't numbers as dummies.

    One centered Gram matrix of all columns gives both stages, a second pass the error.  No row where it isn't defined
    (constant instrument, or no more rows than columns).
    """
    whole, names = dummies(df.dropna(subset=[outcome, treatment, instrument, *(covariates or [])]), [instrument, *(covariates or [])])
    own = [c for c in names if c == instrument or c.startswith(f"{instrument}__")]
    others = [c for c in names if c not in own]
    n, means, m = gram(whole, [*own, *others, treatment, outcome])
    nothing = df.sparkSession.createDataFrame([], "coefficient double, first_stage_f double, se_hc1 double, n long")
    k, t, y = len(names), len(names), len(names) + 1
    if not n or n <= k + 1 or not own or m[t, t] <= 0:
        return nothing
    first = inverse(m[:k, :k]) @ m[:k, t]
    explained = float(first @ m[:k, t])
    rest = float(m[t, t]) - explained
    # The second stage's columns: the predicted treatment and the covariates.
    at = list(range(len(own), k))
    xx = np.zeros((1 + len(at), 1 + len(at)))
    xx[0, 0] = explained
    xx[0, 1:] = xx[1:, 0] = m[at, t]
    xx[1:, 1:] = m[np.ix_(at, at)]
    xy = np.array([first @ m[:k, y], *m[at, y]])
    if np.linalg.matrix_rank(xx) < len(xx) or explained <= 1e-12 * m[t, t]:
        return nothing
    inv = np.linalg.inv(xx)
    b = inv @ xy
    c = [q(x).cast("double") - F.lit(float(v)) for x, v in zip([*names, treatment, outcome], means, strict=True)]
    predicted = reduce(lambda a, x: a + x, [F.lit(float(v)) * x for v, x in zip(first, c[:k], strict=True)])
    e = c[y] - F.lit(float(b[0])) * c[t]
    for v, i in zip(b[1:], at, strict=True):
        e = e - F.lit(float(v)) * c[i]
    # The influence of a row on the coefficient: the first row of the inverse times its second-stage columns.
    d = F.lit(float(inv[0, 0])) * predicted
    for v, i in zip(inv[0, 1:], at, strict=True):
        d = d + F.lit(float(v)) * c[i]
    se = F.sqrt(F.sum(d * d * e * e) * F.lit(n / (n - len(xx) - 1)))
    f = (explained / k) / (rest / (n - k - 1)) if rest > 0 else None
    return whole.agg(F.lit(float(b[0])).alias("coefficient"), F.lit(f).cast("double").alias("first_stage_f"), se.alias("se_hc1"), F.count(F.lit(1)).alias("n"))


def ols(df: DataFrame, outcome: str, columns: list[str], weight: str | None = None, cluster: str | None = None) -> DataFrame:
    """Least squares with a constant: coefficients, errors, t and p, a 95 % interval and R squared (the same in every row).

    Errors are HC1, or clustered: the scores are summed by ``cluster`` before the meat, so a hot cluster is one partial
    sum a task.  Native passes: means, Gram matrix, meat.  Only k x k sums reach the driver.
    """
    one = df.dropna(subset=[outcome, *columns, *([cluster] if cluster else [])])
    w = q(weight).cast("double") if weight else F.lit(1.0)
    names = [*columns, outcome]
    v = [q(c).cast("double") for c in names]
    row = one.agg(F.count(F.lit(1)), F.sum(w), *[F.sum(w * x) for x in v]).first()
    n, total = row[0], row[1]
    schema = "term string, coefficient double, se double, t double, p double, low double, high double, r_squared double, n long"
    if not n or not total:
        return df.sparkSession.createDataFrame([], schema)
    means = [float(x) / float(total) for x in row[2:]]
    # Centered columns: the sums of products keep their digits. The constant is one more column.
    x = [F.lit(1.0), *[a - F.lit(b) for a, b in zip(v[:-1], means[:-1], strict=True)]]
    y = v[-1] - F.lit(means[-1])
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def square(values) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), value in zip(pairs, values, strict=True):
            m[i, j] = m[j, i] = value or 0.0
        return m

    row = one.agg(F.sum(w * y * y), *[F.sum(w * c * y) for c in x], *[F.sum(w * x[i] * x[j]) for i, j in pairs]).first()
    inv = inverse(square(row[1 + k :]))
    b = inv @ np.array([a or 0.0 for a in row[1 : 1 + k]])
    e = y - reduce(lambda a, c: a + c, [F.lit(float(a)) * c for a, c in zip(b, x, strict=True)])
    if cluster:
        sums = one.groupBy(q(cluster).alias("_g")).agg(F.sum(w * e * e).alias("_e"), *[F.sum(w * e * c).alias(f"_{i}") for i, c in enumerate(x)])
        row2 = sums.agg(F.sum("_e"), F.count("*"), *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in pairs]).first()
        g = row2[1]
        scale = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    else:
        row2 = one.agg(F.sum(w * e * e), F.count(F.lit(1)), *[F.sum(w * w * e * e * x[i] * x[j]) for i, j in pairs]).first()
        scale = n / max(n - k, 1)
    cov = inv @ square(row2[2:]) @ inv * scale
    # The constant of the columns as they are, not centered.
    back = np.eye(k)
    back[0, 1:] = [-m for m in means[:-1]]
    b, cov = back @ b, back @ cov @ back.T
    b[0] += means[-1]
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    r2 = 1 - row2[0] / row[0] if row[0] else None
    z = normal_ppf(0.975)
    rows = []
    for c, a, s in zip(["const", *columns], b, se, strict=True):
        a, s = float(a), float(s)
        rows.append((c, a, s, a / s if s else None, float(t_two_sided(a / s, n - k)) if s and n > k else None, a - z * s, a + z * s, None if r2 is None else float(r2), n))
    return df.sparkSession.createDataFrame(rows, schema)


def did(df: DataFrame, post: Column, treated: Column, outcome: str) -> DataFrame:
    """Difference in differences from four cell means."""
    y = q(outcome).cast("double")
    cell = lambda a, b: F.avg(F.when((post == F.lit(a)) & (treated == F.lit(b)), y))
    return df.agg(cell(True, True).alias("treated_post"), cell(False, True).alias("treated_pre"), cell(True, False).alias("control_post"), cell(False, False).alias("control_pre")).withColumn("did", F.col("treated_post") - F.col("treated_pre") - F.col("control_post") + F.col("control_pre"))


def did_regression(df: DataFrame, post: Column, treated: Column, outcome: str, covariates: list[str] | None = None, weight: str | None = None, cluster: str | None = None) -> DataFrame:
    """The same as a regression, with covariates and, if asked for, weights and clusters."""
    a, b = post.cast("double"), treated.cast("double")
    return ols(df.withColumns({"post": a, "treated": b, "post_x_treated": a * b}), outcome, ["post", "treated", "post_x_treated", *(covariates or [])], weight, cluster)


def stabilized_weights(df: DataFrame, treatment: str, score: str, name: str = "ipw", clip: float = 0.001) -> DataFrame:
    """Rows with the share of their treatment over its probability, clipped."""
    share = df.agg(F.avg(q(treatment).cast("double"))).first()[0]
    p = F.least(F.greatest(q(score), F.lit(clip)), F.lit(1 - clip))
    return df.withColumn(name, F.when(q(treatment) == 1, F.lit(share) / p).otherwise((1 - F.lit(share)) / (1 - p)))


def upgraded_did(df: DataFrame, time: str, treatment: str, outcome: str, candidates: list[str], key: str, user: str | None = None, treatment_time: str | None = None, weighted: bool = False, rounds: int = 5, top: int = 5, alpha: float = 0.05, trees: int = 20) -> DataFrame:
    """Difference in differences with chosen covariates: did, p, interval, covariates, R squared, round, n; one row.

    Treatment starts at the median time unless given.  Each round takes the ``top`` candidates by forest importance, keeps
    those that a cross-validated lasso keeps, fits (errors clustered by ``user`` if given) and refits with the
    significant ones; rounds end with a significant effect, else go on without the first covariate, and the largest
    effect wins.  ``weighted`` applies the stabilized weights; the reference hands them to an estimator that ignores them.
    """
    from tessera.functions.ranks import quantiles
    from tessera.operators.features import lasso_path
    from tessera.operators.models import importances

    at = F.unix_seconds(q(time).cast("timestamp")).cast("double")
    whole = df.dropna(subset=[time, treatment, outcome]).withColumn("_at", at)
    start = quantiles(whole, ["_at"], [0.5])["_at"][0] if treatment_time is None else float(df.sparkSession.sql("SELECT unix_seconds(timestamp(:t)) AS t", {"t": treatment_time}).first()[0])
    schema = "did double, p double, low double, high double, covariates array<string>, r_squared double, round int, n long"
    if start is None:
        return df.sparkSession.createDataFrame([], schema)
    whole = written(whole.withColumns({"_post": (F.col("_at") >= F.lit(start)).cast("int"), "_treated": q(treatment).cast("int"), **{c: F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in candidates}}), "did")
    spread = per_column(whole, candidates, v=lambda c: F.var_samp(c)).collect() if candidates else []
    left = [r["column"] for r in spread if (r["v"] or 0) > 1e-6]
    best = None
    for i in range(1, rounds + 1):
        chosen: list[str] = []
        if left:
            ranked = [r["column"] for r in importances(whole, left, outcome, trees).orderBy(F.desc("importance"), "column").limit(top).collect()]
            chosen = [r["column"] for r in lasso_path(whole, ranked, outcome, key).collect() if abs(r["coefficient"]) > 1e-6]
        weight = None
        rows = whole
        if weighted:
            scored = propensity(whole, "_treated", chosen, "_p") if chosen else whole.withColumn("_p", F.lit(whole.agg(F.avg("_treated")).first()[0]))
            rows, weight = written(stabilized_weights(scored, "_treated", "_p"), "weights"), "ipw"
        fit = lambda c: {r["term"]: r for r in did_regression(rows, F.col("_post") == 1, F.col("_treated") == 1, outcome, c, weight, user).collect()}  # noqa: B023, E731
        terms = fit(chosen)
        significant = [c for c in chosen if c in terms and (terms[c]["p"] is not None and terms[c]["p"] <= alpha)]
        if significant and significant != chosen:
            terms = fit(significant)
        if not terms:
            break
        t = terms["post_x_treated"]
        sure = t["p"] is not None and t["p"] <= alpha
        if best is None or sure or abs(t["coefficient"]) > abs(best[0]):
            best = (t["coefficient"], t["p"], t["low"], t["high"], significant, t["r_squared"], i, t["n"])
        if sure or not chosen:
            break
        left = [c for c in left if c != chosen[0]]
    return df.sparkSession.createDataFrame([best] if best else [], schema)


def pre_trend(df: DataFrame, period: Column, post: Column, treated: Column, outcome: str) -> DataFrame:
    """Slopes of the groups' means over the periods before treatment; a warning beyond 10 % of the outcome's range."""
    y = q(outcome).cast("double")
    means = df.where(~post).groupBy(period.alias("period"), treated.alias("treated")).agg(F.avg(y).alias("m"))
    s = means.groupBy("treated").agg(F.regr_slope("m", F.datediff("period", F.lit("1970-01-01")).cast("double")).alias("slope"))
    one = s.agg(F.max(F.when(F.col("treated"), F.col("slope"))).alias("treated_slope"), F.max(F.when(~F.col("treated"), F.col("slope"))).alias("control_slope"))
    width = df.agg((F.max(y) - F.min(y)).alias("width"))
    return one.join(width).select("treated_slope", "control_slope", (F.abs(F.col("treated_slope") - F.col("control_slope")) > 0.1 * F.col("width")).alias("warn"))


def mean_difference(df: DataFrame, treatment: Column, outcome: str, by: list[Column] | None = None, weight: Column | None = None) -> DataFrame:
    """Rows (weights, if given) and the difference of the treated's and the others' mean outcome, in all or by group."""
    y, w = q(outcome).cast("double"), F.lit(1.0) if weight is None else weight
    mean = lambda c: F.try_divide(F.sum(F.when(c & y.isNotNull(), w * y)), F.sum(F.when(c & y.isNotNull(), w)))
    n = F.count("*") if weight is None else F.sum(w).cast("long")
    return df.groupBy(*(by or [])).agg(n.alias("n"), (mean(treatment) - mean(~treatment)).alias("effect"))


def robustness(df: DataFrame, key: str, estimate: Callable[[DataFrame, list[Column], Column | None], DataFrame], subgroups: list[str] | None = None, date: str | None = None, drop_top: dict[str, list[float]] | None = None, replicates: int = 5, share: float = 0.8, least_year: int = 30) -> DataFrame:
    """An estimator on all rows, without the top shares of columns, by subgroup, by year of over ``least_year`` rows, and on replicates.

    ``estimate(rows, by, weight)`` gives n and effect for each group of ``by`` (see ``mean_difference``), so that
    subgroups, years and replicates are grouping keys of one pass each; replicates are Poisson bootstraps by a hash of
    the key.  ``drop_top``: columns with the shares to leave out, each share's columns one after the other.
    """
    from tessera.functions.ranks import quantiles

    view = lambda x, kind, name: x.select(F.lit(kind).alias("check"), name.cast("string").alias("name"), "n", "effect")
    parts = [view(estimate(df, [], None), "baseline", F.lit("all"))]
    for s in sorted({s for v in (drop_top or {}).values() for s in v}):
        rows = df
        for c in [c for c, v in drop_top.items() if s in v]:
            cut = quantiles(rows, [c], [1 - s])[c][0]
            rows = rows if cut is None else rows.where(q(c) <= F.lit(cut))
        parts.append(view(estimate(rows, [], None), "drop_top", F.lit(str(s))))
    for c in subgroups or []:
        parts.append(view(estimate(df, [q(c).alias("g")], None), f"by_{c}", F.col("g")))
    if date:
        parts.append(view(estimate(df.where(q(date).isNotNull()), [F.year(q(date)).alias("g")], None).where(F.col("n") > least_year), "year", F.col("g")))
    if replicates:
        reps = df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        reps = reps.withColumn("_w", poisson(F.xxhash64(q(key), F.col("_r")), share)).where("_w > 0")
        parts.append(view(estimate(reps, [F.col("_r").alias("g")], F.col("_w")), "bootstrap", F.col("g")))
    return reduce(DataFrame.unionByName, parts)


def poisson(h: Column, mean: float = 1.0) -> Column:
    """A Poisson count from 64 hashed bits, up to 7."""
    u = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    total, p, out = 0.0, float(np.exp(-mean)), F.lit(0)
    for k in range(1, 8):
        total += p
        p *= mean / k
        out = out + (u > total).cast("int")
    return out


def business_effect(df: DataFrame, effect: str, base: str, scale: float = 1.0) -> DataFrame:
    """Totals of effect x base, the new base and mean ROI (null for a zero base), with their correlation and p."""
    e, b = q(effect).cast("double"), q(base).cast("double")
    impact = e * b * F.lit(scale)
    r, n = corr(e, b), F.count(F.lit(1)).cast("double")
    one = df.where(e.isNotNull() & b.isNotNull()).agg(F.sum(impact).alias("total_impact"), F.sum(b + impact).alias("new_total"), F.avg(F.when(b != 0, impact / b)).alias("mean_roi"), r.alias("r"), n.alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.greatest(F.col("n") - 2, F.lit(0.0)), 1 - F.col("r") * F.col("r")))
    return one.select("total_impact", "new_total", "mean_roi", "r", on_rows(t_two_sided)(t, F.col("n") - 2).alias("p"))


def effect_candidates(df: DataFrame, columns: list[str], categories: list[str] | None = None, least: float = 0.1, top: int = 3) -> DataFrame:
    """(effect, base, r, confidence, base_confidence): columns that go with a base, by |r|, or for categories by information.

    Bases are the ``top`` numbers of the highest min(1, |skew| / 5 + 0.5).  A category's confidence is its mutual
    information with the deciles of the base over the largest of them; those under ``least`` are left out.  Where none is
    left, every other column is a candidate of each base, with a confidence of 0.2.
    """
    n, g = F.col("n").cast("double"), F.col("g")
    skew = g * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    s = per_column(df, columns, g=lambda x: F.skewness(x), n=lambda x: F.count(x)).where("n >= 2")
    bases = s.select("column", F.round(F.least(F.lit(1.0), F.abs(skew) / 5 + 0.5), 2).alias("base_confidence")).orderBy(F.desc_nulls_last("base_confidence"), "column").limit(top)
    bases = {r["column"]: r["base_confidence"] for r in bases.collect()}
    c = correlations(df, columns)
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).where(F.col("b").isin(*bases))
    out = both.select(F.col("a").alias("effect"), F.col("b").alias("base"), "r", F.abs("r").alias("confidence"))
    for base in bases if categories else ():
        edges = sorted(set(quantiles_of(df, base)))
        binned = df.select(bins_of(q(base).cast("double"), edges).alias("_bin"), *[q(x).cast("string").alias(x) for x in categories]).where("_bin IS NOT NULL")
        joint = binned.unpivot(["_bin"], categories, "effect", "value").where("value IS NOT NULL").groupBy("effect", "value", "_bin").agg(F.count("*").alias("k"))
        by = lambda *x: F.sum("k").over(Window.partitionBy("effect", *x))
        each = joint.select("effect", (F.col("k") / by() * F.log(F.col("k") * by() / (by("_bin") * by("value")))).alias("x"))
        mi = each.groupBy("effect").agg(F.sum("x").alias("mi"))
        out = out.unionByName(mi.select("effect", F.lit(base).alias("base"), F.lit(None).cast("double").alias("r"), F.try_divide("mi", F.max("mi").over(Window.partitionBy()) + 1e-9).alias("confidence")))
    level = reduce(lambda w, b: w.when(F.col("base") == b, F.lit(bases[b])), bases, F.when(F.lit(False), F.lit(None).cast("double")))
    found = written(out.where(F.col("confidence") >= least).select("effect", "base", F.round("r", 4).alias("r"), F.round("confidence", 2).alias("confidence"), level.alias("base_confidence")), "candidates")
    if not found.isEmpty():
        return found
    rows = [(c, b, None, 0.2, k) for b, k in bases.items() for c in (*columns, *(categories or ())) if c != b]
    return df.sparkSession.createDataFrame(rows, found.schema)


def quantiles_of(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    from tessera.functions.ranks import quantiles

    return [v for v in quantiles(df, [column], [i / bins for i in range(1, bins)])[column] if v is not None]


def scenarios(df: DataFrame, columns: list[str], spread: float = 0.2, steps: int = 10) -> DataFrame:
    """What each column's change by -spread to +spread does to the mean of every other: r x change x deviation ratio."""
    stats = per_column(df, columns, mean=lambda c: F.avg(c), sd=lambda c: F.stddev_samp(c))
    c = correlations(df, columns)
    pairs = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    a, b = stats.select(F.col("column").alias("a"), F.col("mean").alias("ma"), F.col("sd").alias("sa")), stats.select(F.col("column").alias("b"), F.col("sd").alias("sb"))
    grid = F.explode(F.array(*[F.lit(round(-spread + 2 * spread * i / (steps - 1), 12)) for i in range(steps)]))
    wide = pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b").withColumn("pct", grid)
    return wide.select(F.col("a").alias("changed"), F.col("b").alias("other"), "pct", (F.col("ma") * F.col("pct")).alias("change"), (F.col("r") * F.col("ma") * F.col("pct") * F.try_divide("sb", "sa")).alias("impact"))


def model_effects(df: DataFrame, columns: list[str], target: str, spread: float = 0.2, steps: int = 10, trees: int = 20) -> DataFrame:
    """What models make of each column's change by -spread to +spread: its least-squares coefficient, and its forest importance, times the change of its mean.

    A text target is coded by the order of its levels.  One Gram matrix and one forest for all columns.
    """
    from tessera.operators.models import importances

    if target not in numeric_columns(df):
        from tessera.operators.roles import encode

        df = encode(df, target).withColumn(target, q(f"{target}_code"))
    rows = df.dropna(subset=[target]).withColumns({c: F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in columns})
    n, means, m = gram(rows, [*columns, target])
    if n < 2:
        return df.sparkSession.createDataFrame([], "column string, pct double, change double, coefficient double, importance double, linear_effect double, forest_effect double")
    b = inverse(m[:-1, :-1]) @ m[:-1, -1]
    share = {r["column"]: r["importance"] for r in importances(rows, columns, target, trees).collect()}
    plain = per_column(df, columns, mean=lambda c: F.avg(c)).collect()
    mean = {r["column"]: r["mean"] for r in plain}
    found = [(c, mean[c], float(v), float(share.get(c) or 0.0)) for c, v in zip(columns, b, strict=True)]
    grid = F.explode(F.array(*[F.lit(round(-spread + 2 * spread * i / (steps - 1), 12)) for i in range(steps)]))
    out = df.sparkSession.createDataFrame(found, "column string, mean double, coefficient double, importance double").withColumn("pct", grid)
    change = F.col("mean") * F.col("pct")
    return out.select("column", "pct", change.alias("change"), "coefficient", "importance", (F.col("coefficient") * change).alias("linear_effect"), (F.col("importance") * change).alias("forest_effect"))


def sign_stability(df: DataFrame, key: str, columns: list[str], replicates: int = 200, least: float = 0.2) -> DataFrame:
    """The share of Poisson bootstrap replicates in which a correlation keeps its sign, for pairs of |r| >= least.

    All pairs and replicates in one pass: weights of a batch are a matrix, and no row is repeated.
    """
    pairs = [(r["a"], r["b"], r["r"]) for r in correlations(df, columns).where(F.abs("r") >= least).collect()]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "a string, b string, r double, stability double")
    used = sorted({c for a, b, _ in pairs for c in (a, b)})
    means = df.agg(*[F.avg(q(c).cast("double")).alias(str(i)) for i, c in enumerate(used)]).first()
    near = df.select(q(key).alias("_key"), *[(q(c).cast("double") - F.lit(means[i])).alias(c) for i, c in enumerate(used)])
    at = {c: i for i, c in enumerate(used)}
    sums = grams.replicate_sums(near, F.xxhash64("_key"), used, [(at[a], at[b]) for a, b, _ in pairs], replicates)
    n, first, products = sums[:, :1], sums[:, 1 : 1 + len(used)], sums[:, 1 + len(used) :]
    mean = first / np.maximum(n, 1)
    rows = []
    for i, (a, b, r) in enumerate(pairs):
        cov = products[:, i] - mean[:, at[a]] * first[:, at[b]]
        rows.append((a, b, r, float(np.mean(np.sign(cov) == np.sign(r)))))
    return spark.createDataFrame(rows, "a string, b string, r double, stability double")


def coefficient_stability(df: DataFrame, key: str, columns: list[str], target: str, folds: int = 5) -> DataFrame:
    """Share of folds in which the least-squares coefficient has the sign of that over all rows; one pass, a Gram matrix a fold."""
    grams = fold_grams(df, key, [*columns, target], folds)
    n, s, p = (sum(g[i] for g in grams) for i in range(3))

    def fit(n, s, p):
        c = p / n - np.outer(s, s) / n**2
        return inverse(c[:-1, :-1]) @ c[:-1, -1]

    if not n:
        return df.sparkSession.createDataFrame([], "column string, coefficient double, stability double")
    whole = fit(n, s, p)
    own = np.array([fit(n - a, s - b, p - c) for a, b, c in grams if n > a])
    rows = [(c, float(whole[i]), float((np.sign(own[:, i]) == np.sign(whole[i])).mean()) if len(own) else None) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, coefficient double, stability double")


def pick_driver(df: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """The column of the largest |r| > 0.3 with the outcome, of some spread and little skew."""
    s = per_column(df, columns, v=lambda c: F.var_samp(c), lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"), skew=lambda c: F.skewness(c), r=lambda c: corr(c, q(outcome)))
    fit = s.where((F.try_divide("v", F.col("hi") - F.col("lo")) > 0.1) & (F.abs("skew") < 2) & (F.abs("r") > 0.3))
    return fit.orderBy(F.desc(F.abs("r")), "column").limit(1).select("column", "r")


def profit_proxies(df: DataFrame, revenue: Column, cost: Column, treatment: Column, outcome: str) -> DataFrame:
    """Mean (revenue - cost) / revenue, and the relative difference of treated to control means."""
    y = q(outcome).cast("double")
    control = F.avg(F.when(~treatment, y))
    return df.agg(F.avg(F.try_divide(revenue - cost, revenue)).alias("roi"), F.try_divide(F.avg(F.when(treatment, y)) - control, control).alias("att_relative"))


def key_results(drivers: DataFrame, means: DataFrame, top: int = 5) -> DataFrame:
    """Drivers (column, coefficient, stability) as key results: the baseline and 10 % more or less of it as target."""
    rows = drivers.join(means, "column").withColumn("target", F.round(F.col("mean") * F.when(F.col("coefficient") >= 0, 1.1).otherwise(0.9), 2))
    return rows.orderBy(F.desc("stability"), F.desc(F.abs("coefficient")), "column").limit(top).select("column", "coefficient", "stability", F.col("mean").alias("baseline"), "target")
