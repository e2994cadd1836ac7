"""Model-ready features: fills, scaling, one-hot, interactions, selection, target and model choice."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric_columns, q
from tessera.functions.frequencies import distinct_values, hashed_counts, most_frequent
from tessera.functions.distributions import normal_ppf
from tessera.functions.ranks import quantiles
from tessera.operators.relate import fold_grams

MISSING = "missing"


def impute_numbers(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Nulls as the median (exact) or mean."""
    row = [v[0] for v in quantiles(df, columns, [0.5]).values()] if how == "median" else df.agg(*[F.avg(q(c).cast("double")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(row[i]).cast("double")) for i, c in enumerate(columns)})


def impute_categories(df: DataFrame, columns: list[str], how: str = "most_frequent") -> DataFrame:
    """Nulls as the most frequent value (ties: the smallest) or as a word of their own."""
    if how == MISSING:
        return df.withColumns({c: F.coalesce(q(c), F.lit(MISSING)) for c in columns})
    top = most_frequent(df, columns, 1).select("column", "value")
    mode = {r["column"]: r["value"] for r in top.collect()}
    return df.withColumns({c: F.coalesce(q(c), F.lit(mode.get(c))) for c in columns})


def scale(df: DataFrame, columns: list[str], how: str = "standard", grid: int = 100) -> DataFrame:
    """standard ((x - mean) / population deviation), robust ((x - median) / IQR) or quantile (to normal scores)."""
    if how == "quantile":
        edges = quantiles(df, columns, [i / grid for i in range(grid + 1)])

        def normal(edges: list[float]):
            known, scores = np.array(edges), np.array([normal_ppf(min(max(i / grid, 1e-7), 1 - 1e-7)) for i in range(grid + 1)])

            @F.pandas_udf("double")
            def run(x):
                return x.__class__(np.interp(x, known, scores)).where(x.notna().to_numpy())

            return run

        return df.withColumns({c: normal(edges[c])(q(c).cast("double")) for c in columns if edges[c][0] is not None})
    if how == "standard":
        row = df.agg(*[x for c in columns for x in (F.avg(q(c)), F.stddev_pop(q(c)))]).first()
        by = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    else:
        by = {c: (m, None if m is None else b - a) for c, (a, m, b) in quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    return df.withColumns({c: (q(c) - F.lit(m).cast("double")) / F.lit(float(s or 1.0)) for c, (m, s) in by.items()})


def one_hot(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """A 0/1 column for each category in order; more than ``limit`` raise an error, as plans would grow too wide."""
    values = [r[0] for r in df.select(q(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return df.select("*", *[F.coalesce(q(column).cast("string") == v, F.lit(False)).cast("int").alias(f"{column}__{v}") for v in values])


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[(q(a) * q(b)).alias(f"{a}_x_{b}") for a, b in combinations(columns, 2)])


def polynomials(df: DataFrame, columns: list[str], degree: int = 3) -> DataFrame:
    """All monomials of degree 2 to ``degree``."""
    terms = [t for d in range(2, degree + 1) for t in combinations_with_replacement(columns, d)]
    return df.select("*", *[reduce(lambda a, b: a * b, [q(c).cast("double") for c in t]).alias("__".join(t)) for t in terms])


def crosses(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.concat_ws("_", q(a), q(b)).alias(f"{a}_x_{b}") for a, b in combinations(columns, 2)])


def drop_constant(df: DataFrame) -> DataFrame:
    """Without numeric columns of zero variance."""
    numbers = numeric_columns(df)
    row = df.agg(*[F.var_pop(q(c)).alias(str(i)) for i, c in enumerate(numbers)]).first() if numbers else ()
    return df.drop(*[c for c, v in zip(numbers, row, strict=True) if not v])


def centered(df: DataFrame, columns: list[str], scaled: bool = True) -> DataFrame:
    """A vector column ``features`` of complete rows, centered and scaled by the population deviation."""
    whole = df.dropna(subset=columns).withColumns({f"_{c}": q(c).cast("double") for c in columns})
    row = whole.agg(*[x for c in columns for x in (F.avg(q(f"_{c}")), F.stddev_pop(q(f"_{c}")))]).first()
    z = whole.withColumns({f"_{c}": (q(f"_{c}") - F.lit(row[2 * i])) / F.lit((row[2 * i + 1] or 1.0) if scaled else 1.0) for i, c in enumerate(columns)})
    return VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="features").transform(z).drop(*[f"_{c}" for c in columns])


def principal_components(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Explained variance of each component and its loadings, the largest one positive; nothing for fewer than two complete rows."""
    if df.dropna(subset=columns).limit(2).count() < 2:
        return df.sparkSession.createDataFrame([], "component int, explained double, column string, loading double")
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="pc").fit(centered(df, columns))
    loadings = model.pc.toArray()
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    rows = [(j + 1, float(model.explainedVariance[j]), columns[i], float(loadings[i, j])) for j in range(loadings.shape[1]) for i in range(len(columns))]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, column string, loading double")


def project(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Rows with their component scores ``pc`` as an array."""
    z = centered(df, columns)
    return PCA(k=min(k, len(columns)), inputCol="features", outputCol="pc").fit(z).transform(z).withColumn("pc", vector_to_array("pc")).drop("features")


def lasso_path(df: DataFrame, columns: list[str], target: str, key: str, folds: int = 5, alphas: int = 20) -> DataFrame:
    """Coefficients of the lasso (on standardized columns) with the penalty that cross-validates best.

    One pass gathers a Gram matrix for each fold; training sets are the total less the fold; coordinate descent runs on k x k.
    """
    grams = [g for g in fold_grams(df, key, [*columns, target], folds) if g[0]]
    if not grams or not columns:
        return df.sparkSession.createDataFrame([], "column string, coefficient double, selected boolean, alpha double")
    n_all, s_all, p_all = (sum(g[i] for g in grams) for i in range(3))

    def moments(n, s, p):
        c = p / n - np.outer(s, s) / n**2
        return c, np.sqrt(np.maximum(np.diag(c), 1e-300))

    def descend(c, y, alpha):
        b = np.zeros(len(y))
        for _ in range(500):
            old = b.copy()
            for j in range(len(b)):
                rho = y[j] - c[j] @ b + c[j, j] * b[j]
                b[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / c[j, j] if c[j, j] > 1e-12 else 0.0
            if np.abs(b - old).max() < 1e-12:
                break
        return b

    c, sd = moments(n_all, s_all, p_all)
    r = c / np.outer(sd, sd)
    top = max(np.abs(r[:-1, -1]).max(), 1e-300)
    best, best_error = top, np.inf
    for alpha in np.geomspace(top, top / 1000, alphas):
        error = 0.0
        for n, s, p in grams:
            if n == n_all:  # one fold holds all rows: nothing to validate with
                continue
            ct, _ = moments(n_all - n, s_all - s, p_all - p)
            zt, zv = ct / np.outer(sd, sd), (p / n - np.outer(s, s) / n**2) / np.outer(sd, sd)
            b = descend(zt[:-1, :-1], zt[:-1, -1], alpha)
            error += n * (zv[-1, -1] - 2 * b @ zv[:-1, -1] + b @ zv[:-1, :-1] @ b)
        if error < best_error - 1e-12:
            best, best_error = alpha, error
    b = descend(r[:-1, :-1], r[:-1, -1], best) * sd[-1] / sd[:-1]
    return df.sparkSession.createDataFrame([(x, float(v), bool(abs(v) > 1e-12), float(best)) for x, v in zip(columns, b, strict=True)], "column string, coefficient double, selected boolean, alpha double")


def target_candidates(df: DataFrame) -> DataFrame:
    """Columns that could be a target: numbers of more than 20 values, else categories of 2 to 10; best first."""
    kinds = dict(df.dtypes)
    counts = hashed_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n"))
    number = F.col("column").isin(*numeric_columns(df))
    at = F.create_map(*[x for i, c in enumerate(kinds) for x in (F.lit(c), F.lit(i))])[F.col("column")]
    rank = F.when(number & (F.col("n_unique") > 20) & (F.col("n_unique") < 0.95 * F.col("n")), 1).when(F.col("n_unique").between(2, 10), 2)
    return counts.select("column", "n_unique", rank.alias("rank"), at.alias("at")).where("rank IS NOT NULL").orderBy("rank", "at")


def lower_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts in lower case, for vectorizers; other columns stay."""
    return df.withColumns({c: F.lower(q(c)) for c in columns})


#: The ordered rules of the model shortlist. Condition on problem, n_rows, features, imbalanced, seasonal, arbitrary_shapes.
SHORTLIST = (
    ("problem = 'classification' AND n_rows < 1000 AND features < 20", "LogisticRegression SVC KNeighborsClassifier DecisionTreeClassifier"),
    ("problem = 'classification' AND n_rows < 1000 AND features >= 20", "LogisticRegression LinearSVC NaiveBayes"),
    ("problem = 'classification' AND n_rows < 5000 AND features > 100", "LinearSVC LogisticRegression XGBClassifier"),
    ("problem = 'classification' AND imbalanced", "XGBClassifier LGBMClassifier CatBoostClassifier"),
    ("problem = 'classification' AND n_rows >= 5000 AND features < 100", "RandomForestClassifier XGBClassifier LGBMClassifier CatBoostClassifier"),
    ("problem = 'classification' AND n_rows >= 20000 AND features >= 100", "RandomForestClassifier XGBClassifier LGBMClassifier MLPClassifier"),
    ("problem = 'regression' AND n_rows < 2000 AND features < 20", "LinearRegression Ridge Lasso ElasticNet SVR"),
    ("problem = 'regression' AND n_rows < 2000 AND features >= 20", "Lasso ElasticNet SVR RandomForestRegressor"),
    ("problem = 'regression' AND n_rows >= 2000 AND n_rows < 10000 AND features <= 50", "RandomForestRegressor XGBRegressor LGBMRegressor"),
    ("problem = 'regression' AND n_rows >= 10000", "XGBRegressor LGBMRegressor CatBoostRegressor MLPRegressor"),
    ("problem = 'time_series' AND n_rows < 5000 AND seasonal", "ARIMA SARIMA ExponentialSmoothing Prophet"),
    ("problem = 'time_series' AND n_rows >= 5000 AND n_rows < 20000", "XGBRegressor LGBMRegressor Prophet"),
    ("problem = 'time_series' AND n_rows >= 20000", "XGBRegressor LGBMRegressor LSTM GRU TCN"),
    ("problem = 'clustering' AND arbitrary_shapes", "DBSCAN HDBSCAN OPTICS"),
    ("problem = 'text' AND n_rows < 5000", "NaiveBayes LogisticRegression LinearSVC"),
    ("problem = 'text' AND n_rows >= 50000", "Transformer BERT CNN_Text RNN_Text"),
)
FALLBACK = "RandomForest"


def model_shortlist(df: DataFrame, target: str | None, problem: str | None = None, seasonal: bool = False, arbitrary_shapes: bool = False) -> DataFrame:
    """Problem, rows, features, most categories, share of the rarest class, and the models of the first rule that fits.

    Without a target the problem is clustering; a text target, or a number of at most 20 values, is classification.
    """
    schema = dict(df.dtypes)
    texts = [c for c, t in schema.items() if t == "string" and c != target]
    most = distinct_values(df, texts).select(F.col("n_unique").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).cast("long").alias("max_categories")) if texts else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("max_categories"))
    if target is None:
        c = df.agg(F.count("*").alias("n_rows")).withColumns({"classes": F.lit(0).cast("long"), "least": F.lit(None).cast("long")})
        kind = F.lit(problem or "clustering")
    else:
        counts = df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("v")).agg(F.count("*").alias("n"))
        c = counts.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.min("n").alias("least"))
        kind = F.lit(problem) if problem else F.when(F.lit(schema[target] != "string") & (F.col("classes") > 20), "regression").otherwise("classification")
    c = c.crossJoin(most).select(kind.alias("problem"), "n_rows", F.lit(len(df.columns) - (target is not None)).alias("features"), "max_categories", F.try_divide("least", "n_rows").alias("least_share"))  # single rows
    c = c.withColumns({"imbalanced": F.coalesce((F.col("problem") == "classification") & (F.col("least_share") < 0.2), F.lit(False)), "seasonal": F.lit(seasonal), "arbitrary_shapes": F.lit(arbitrary_shapes)})
    first = F.coalesce(*[F.when(F.expr(rule), F.struct(F.lit(i + 1).alias("rule"), F.lit(models).alias("models"))) for i, (rule, models) in enumerate(SHORTLIST)], F.struct(F.lit(len(SHORTLIST) + 1).alias("rule"), F.lit(FALLBACK).alias("models")))
    return c.withColumn("x", first).select("problem", "n_rows", "features", "max_categories", "least_share", "imbalanced", "x.rule", "x.models")
