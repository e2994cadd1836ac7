"""Clusters, anomalies, importances, splits and candidate models, by MLlib and one small forest of isolation trees."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import q
from tessera.functions.ranks import quantiles
from tessera.functions.selection import smallest_of_groups
from tessera.functions.tables import written
from tessera.operators.features import centered
from tessera.operators.forests import BINS, CELLS, edges_of, forest_shares, forest_values, n_cells


#: Rows that one task of k-means or of MLlib's forest keeps between rounds.
TASK_ROWS = 1_000_000


def _in_tasks(z: DataFrame) -> DataFrame:
    """Vectors alone, in tasks of TASK_ROWS at most: a part of a compressed file holds many times its bytes once it is kept as objects."""
    tasks, narrow = -(-z.count() // TASK_ROWS), z.select("features")
    return narrow.repartition(tasks) if tasks > narrow.rdd.getNumPartitions() else narrow


def cluster(df: DataFrame, columns: list[str], k: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows with their cluster (standardized complete rows), and a summary: size, centroid in original units, silhouette.

    The silhouette is the linear one (squared Euclidean), null where all rows fall into one cluster.  Fewer rows than clusters give no rows.
    """
    z = written(centered(df, columns), "centered")
    if z.limit(k).count() < k:  # fewer rows than clusters: none
        empty = z.drop("features").withColumn("cluster", F.lit(0)).limit(0)
        return empty, empty.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(q(c)).alias(c) for c in columns]).withColumn("silhouette", F.lit(None).cast("double"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(_in_tasks(z))
    rows = model.transform(z)
    several = rows.select("cluster").distinct().count() > 1
    silhouette = float(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(rows)) if several else None
    summary = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(q(c)).alias(c) for c in columns]).withColumn("silhouette", F.lit(silhouette).cast("double"))
    return rows.drop("features"), summary


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    """A node (column, split, left, right), or a leaf [depth reached]."""
    if depth == 0 or len(x) <= 1 or (x.min(0) == x.max(0)).all():
        return [_average_path(len(x))]
    live = np.flatnonzero(x.min(0) < x.max(0))
    c = int(rng.choice(live))
    split = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    low = x[:, c] < split
    return [c, split, _tree(x[low], rng, depth - 1), _tree(x[~low], rng, depth - 1)]


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _paths(node: list, x: np.ndarray, rows: np.ndarray, out: np.ndarray, depth: int) -> None:
    if len(node) == 1:
        out[rows] += depth + node[0]
        return
    low = x[rows, node[0]] < node[1]
    _paths(node[2], x, rows[low], out, depth + 1)
    _paths(node[3], x, rows[~low], out, depth + 1)


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Rows with an anomaly score (0 to 1): trees of ``sample`` rows by hash of the key, scored in batches; nulls are 0."""
    x = [F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    pool = df.select(*x, F.xxhash64(q(key)).alias("_h")).orderBy("_h").limit(sample * 20).drop("_h").toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    size = min(sample, len(pool))
    forest = [_tree(pool[rng.choice(len(pool), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []
    norm = _average_path(size) or 1.0

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        m = np.stack([v.to_numpy() for v in values], 1)
        total = np.zeros(len(m))
        for t in forest:
            _paths(t, m, np.arange(len(m)), total, 0)
        return pd.Series(2.0 ** (-total / max(len(forest), 1) / norm))

    return df.withColumn("score", score(*x))


def anomalies(df: DataFrame, key: str, columns: list[str], contamination: float = 0.05) -> DataFrame:
    """Rows with ``score`` and ``is_anomaly``: beyond the share of ``contamination``."""
    scored = isolation_scores(df, key, columns)
    scored = written(scored, "scored")
    cut = quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn("is_anomaly", F.col("score") > F.lit(cut).cast("double"))


#: Trees of a forest that tells importances, and classes that it knows by cells.
TREES, LEVELS = 100, 100


def importances(df: DataFrame, columns: list[str], target: str, trees: int = TREES, seed: int = 42) -> DataFrame:
    """Random-forest importances: classes for a text target, else values; none for fewer than two complete rows.

    Where the bins of the columns make few cells, one pass over the rows gives all trees what they need (``forests``).  With more of them MLlib
    grows the forest on rows that are written first and dealt to tasks of TASK_ROWS at most: every level of every tree reads them again.
    """
    spark, text = df.sparkSession, dict(df.dtypes)[target] == "string"
    whole = df.dropna(subset=[*columns, target]).select(*[q(c).cast("double").alias(c) for c in columns], q(target))
    if whole.limit(2).count() < 2:
        return spark.createDataFrame([], "column string, importance double")
    edges = edges_of(whole, columns)
    levels = sorted(r[0] for r in whole.select(q(target)).distinct().limit(LEVELS + 1).collect()) if text else None
    if n_cells(edges) * len(levels or [1]) <= CELLS and len(levels or []) <= LEVELS and target not in columns:
        shares = forest_shares(whole, columns, target, levels, edges, trees, 8, seed)
        return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, shares, strict=True)], "column string, importance double")
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(whole)
    if text:
        data = _spread(written(StringIndexer(inputCol=target, outputCol="_y").fit(whole).transform(data).select("_x", "_y"), "forest-rows"))
        model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed, maxDepth=8).fit(data)
    else:
        data = _spread(written(data.select("_x", q(target).cast("double").alias("_y")), "forest-rows"))
        model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed, maxDepth=8).fit(data)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "column string, importance double")


def _spread(df: DataFrame) -> DataFrame:
    """Written rows over as many tasks as there are cores, where a small file would keep them in fewer, and over more where one would get over TASK_ROWS."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def split(df: DataFrame, key: str, share: float = 0.2, target: str | None = None) -> DataFrame:
    """Rows with ``is_validation``: by a hash of the key the same rows each time; with a ``target``, of each class exactly its rounded share.

    A class of one row stays in training.
    """
    h = F.pmod(F.xxhash64(q(key), F.lit(5)), F.lit(1 << 30))
    if target is None:
        return df.withColumn("is_validation", h < F.lit(int(share * (1 << 30))))
    rows = df.withColumns({"_class": q(target), "_h": F.shiftrightunsigned(F.xxhash64(q(key), F.lit(5)), 11) / float(1 << 53)})
    wanted = F.when(F.col("n") > 1, F.floor(F.col("n") * share + 0.5)).otherwise(0)
    return smallest_of_groups(rows, ["_class"], "_h", wanted).withColumnRenamed("is_taken", "is_validation").drop("_class", "_h")


#: Candidates that know two classes only.
TWO_CLASSES = frozenset(("svc", "boosting"))
REGRESSORS = {"linear": lambda **k: LinearRegression(**k), "ridge": lambda **k: LinearRegression(regParam=1.0, **k), "lasso": lambda **k: LinearRegression(regParam=0.1, elasticNetParam=1.0, **k), "elastic_net": lambda **k: LinearRegression(regParam=0.1, elasticNetParam=0.5, **k), "tree": lambda **k: DecisionTreeRegressor(seed=42, **k), "forest": lambda **k: RandomForestRegressor(seed=42, numTrees=20, **k), "boosting": lambda **k: GBTRegressor(seed=42, maxIter=10, **k)}
CLASSIFIERS = {"logistic": lambda **k: LogisticRegression(**k), "svc": lambda **k: LinearSVC(maxIter=20, **k), "tree": lambda **k: DecisionTreeClassifier(seed=42, **k), "forest": lambda **k: RandomForestClassifier(seed=42, numTrees=20, **k), "boosting": lambda **k: GBTClassifier(seed=42, maxIter=10, **k), "naive_bayes": lambda **k: NaiveBayes(modelType="gaussian", **k)}


def compare_models(df: DataFrame, key: str, columns: list[str], target: str, models: list[str] | None = None, params: dict | None = None) -> DataFrame:
    """(model, metric, value) on held-out rows: RMSE for numbers, accuracy for a text target, which leaves out the candidates of two classes alone where it has more.

    Nothing for fewer than two complete rows or without held-out ones.
    """
    classes = dict(df.dtypes)[target] == "string"
    rows = split(df.dropna(subset=[*columns, target]), key, target=target if classes else None)
    if classes and rows.isEmpty():  # an indexer needs a level
        return df.sparkSession.createDataFrame([], "model string, metric string, value double")
    steps = [VectorAssembler(inputCols=columns, outputCol="_x")] + ([StringIndexer(inputCol=target, outputCol="_y")] if classes else [])
    data = Pipeline(stages=steps).fit(rows).transform(rows).withColumnRenamed(target, "_y" if not classes else target)
    data = written(data, "model-rows")
    nothing = df.sparkSession.createDataFrame([], "model string, metric string, value double")
    sides = data.agg(F.count_if("is_validation"), F.count_if(~F.col("is_validation")), F.count_distinct(target if classes else F.lit(1))).first()
    if not sides[0] or sides[1] < 2 or classes and sides[2] < 2:
        return nothing
    chosen = {k: v for k, v in CLASSIFIERS.items() if sides[2] == 2 or k not in TWO_CLASSES} if classes else REGRESSORS
    judge = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy") if classes else RegressionEvaluator(labelCol="_y", metricName="rmse")
    known: dict[str, float] = {}
    if not classes and not params:
        names = models or list(chosen)
        known = _linear_errors(data, [n for n in names if n in LINEAR]) | _cell_errors(data, columns, [n for n in names if n not in LINEAR])
    found = []
    for name in models or list(chosen):
        if name in known:
            found.append((name, "rmse", known[name]))
            continue
        estimator = chosen[name](featuresCol="_x", labelCol="_y")
        for k, v in (params or {}).items():
            estimator.set(estimator.getParam(k), v)
        model = estimator.fit(data.where("NOT is_validation"))
        found.append((name, "accuracy" if classes else "rmse", float(judge.evaluate(model.transform(data.where("is_validation"))))))
    return df.sparkSession.createDataFrame(found, "model string, metric string, value double")


#: Candidates that are linear.
LINEAR = frozenset(("linear", "ridge", "lasso", "elastic_net"))


def _linear_errors(data: DataFrame, names: list[str]) -> dict[str, float]:
    """Held-out RMSE of linear candidates: a pass for each fit, one for all errors."""
    told = data.where("is_validation")
    for name in names:
        told = REGRESSORS[name](featuresCol="_x", labelCol="_y", predictionCol=f"_p_{name}").fit(data.where("NOT is_validation")).transform(told)
    errors = told.agg(*[F.sqrt(F.avg((F.col("_y") - F.col(f"_p_{n}")) ** 2)) for n in names]).first() if names else []
    return {n: float(e) for n, e in zip(names, errors, strict=True)}


def _cell_errors(data: DataFrame, columns: list[str], names: list[str]) -> dict[str, float]:
    """Held-out RMSE of trees, by cells of bins; nothing where they are too many.

    A tree asks for means and weights of bins alone, and so do boosting's residuals, as what it says is one value a cell: cells with a mean and a weight
    are fitted as their rows would be.  A forest's bootstraps need a pass over the rows.  Errors are those of every held-out row: a cell's spread and its mean's miss.
    """
    train = data.where("NOT is_validation")
    edges = edges_of(train, columns) if names else []
    if not names or n_cells(edges) > CELLS:
        return {}
    binned = data
    for i, (c, e) in enumerate(zip(columns, edges, strict=True)):
        splits = [float("-inf"), *np.nextafter(e, np.inf).tolist(), float("inf")]  # an edge belongs to the bin below it
        binned = binned.withColumn(f"_v{i}", q(c).cast("double"))
        binned = Bucketizer(splits=splits, inputCol=f"_v{i}", outputCol=f"_b{i}").transform(binned) if len(e) else binned.withColumn(f"_b{i}", F.lit(0.0))
        binned = binned.withColumn(f"_b{i}", F.col(f"_b{i}") + 1)  # MLlib guesses the number of zeros, which it needn't with none
    at, y = [f"_b{i}" for i in range(len(columns))], F.col("_y").cast("double")
    cells = binned.groupBy("is_validation", *at).agg(F.count("*").cast("double").alias("_w"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    cells = written(VectorAssembler(inputCols=at, outputCol="_x").transform(cells).withColumnRenamed("_m", "_y"), "model-cells")
    held = cells.where("is_validation")
    rmse = lambda p: F.sqrt(F.sum(F.col("_w") * (F.col("_v") + (F.col("_y") - p) ** 2)) / F.sum("_w"))
    out = {}
    for name in names:
        if name == "forest":
            values = forest_values(train, columns, "_y", edges, 20, 5, 42)
            h = held.select(*at, "_w", "_y", "_v").toPandas()  # a row for each cell
            said = values[np.ravel_multi_index([h[c].to_numpy().astype(int) - 1 for c in at], [len(e) + 1 for e in edges])]
            out[name] = float(np.sqrt((h["_w"] * (h["_v"] + (h["_y"] - said) ** 2)).sum() / h["_w"].sum()))
        else:
            told = REGRESSORS[name](featuresCol="_x", labelCol="_y", weightCol="_w", maxBins=2 * BINS).fit(cells.where("NOT is_validation")).transform(held)
            out[name] = float(told.agg(rmse(F.col("prediction"))).first()[0])
    return out


#: Candidate clusterings compare by silhouette.
CLUSTERS = (2, 3, 4, 5, 6)


def tuned(df: DataFrame, key: str, columns: list[str], target: str, model: str, grid: dict[str, list]) -> DataFrame:
    """(parameters, metric, value) of every combination of a grid for one candidate model, best first, on held-out rows."""
    from itertools import product

    found = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        r = compare_models(df, key, columns, target, [model], params).first()
        if r is None:
            break
        found.append((", ".join(f"{k}={v}" for k, v in params.items()), r["metric"], r["value"]))
    best = lambda r: -r[2] if r[1] == "accuracy" else r[2]
    return df.sparkSession.createDataFrame(sorted(found, key=best), "parameters string, metric string, value double")


def cluster_candidates(df: DataFrame, columns: list[str], sizes: tuple[int, ...] = CLUSTERS, seed: int = 42) -> DataFrame:
    """(k, silhouette) of k-means for each number of clusters, best first."""
    z = written(centered(df, columns).select("features"), "centered")
    dealt = _in_tasks(z)
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    sizes = tuple(k for k in sizes if z.limit(k).count() >= k)
    found = [(k, float(judge.evaluate(KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(dealt).transform(z)))) for k in sizes]
    return df.sparkSession.createDataFrame(sorted(found, key=lambda r: -r[1]), "k int, silhouette double")


#: Asked rows that are compared with every row; columns whose quantile bins make the cells of a tree, bits of their bins, points of a leaf (about).
FEW, SPLIT, BIN_BITS, LEAF = 100, 3, 13, 32
#: Levels of the tree that a step goes down, cells of a level that are broadcast, and places of a task.
STRIDE, MOST_CELLS, PLACES = 4, 1 << 18, 20_000


def nearest_rows(df: DataFrame, key: str, columns: list[str], changed: str, pct: float, asked: DataFrame) -> DataFrame:
    """For asked keys: the real row nearest to the row with ``changed`` moved by ``pct``, standardized; ties by the smaller key.

    A few asked rows are broadcast.  More of them walk a tree of cells together (``_nearest_by_cells``): no nested loop.
    """
    row = df.agg(*[x for c in columns for x in (F.avg(q(c)), F.stddev_pop(q(c)))]).first()
    z = lambda c, i: (c - F.lit(row[2 * i])) / F.lit(row[2 * i + 1] or 1.0)
    rows = df.dropna(subset=columns)
    keys = asked.select(q(key).alias("asked_key")).distinct()
    few = keys.limit(FEW + 1).count() <= FEW
    own = rows.join(F.broadcast(keys) if few else keys, q(key) == F.col("asked_key"), "left_semi").select(q(key).alias("asked_key"), *[z(q(c) * (1 + pct) if c == changed else q(c), i).cast("double").alias(f"a{i}") for i, c in enumerate(columns)])
    other = rows.select(q(key).alias("nearest_key"), *[z(q(c), i).cast("double").alias(f"b{i}") for i, c in enumerate(columns)])
    if not few:
        return _nearest_by_cells(own, other, len(columns))
    pairs = other.join(F.broadcast(own), F.col("nearest_key") != F.col("asked_key"))
    near = pairs.withColumn("distance", _distance(len(columns)))
    return near.groupBy("asked_key").agg(F.min(F.struct("distance", "nearest_key")).alias("m")).select("asked_key", "m.nearest_key", "m.distance")


def _distance(k: int) -> Column:
    return F.sqrt(_sum((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(k)))


def _sum(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _nearest_by_cells(own: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(asked_key, nearest_key, distance) of asked rows (asked_key, a0..) among rows (nearest_key, b0..).

    Rows of equal values are one point with its two smallest keys, and asked rows that move to one place ask once.  Only where the key
    found is the asked row's own does that row ask again, by itself.
    """
    a, b = [f"a{i}" for i in range(k)], [f"b{i}" for i in range(k)]
    lowest = F.dense_rank().over(Window.partitionBy(*b).orderBy("nearest_key"))
    points = other.where("nearest_key IS NOT NULL").withColumn("_r", lowest).where("_r <= 2").groupBy(*b).agg(F.min("nearest_key").alias("k0"), F.max("nearest_key").alias("k1"))
    coded, asks = _leaves_asked(written(own.select(*a).distinct(), "places"), written(points, "points"), k)
    told = written(own.join(_best(asks, coded, a, k), a), "told")
    again = told.where("nearest_key = asked_key").select("asked_key", *a).join(asks, a)
    found = told.where("nearest_key <> asked_key").select("asked_key", "nearest_key", "distance").unionByName(_best(written(again, "again"), coded, ["asked_key"], k))
    return found.groupBy("asked_key").agg(F.min(F.struct("distance", "nearest_key")).alias("m")).select("asked_key", "m.nearest_key", "m.distance")


def _best(asks: DataFrame, coded: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., distance, nearest_key): the smallest key at the smallest distance, an asked key left out.  Two sums of numbers, no sort of pairs."""
    key = F.when(F.col("k0") != F.col("asked_key"), F.col("k0")).otherwise(F.when(F.col("k1") != F.col("asked_key"), F.col("k1"))) if "asked_key" in asks.columns else F.col("k0")
    near = lambda x: x.join(coded, "leaf").withColumns({"nearest_key": key, "_d": _distance(k)}).where("nearest_key IS NOT NULL")
    least = written(near(asks).groupBy(*by).agg(F.min("_d").alias("distance")), "distances")
    return near(asks.join(least, by)).where("_d = distance").groupBy(*by, "distance").agg(F.min("nearest_key").alias("nearest_key"))


def _leaves_asked(places: DataFrame, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Points (b0.., k0, k1) with their ``leaf``, and places (a0..) with each leaf that could hold one of their two nearest keys.

    Points get a code whose bits alternate between quantile bins of the first columns, each with the bits that its distinct bins need; its
    leading bits are a cell.  From the whole table down, a place keeps the cells whose box could hold a nearer point than the
    farthest corner of the best box of two keys: bounds, so nothing is lost.  Cells are few, so a place goes down all levels in
    one task and no shuffle.
    """
    a, dims, n = [f"a{i}" for i in range(k)], range(min(k, SPLIT)), points.count()
    wanted = max(1, math.ceil(math.log2(max(n, 2) / LEAF)))
    fine = 1 << min(BIN_BITS, wanted)
    edges = points.agg(*[F.percentile_approx(f"b{i}", [j / fine for j in range(1, fine)] or [0.5], 10_000) for i in dims]).first()
    coded, bits = points, []
    for i in dims:
        splits = [float("-inf"), *sorted(set(edges[i] or [])), float("inf")]
        coded = Bucketizer(splits=splits, inputCol=f"b{i}", outputCol=f"_bin{i}").transform(coded).withColumn(f"_bin{i}", F.col(f"_bin{i}").cast("int")) if len(splits) > 2 else coded.withColumn(f"_bin{i}", F.lit(0))
        bits.append((len(splits) - 2).bit_length())
    order = [F.shiftright(F.col(f"_bin{i}"), bits[i] - 1 - level).bitwiseAND(1).cast("long") for level in range(max(bits)) for i in dims if level < bits[i]] or [F.lit(0).cast("long")]
    depth = min(len(order), wanted)
    coded = written(coded.withColumn("leaf", reduce(lambda x, y: x * 2 + y, order[:depth])).drop(*[f"_bin{i}" for i in dims]), "coded")
    box = [x for i in range(k) for x in (F.min(f"b{i}").alias(f"lo{i}"), F.max(f"b{i}").alias(f"hi{i}"))]
    leaves = written(coded.groupBy("leaf").agg(F.min("k0").alias("k0"), F.max("k1").alias("k1"), *box), "leaves")
    merged = [x for i in range(k) for x in (F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"))]
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-places.count() // PLACES))
    frontier = places.repartition(tasks, *a).withColumn("cell", F.lit(0).cast("long"))
    levels = [*range(STRIDE, depth, STRIDE), depth]
    for above, level in zip([0, *levels[:-1]], levels, strict=True):
        cells = leaves.groupBy(F.shiftright("leaf", depth - level).alias("inner")).agg(F.min("k0").alias("k0"), F.max("k1").alias("k1"), *merged).withColumn("cell", F.shiftright("inner", level - above))
        down = frontier.join(F.broadcast(cells) if 1 << level <= MOST_CELLS else cells, "cell")
        gap = lambda i: F.greatest(F.col(f"lo{i}") - F.col(f"a{i}"), F.col(f"a{i}") - F.col(f"hi{i}"), F.lit(0.0))
        far = lambda i: F.greatest(F.abs(F.col(f"lo{i}") - F.col(f"a{i}")), F.abs(F.col(f"a{i}") - F.col(f"hi{i}")))
        # A cell of one key may hold the asked row alone: no bound.
        most = F.when(F.col("k0") != F.col("k1"), _sum(far(i) ** 2 for i in range(k))).otherwise(float("inf"))
        told = down.withColumns({"least": _sum(gap(i) ** 2 for i in range(k)), "most": most})
        bound = F.min("most").over(Window.partitionBy(*a))
        frontier = told.withColumn("bound", bound).where("least <= bound").select(*a, F.col("inner").alias("cell"))
    return coded, written(frontier.withColumnRenamed("cell", "leaf"), "frontier")
