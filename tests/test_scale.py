"""What keeps a step bounded at size, each against the plain version."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.operators.forests import cell_of, edges_of, tree_gains


def _rows(n: int = 3000) -> np.ndarray:
    r = np.random.default_rng(11)
    a, b, c = r.normal(size=n), r.integers(0, 50, n).astype(float), r.integers(0, 11, n) / 100
    return np.column_stack([a, b, c, 3 * a + 0.1 * b + 20 * c * (a > 0) + r.normal(size=n) + 1e4])


def test_a_tree_of_cells_is_a_tree_of_rows(spark):
    x = _rows()
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, y double")
    edges = edges_of(df, ["a", "b", "c"])
    bins = np.column_stack([np.searchsorted(e, v) for e, v in zip(edges, x.T[:3], strict=True)])
    counts = [len(e) + 1 for e in edges]
    cell = cell_of(list(x.T[:3]), edges)
    size = math.prod(counts)
    n, s = np.bincount(cell, minlength=size).astype(float), np.bincount(cell, x[:, 3] - x[:, 3].mean(), size)[None]
    got = tree_gains(n, s, np.array(np.unravel_index(np.arange(size), counts)), counts, 3, 5, np.random.default_rng(0))
    binned = spark.createDataFrame(np.column_stack([bins, x[:, 3]]).tolist(), "a double, b double, c double, y double")
    told = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(binned)
    want = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=5).fit(told).featureImportances.toArray()
    assert np.abs(got - want).max() < 1e-6


@pytest.mark.parametrize("text", [False, True])
def test_importances_by_cells(spark, text, monkeypatch):
    """As MLlib's forest tells them, without a table of rows between steps."""
    df = spark.createDataFrame(_rows().tolist(), "a double, b double, c double, y double")
    if text:
        df = df.withColumn("y", F.when(F.col("y") > 1e4 + 5, "high").when(F.col("y") > 1e4, "mid").otherwise("low"))
    told = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df.withColumn("y", F.ascii("y").cast("double") % 3) if text else df)
    forest = RandomForestClassifier if text else RandomForestRegressor
    want = forest(featuresCol="x", labelCol="y", numTrees=100, maxDepth=8, seed=1).fit(told).featureImportances.toArray()

    def refused(*_):
        raise AssertionError("rows are written")

    monkeypatch.setattr(models, "written", refused)
    got = {r["column"]: r["importance"] for r in models.importances(df, ["a", "b", "c"], "y").collect()}
    assert np.abs(np.array([got[c] for c in "abc"]) - want).max() < 0.03


def test_importances_of_many_columns_keep_their_rows(spark):
    x = np.random.default_rng(2).normal(size=(500, 6))
    df = spark.createDataFrame(np.column_stack([x, x[:, 0]]).tolist(), ", ".join(f"c{i} double" for i in range(6)) + ", y double")
    got = {r["column"]: r["importance"] for r in models.importances(df, [f"c{i}" for i in range(6)], "y", trees=5).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == "c0"


def test_nearest_rows_of_copies_and_few_values(spark, monkeypatch):
    """A column of few values takes its share of the cells, and copies are one point: pairs stay near LEAF for each place."""
    r = np.random.default_rng(4)
    x = np.column_stack([r.normal(size=1500).round(3) * 100, r.integers(0, 25, 1500)])
    x = np.concatenate([x, x, x[:500], [[0.0, 3.0], [0.0, 3.0], [0.0, 7.0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double")
    seen = []
    best = models._best

    def counted(asks, coded, by, k):
        seen.append(asks.join(coded, "leaf").count())
        return best(asks, coded, by, k)

    monkeypatch.setattr(models, "_best", counted)
    got = {t["asked_key"]: (t["nearest_key"], t["distance"]) for t in models.nearest_rows(df, "k", ["a", "b"], "a", 0.1, df.select("k")).collect()}
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    for i in range(len(x)):
        d = np.sqrt(((z - (x[i] * [1.1, 1] - mean) / sd) ** 2).sum(1))
        d[i] = np.inf
        key, distance = got[i]
        same = [j for j in np.flatnonzero((x == x[key]).all(1)) if j != i]
        assert abs(distance - d.min()) < 1e-9 and abs(d[key] - d.min()) < 1e-9 and key == same[0]
    assert len(got) == len(x)
    assert sum(seen) < 1503 * 400, seen


def test_ranges_grow_in_number(spark, monkeypatch):
    from tessera.functions import ranks

    kept = []
    plain = ranks.written
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100, raising=False)
    monkeypatch.setattr(ranks, "written", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    df = spark.range(5000).select("id", F.when(F.col("id") < 2500, F.lit(7.0)).otherwise(F.col("id") * 1.0).alias("x"))
    got = ranks.ranked_rows(df, "x")
    assert got.where("ties = 2500").agg(F.min("rank"), F.max("rank"), F.count("*")).first()[:] == (1250.5, 1250.5, 2500)
    assert got.where("ties = 1 AND rank <> id + 1").count() == 0
    assert kept[0].groupBy("_part").count().agg(F.max("count")).first()[0] <= 400


def test_trees_of_cells_err_as_trees_of_rows(spark):
    x = _rows(4000)
    df = models.split(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double, c double, _y double"), "k").cache()
    cols = ["a", "b", "c"]
    edges = edges_of(df.where("NOT is_validation"), cols)
    rows = df.toPandas()
    for c, e in zip(cols, edges, strict=True):
        rows[c] = np.searchsorted(e, rows[c]) + 1.0
    told = VectorAssembler(inputCols=cols, outputCol="_x").transform(spark.createDataFrame(rows))
    got = models._cell_errors(df, cols, ["tree", "boosting", "forest"])
    for name in got:
        p = models.REGRESSORS[name](featuresCol="_x", labelCol="_y", maxBins=64).fit(told.where("NOT is_validation")).transform(told.where("is_validation"))
        want = p.agg(F.sqrt(F.avg((F.col("_y") - F.col("prediction")) ** 2))).first()[0]
        assert abs(got[name] / want - 1) < (0.15 if name == "forest" else 1e-6), (name, got[name], want)
    assert models._linear_errors(VectorAssembler(inputCols=cols, outputCol="_x").transform(df), ["linear"])["linear"] > 0


def test_tasks_of_k_means_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100, raising=False)
    seen = []
    fit = models.KMeans.fit
    monkeypatch.setattr(models.KMeans, "fit", lambda self, df, *a: seen.append(df.rdd.glom().map(len).collect()) or fit(self, df, *a))
    df = spark.createDataFrame(_rows().tolist(), "a double, b double, c double, y double").coalesce(1)
    rows, _ = models.cluster(df, ["a", "b"], 3)
    assert rows.count() == sum(seen[0]) == 3000 and max(seen[0]) <= 130


def test_a_task_ranks_one_range(spark, monkeypatch):
    """No task of the ranking gets two ranges, and rows are ordered once."""
    from tessera.functions import ranks

    kept = []
    plain = ranks.written
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    monkeypatch.setattr(ranks, "written", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("id") / 7) * 1.0).alias("x"))
    got = ranks.ranked_rows(df, "x")
    largest = kept[0].groupBy("_part").count().agg(F.max("count")).first()[0]
    tasks = got.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert tasks[0] == largest and tasks[1] == kept[0].select("_part").distinct().count() > 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1, plan
    x = np.array([np.inf if i % 3 == 0 else i // 7 for i in range(3000)])
    rows = got.toPandas().set_index("id").sort_index()
    n = (x[:, None] == x[None]).sum(1)
    assert (rows["ties"].to_numpy() == n).all() and np.allclose(rows["rank"], (x[:, None] > x[None]).sum(1) + (n + 1) / 2)
    assert rows["is_first"].sum() == len(np.unique(x))


def test_rank_sums_add_up_in_one_pass(spark, monkeypatch):
    """Ranks of rows aren't written: sums of groups tell totals and ties, groups that no value is first in included."""
    from tessera.operators import relate

    def refused(*_):
        raise AssertionError("ranks are written")

    monkeypatch.setattr(relate, "written", refused)
    monkeypatch.setattr("tessera.functions.ranks.RANGE_ROWS", 100)
    r = np.random.default_rng(8)
    g, x = r.integers(0, 2, 2000), np.where(r.random(2000) < 0.5, 3.0, r.integers(0, 400, 2000) / 2)
    df = spark.createDataFrame([(f"g{a}", float(b)) for a, b in zip(g, x, strict=True)], "g string, x double")
    t = np.unique(x, return_counts=True)[1].astype(float)
    rank = (x[:, None] > x[None]).sum(1) + ((x[:, None] == x[None]).sum(1) + 1) / 2
    n, n1, n2 = 2000, (g == 0).sum(), (g == 1).sum()
    sums = [rank[g == i].sum() for i in (0, 1)]
    h = (12 / (n * (n + 1)) * (sums[0] ** 2 / n1 + sums[1] ** 2 / n2) - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    u = sums[0] - n1 * (n1 + 1) / 2
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    assert relate.kruskal(df, "g", "x").first()["h"] == pytest.approx(h)
    got = relate.mann_whitney(df, "g", "x").first()
    assert got["u"] == u and got["z"] == pytest.approx(z)
    same = relate.kruskal(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, x double"), "g", "x").first()
    assert same["h"] is None and same["degrees"] == 1


def test_ranges_are_dealt_without_holding_rows(spark, monkeypatch):
    """At most 200 ranges (spark.shuffle.sort.bypassMergeThreshold), in both shuffles: for more, a task holds the rows of its whole split."""
    from tessera.functions import ranks

    kept = []
    plain = ranks.written
    monkeypatch.setattr(ranks, "RANGE_ROWS", 20)
    monkeypatch.setattr(ranks, "written", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    got = ranks.ranked_rows(spark.range(6000).select("id", F.when(F.col("id") < 1000, F.lit(7.0)).otherwise(F.col("id") * 1.0).alias("x")), "x")
    assert 100 < kept[0].select("_part").distinct().count() <= 200
    assert got.rdd.getNumPartitions() <= 200
    assert got.where("CASE WHEN id < 1000 THEN rank <> 500.5 OR ties <> 1000 ELSE rank <> id + 1 OR ties <> 1 END").count() == 0
    assert got.agg(F.count("*"), F.count_if("is_first")).first()[:] == (6000, 5001)


@pytest.mark.parametrize("most", [0, 100_000])
def test_few_values_are_counted_before_they_are_ranked(spark, monkeypatch, most):
    """Rank sums come from counts where values are few, from rows where they aren't, and are the same: NaN and zeros of both signs are values."""
    from tessera.operators import relate

    called = []
    monkeypatch.setattr(relate, "COUNTED", most)
    monkeypatch.setattr("tessera.functions.ranks.RANGE_ROWS", 100)
    for name in ("ranked_rows", "ranked_counts"):
        plain = getattr(relate, name)
        monkeypatch.setattr(relate, name, lambda *a, plain=plain, name=name: called.append(name) or plain(*a))
    r = np.random.default_rng(9)
    x, g = r.choice([-1.5, -0.0, 0.0, 2.0, 7.0, math.nan], 1500), r.choice(["a", "b", "c"], 1500)
    g[x == 7.0] = "c"
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, x, strict=True)] + [("a", None), (None, 1.0)], "g string, x double")
    got = relate._rank_sums(df, "g", "x").toPandas().set_index("g")
    assert called == ["ranked_counts" if most else "ranked_rows"]
    v = np.where(np.isnan(x), np.inf, x)
    rank = (v[:, None] > v[None]).sum(1) + ((v[:, None] == v[None]).sum(1) + 1) / 2
    t = np.unique(v + 0.0, return_counts=True)[1].astype(float)
    assert {k: (d["n"], d["rank_sum"]) for k, d in got.iterrows()} == {k: ((g == k).sum(), rank[g == k].sum()) for k in "abc"}
    assert got["ties"].sum() == (t**3 - t).sum()


def test_partial_sums_of_trees_are_few(spark, monkeypatch):
    """What one task reads of a tree doesn't grow with the tasks before."""
    from tessera.functions import grams
    from tessera.operators import forests

    monkeypatch.setattr(grams, "FAN", 2)
    df = spark.createDataFrame(_rows().tolist(), "a double, b double, c double, y double").repartition(12)
    edges = edges_of(df, ["a", "b"])
    rows = forests._sums(df, ["a", "b"], "y", None, edges, 3, 1).toPandas()
    assert len(rows) <= 3 * 2
    n = [sum(np.frombuffer(d, np.float64) for d in own["data"]).reshape(2, -1)[0].sum() for _, own in rows.groupby(rows.columns[0])]
    assert len(n) == 3 and all(abs(v - 3000) < 5 * math.sqrt(3000) for v in n)


@pytest.mark.parametrize("text", [False, True])
def test_tasks_of_a_forest_hold_few_rows(spark, monkeypatch, text):
    """Rows of many columns reach MLlib in tasks of TASK_ROWS, whatever the files hold."""
    monkeypatch.setattr(models, "TASK_ROWS", 50)
    seen, kind = [], "RandomForestClassifier" if text else "RandomForestRegressor"
    fit = getattr(models, kind).fit
    monkeypatch.setattr(getattr(models, kind), "fit", lambda self, df, *a: seen.append(df.rdd.glom().map(len).collect()) or fit(self, df, *a))
    x = np.random.default_rng(2).normal(size=(500, 6))
    df = spark.createDataFrame(np.column_stack([x, x[:, 0]]).tolist(), ", ".join(f"c{i} double" for i in range(6)) + ", y double").coalesce(1)
    df = df.withColumn("y", F.when(F.col("y") > 0, "high").otherwise("low")) if text else df
    got = models.importances(df, [f"c{i}" for i in range(6)], "y", trees=3).count()
    assert got == 6 and sum(seen[0]) == 500 and max(seen[0]) <= 65
