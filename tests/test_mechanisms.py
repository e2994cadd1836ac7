"""What large tables need: dates of any export, wide and skewed tables, large groups, many asked rows, arrays of records; each against a plain version."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import grams
from tessera.functions.frequencies import most_frequent, smallest_values, value_numbers
from tessera.functions.ranks import blocked, ranked_rows
from tessera.functions.selection import group_quantiles
from tessera.operators import causal, dates, models, profile, relate, timeseries, types
from tessera.sources import json_column, read_json, records
from tessera.sources.json_arrays import record_texts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DATES = {
    "12/31/2020": "2020-12-31 00:00:00", "1/2/2020": "2020-02-01 00:00:00", "31/12/2020": "2020-12-31 00:00:00", "2020-1-5": "2020-01-05 00:00:00", "2020-01-01 03:04:05+00:00": "2020-01-01 03:04:05",
    "2020-01-01T03:04:05+0000": "2020-01-01 03:04:05", "2020-01-01 03:04:05 UTC": "2020-01-01 03:04:05", "2020-01-01T03:04:05.250+02:00": "2020-01-01 01:04:05.250000", "Jan 5, 2020": "2020-01-05 00:00:00",
    "5 January 2020": "2020-01-05 00:00:00", "01/02/2020 3:04 PM": "2020-02-01 15:04:00", "12/31/20 12:04 am": "2020-12-31 00:04:00", "Wed Aug 27 13:08:45 +0000 2008": "2008-08-27 13:08:45", "Mon, 5 Jan 2020 10:00:00 GMT": "2020-01-05 10:00:00",
    "Sept 3rd 2021": "2021-09-03 00:00:00", "Jan 2020": "2020-01-01 00:00:00", "2020-01": "2020-01-01 00:00:00", "20200105T030405Z": "2020-01-05 03:04:05", "2020-Jan-05": "2020-01-05 00:00:00", "5th of March, 2021 at 7:05 p.m.": "2021-03-05 19:05:00",
    "2020/1/5 10:00 -0530": "2020-01-05 15:30:00", "31.12.69": "1969-12-31 00:00:00", "29/2/2019": None, "13/13/2020": None, "2020": None, "12.5": None, "-3": None, "hello": None, "2020-02-30": None, "10:30": None, "2020-01-05 25:00": None,
    "01/02/2020 13:04 PM": None, "2020-01-01 03:04:05+99:00": None, "marble 5 2020": None, "": None, "x" * 1000: None, "1.2.3.4": None, "2020-01-05 junk": None,
}


def test_dates_of_any_shape(spark):
    rows = [(k,) for k in DATES] + [(None,)]
    got = {r["v"]: None if r["d"] is None else str(r["d"]) for r in frame(spark, rows, "v string").select("v", dates.as_date(F.col("v")).alias("d")).collect()}
    assert got == DATES | {None: None}


def test_order_of_day_and_month_is_the_columns_own(spark):
    rows = [(f"{m}/{d}/2020", f"{d}/{m}/2020", f"{m}/{m}/2020", "-") for m in (1, 5, 12) for d in (2, 11, 28)] + [(None, "no date", None, None)]
    df = frame(spark, rows, "us string, eu string, either string, none string")
    found = {r["column"]: r for r in dates.orders(dates.shapes(df, df.columns)).collect()}
    assert found["us"]["month_first"] and not found["eu"]["month_first"] and not found["either"]["month_first"]
    assert found["us"]["month_over"] == 3 and found["us"]["day_over"] == 0 and found["eu"]["dates"] == 9 and found["none"]["dates"] == 0
    s = types.standardize(df).collect()
    assert [(r["us"].month, r["us"].day) for r in s[:9]] == [(r["eu"].month, r["eu"].day) for r in s[:9]] == [(m, d) for m in (1, 5, 12) for d in (2, 11, 28)]
    assert types.standardize(df.where("us IS NULL AND eu IS NULL")).count() == 0
    kinds = {r["column"]: (r["kind"], r["first_day"], r["last_day"]) for r in types.understand(df, ["us"]).collect()}
    assert kinds["us"][0] == "datetime" and str(kinds["us"][1]) == "2020-01-02" and str(kinds["us"][2]) == "2020-12-28"


def wide(spark, k=30, n=500, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k)) @ r.normal(size=(k, k)) + 1e6
    x[:, 3] = 7.0
    x[r.random((n, k)) < 0.1] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    rows[0] = (float("inf"), *rows[0][1:])
    x[0, 0] = np.nan
    return x, frame(spark, rows, ", ".join(f"c{i} double" for i in range(k)))


def test_correlations_of_wide_tables(spark):
    x, df = wide(spark)
    got = {(r["a"], r["b"]): r["r"] for r in relate.correlations(df, df.columns).collect()}
    for i in range(30):
        for j in range(i + 1, 30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if 3 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert (got[f"c{i}", f"c{j}"] is None) == (want is None) and (want is None or abs(got[f"c{i}", f"c{j}"] - want) < 1e-9)
    assert {r["r"] for r in relate.correlations(df.limit(0), df.columns).collect()} == {None}
    assert {r["r"] for r in relate.correlations(df.limit(1), df.columns).collect()} == {None}


def test_products_of_wide_tables_equal_narrow_ones(spark):
    x, df = wide(spark, n=400)
    columns = [c for c in df.columns if c != "c3"][:14]
    whole = x[:, [int(c[1:]) for c in columns]]
    whole = whole[~np.isnan(whole).any(1)]
    n, means, m = relate.gram(df, columns)
    assert n == len(whole) and np.allclose(means, whole.mean(0)) and np.allclose(m, (whole - whole.mean(0)).T @ (whole - whole.mean(0)))
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    folds = relate.fold_grams(keyed, "k", columns, 3)
    assert sum(f[0] for f in folds) == n and np.allclose(sum(f[2] for f in folds), m)
    assert relate.gram(df.limit(0), columns)[0] == 0


def test_two_hundred_columns_are_one_small_plan(spark):
    """Constant plan: the job of 200 columns has one node more for none of them."""
    r = np.random.default_rng(2)
    df = spark.createDataFrame(r.normal(size=(300, 200)).tolist(), ", ".join(f"c{i} double" for i in range(200)))
    m = grams.correlation_matrix(df, df.columns)
    assert np.allclose(m, np.corrcoef(np.array(df.collect()).T))


@pytest.mark.parametrize("most", [10, 100, 10**6])
def test_group_quantiles(spark, most):
    r = np.random.default_rng(4)
    values = {"big": r.normal(size=3000).tolist(), "tied": [1.0] * 900 + [2.0] * 900 + r.random(20).tolist(), "small": [3.0, 1.0], "one": [5.0], None: [float(i) for i in range(50)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("small", None), ("small", float("nan")), ("empty", None)]
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r["g"]: r for r in group_quantiles(frame(spark, rows, "g string, v double"), ["g"], "v", probs, most=most).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k]["n"] == len(vs) and np.allclose(got[k]["quantiles"], np.quantile(vs, probs))
    assert group_quantiles(frame(spark, [], "g string, v double"), ["g"], "v", probs).count() == 0


def test_frequencies_of_long_texts(spark):
    long = ["a" * 64 + t for t in ("x", "y", "z")] + ["b" * 500]
    rows = [(long[0],)] * 3 + [(long[1],)] * 3 + [(long[2],)] * 2 + [(long[3],)] * 3 + [("short",)] * 3 + [("other",)] + [(None,)]
    df = frame(spark, rows, "t string")
    got = [(r["rank"], r["value"], r["n"], r["total"]) for r in most_frequent(df, ["t"], 3).orderBy("rank").collect()]
    assert got == [(1, long[0], 3, 15), (2, long[1], 3, 15), (3, long[3], 3, 15)]
    assert [(r["n_rows"], r["n_unique"]) for r in value_numbers(df, ["t"]).collect()] == [(16, 6)]
    assert smallest_values(df, ["t"], 3).first()["smallest"] == sorted({t for (t,) in rows if t})[:3]
    assert profile.top_values(df.limit(0), ["t"]).count() == 0 and value_numbers(df.limit(0), ["t"]).first()["n_unique"] == 0
    plan = most_frequent(df, ["t"], 3)._jdf.queryExecution().toString()
    assert "candidates" in plan  # texts of candidates alone are read


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("caliper", [None, 0.01])
def test_nearest_controls(spark, k, caliper):
    r = np.random.default_rng(k)
    rows = [(i, int(r.random() < 0.4), float(r.normal()), round(float(r.random()), 2 if i % 2 else 6)) for i in range(500)]
    rows += [(1000 + i, 0, 1.0, 0.5) for i in range(80)] + [(2000, None, 1.0, 0.5), (2001, 1, None, None), (2002, 1, 2.0, 5.0)]
    df = frame(spark, rows, "key long, t int, y double, p double")
    controls = [(p, i) for i, t, _, p in rows if t == 0]
    want = {}
    for i, t, _, p in rows:
        if t == 1 and p is not None:
            best = sorted((abs(p - c), c, j) for c, j in controls)[:k]
            want |= {(i, n + 1): (j, c) for n, (d, c, j) in enumerate(best) if caliper is None or d <= caliper}
    found = causal.match_controls(df, "key", "t", "y", "p", k, caliper)
    assert {(r["key"], r["rank"]): (r["control_key"], r["control_score"]) for r in found.collect()} == want
    few = causal.match_controls(df.where("key IN (0, 1, 2, 3, 4, 5)"), "key", "t", "y", "p", 50)
    assert few.count() == sum(1 for i, t, *_ in rows[:6] if t == 1) * sum(1 for i, t, *_ in rows[:6] if t == 0)
    assert causal.match_controls(df.where("t = 1"), "key", "t", "y", "p", k).count() == 0


def test_nearest_rows_by_cells(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(400, 3)), r.normal(size=(200, 3)) * 1e-3 + 4, np.repeat(r.normal(size=(4, 3)), 30, axis=0)])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(5000, None, None, None)]
    df = frame(spark, rows, "k long, a double, b double, c double")
    got = {r["asked_key"]: (r["nearest_key"], r["distance"]) for r in models.nearest_rows(df, "k", ["a", "b", "c"], "a", 0.1, df.select("k")).collect()}
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    for i in range(len(x)):
        moved = (x[i] * [1.1, 1, 1] - mean) / sd
        d = np.sqrt(((z - moved) ** 2).sum(1))
        d[i] = np.inf
        assert abs(got[i][1] - d.min()) < 1e-9 and abs(d[got[i][0]] - d.min()) < 1e-9
    assert len(got) == len(x)


def test_ranks_in_place(spark):
    r = np.random.default_rng(3)
    values = [1.0] * 600 + [2.0] * 10 + r.normal(size=300).round(2).tolist() + [None]
    df = frame(spark, [(i, v) for i, v in enumerate(values)], "i long, x double").repartition(5)
    got = {r["i"]: r for r in ranked_rows(df, "x").collect()}
    real = sorted(v for v in values if v is not None)
    for i, v in enumerate(values[:-1]):
        at = [k + 1 for k, w in enumerate(real) if w == v]
        assert got[i]["rank"] == sum(at) / len(at) and got[i]["ties"] == len(at)
    assert sum(r["is_first"] for r in got.values()) == len(set(real)) and len(got) == len(real)
    assert ranked_rows(df.where("x IS NULL"), "x").count() == 0


def test_one_value_of_half_the_rows_splits(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"))
    sizes = [r["count"] for r in df.repartitionByRange(8, "x", F.rand(17)).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 20_000 / 8
    assert ranked_rows(df, "x").where("ties > 1").agg(F.min("rank"), F.max("rank"), F.count("*")).first()[2] == 10_001


def test_bootstrap_by_matrices_equals_rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 2)) @ np.array([[1, 0.4], [0, 1]])
    df = frame(spark, [(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double")
    hashes = np.array([r[0] for r in df.orderBy("k").select(F.xxhash64("k")).collect()])
    w = grams.replicate_weights(hashes, 200)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    sums = grams.replicate_sums(df, F.xxhash64("k"), ["a", "b"], [(0, 1)], 200)
    assert np.allclose(sums, w.T @ np.column_stack([np.ones(200), x, x[:, 0] * x[:, 1]]))
    got = causal.sign_stability(df, "k", ["a", "b"], 200, least=0.0).first()
    signs = [np.sign(np.cov(x.T, aweights=w[:, j] + 1e-300)[0, 1]) == np.sign(got["r"]) for j in range(200)]
    assert abs(got["stability"] - np.mean(signs)) < 1e-9
    assert causal.sign_stability(df.limit(0), "k", ["a", "b"]).count() == 0


def test_series_in_blocks(spark):
    import datetime

    r = np.random.default_rng(6)
    v = r.normal(size=500)
    df = frame(spark, [(datetime.date(2000, 1, 1) + datetime.timedelta(days=2 * i), float(x)) for i, x in enumerate(v)], "period date, value double").repartition(6)
    b = blocked(df, "period", 3, rows=16)
    assert b.where("is_own").count() == 500 and b.groupBy("block").count().agg(F.max("count")).first()[0] <= 22
    assert sorted(r["pos"] for r in b.where("is_own").collect()) == list(range(500))
    out = {r["period"]: r for r in timeseries.decompose(df).collect()}
    days = sorted(out)
    assert all((out[d]["trend"] is None) == (i < 3 or i > 496) for i, d in enumerate(days))
    assert np.allclose([out[d]["trend"] for d in days[3:-3]], np.convolve(v, np.ones(7) / 7, "valid"))
    assert timeseries.decompose(df.limit(5)).count() == 0


def test_arrays_of_records(spark, tmp_path):
    random.seed(1)
    rows = [{"id": i, "s": random.choice(["a}b", 'q"x', '\\"', "back\\", "é{[", "line\nend", ""]) * random.randint(0, 5), "n": {"x": [{"y": i}], "z": None}} for i in range(300)]
    rows[150]["s"] = 'long } { \\" ' * 2000
    files = {"pretty": json.dumps(rows, indent=2), "dense": json.dumps(rows, ensure_ascii=False), "one": json.dumps(rows[7]), "empty": "[]", "odd": '\n[1, "x", {"id": 5}, [{"id": 6}] ]\n', "nothing": "", "bom": "﻿" + json.dumps(rows[:5], ensure_ascii=False)}
    want = {"pretty": rows, "dense": rows, "one": [rows[7]], "empty": [], "odd": [{"id": 5}], "nothing": [], "bom": rows[:5]}
    for k, text in files.items():
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "5k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            for k in files:
                got = [json.loads(r["value"]) for r in record_texts(spark, f"file://{tmp_path}/{k}.json").orderBy("start", "place").collect()]
                assert sorted(map(str, got)) == sorted(map(str, want[k])), (size, k)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    flat = read_json(spark, f"file://{tmp_path}/pretty.json")
    assert set(flat.columns) == {"id", "s", "n.x", "n.z"} and flat.agg(F.sum("id")).first()[0] == sum(range(300))
    assert read_json(spark, f"file://{tmp_path}/one.json").count() == 1


def test_posted_records(spark):
    got = records(spark, [{"b": 1, "a": math.inf, "n": {"x": 1.5, "y": [math.nan, 2]}}, {"a": 2.0, "c": 'z\n"}'}])
    assert got.columns == ["b", "a", "n.x", "n.y", "c"]
    assert [tuple(r) for r in got.collect()] == [(1, None, 1.5, [None, 2], None), (None, 2.0, None, None, 'z\n"}')]
    assert records(spark, []).count() == 0
    parsed = json_column(frame(spark, [('{"k": {"v": 1}}',), ("broken",), (None,)], "j string"), "j", "k struct<v: long>")
    assert parsed.columns == ["j.k.v"] and [r[0] for r in parsed.collect()] == [1, None, None]


@pytest.mark.parametrize("rows", [[], [(1, 1.0, 2.0, "a")], [(1, 1.0, 2.0, "a")] * 3])
def test_models_of_small_frames(spark, rows):
    """Empty, one-row and constant frames have defined results."""
    from tessera.operators import features

    df = frame(spark, rows, "k long, a double, b double, g string")
    n = len(rows)
    assert causal.model_effects(df, ["a"], "b").count() == (10 if n > 1 else 0)
    assert models.importances(df, ["a"], "b").count() == (1 if n > 1 else 0)
    rows_, summary = models.cluster(df, ["a", "b"], k=2)
    assert rows_.count() == summary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == (n if n > 1 else 0)
    assert features.principal_components(df, ["a", "b"]).count() == (4 if n > 1 else 0)
    for target in ("b", "g"):
        assert models.compare_models(df, "k", ["a"], target).count() == 0
    assert models.tuned(df, "k", ["a"], "b", "tree", {"maxDepth": [2]}).count() == 0
    assert models.cluster_candidates(df, ["a", "b"], (5,)).count() == 0
    assert models.split(df, "k", 0.2, "g").count() == n
    assert models.nearest_rows(df, "k", ["a"], "a", 0.1, df.select("k")).count() == 0
    assert relate.chi_squares(df, [("g", "a")]).count() == 0 and relate.anovas(df, ["g"], ["a"]).where("f IS NOT NULL").count() == 0


def test_exact_shares_of_classes(spark):
    sizes = {"a": 1000, "b": 7, "c": 1, "d": 2, None: 13}
    rows = [(i, g) for g, n in sizes.items() for i in range(n)]
    df = models.split(frame(spark, [(i, *r) for i, r in enumerate(rows)], "k long, i long, g string"), "k", 0.2, "g")
    got = {r["g"]: (r["n"], r["v"]) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.count_if("is_validation").alias("v")).collect()}
    assert got == {g: (n, math.floor(n * 0.2 + 0.5) if n > 1 else 0) for g, n in sizes.items()}


def test_candidates_of_two_and_more_classes(spark):
    r = np.random.default_rng(8)
    rows = [(i, float(x), float(r.normal()), "yes" if x > 0 else "no", "abc"[i % 3]) for i, x in enumerate(r.normal(size=300))]
    df = frame(spark, rows, "k long, x double, z double, two string, three string")
    two = {r["model"]: r["value"] for r in models.compare_models(df, "k", ["x", "z"], "two").collect()}
    assert set(two) == set(models.CLASSIFIERS) and min(two["tree"], two["logistic"], two["boosting"]) > 0.9
    three = {r["model"] for r in models.compare_models(df, "k", ["x", "z"], "three").collect()}
    assert three == set(models.CLASSIFIERS) - models.TWO_CLASSES
    grid = models.tuned(df, "k", ["x", "z"], "two", "tree", {"maxDepth": [1, 3]}).collect()
    assert len(grid) == 2 and grid[0]["value"] >= grid[1]["value"]
    sizes = models.cluster_candidates(df, ["x", "z"], (2, 3)).collect()
    assert {s["k"] for s in sizes} == {2, 3} and sizes[0]["silhouette"] >= sizes[1]["silhouette"]


def test_all_pairs_at_once_equal_one_by_one(spark):
    r = np.random.default_rng(9)
    rows = [(["x", "y", None][int(r.integers(0, 3))], int(r.integers(0, 4)), bool(r.random() < 0.3), None if r.random() < 0.1 else float(r.normal())) for _ in range(400)]
    df = frame(spark, rows, "a string, b int, c boolean, v double")
    for x in relate.chi_squares(df, [("a", "b"), ("a", "c"), ("b", "c")]).collect():
        i, j = ("a", "b", "c").index(x["first"]), ("a", "b", "c").index(x["second"])
        own = [(t[i], t[j]) for t in rows if t[i] is not None and t[j] is not None]
        left, right = sorted({p for p, _ in own}), sorted({p for _, p in own})
        o = np.array([[own.count((p, w)) for w in right] for p in left], float)
        e = np.outer(o.sum(1), o.sum(0)) / o.sum()
        d = np.abs(o - e) - (np.minimum(0.5, np.abs(o - e)) if o.shape == (2, 2) else 0)
        assert abs(x["chi2"] - (d**2 / e).sum()) < 1e-8 and x["degrees"] == (o.shape[0] - 1) * (o.shape[1] - 1)
    for x in relate.anovas(df, ["a", "b"], ["v"]).collect():
        groups = [[t[3] for t in rows if t["ab".index(x["category"])] == g and t[3] is not None] for g in {t["ab".index(x["category"])] for t in rows} - {None}]
        every = np.concatenate(groups)
        ssb, ssw = sum(len(g) * (np.mean(g) - every.mean()) ** 2 for g in groups), sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)
        assert abs(x["f"] - (ssb / (len(groups) - 1)) / (ssw / (len(rows) - len(groups)))) < 1e-8
