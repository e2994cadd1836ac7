"""The reference's own operators: semantics on small frames, distributions, properties, and all SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from conftest import ROOT, SF
from tessera.functions import distributions as dist
from tessera.functions.ranks import average_ranks, gaps
from tessera.operators import causal, clean, describe, features, models, profile, relate, timeseries, types
from tessera.operators.survival import cox

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def core_queries():
    import importlib

    return {k: (q, getattr(m, "ORACLES", {}).get(k)) for m in (importlib.import_module(f"tessera.jobs.{n}") for n in __spark_entry__.CORE) for k, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [k for k, (_, s) in core_queries().items() if s])
def test_query_equals_sql(spark, db, name):
    query, sql = core_queries()[name]
    df = query(spark, SF)
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_distribution_tails():
    assert abs(dist.chi2_sf(3.841, 1) - 0.05) < 1e-4 and abs(dist.t_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(dist.f_sf(4.103, 2, 10) - 0.05) < 1e-4 and abs(dist.normal_sf(1.959964) - 0.025) < 1e-6
    assert abs(dist.normal_ppf(0.975) - 1.959964) < 1e-5 and dist.chi2_sf(0, 3) == 1 and dist.f_sf(0, 2, 3) == 1


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_profile_edges(spark):
    empty = frame(spark, [], "a double, b string")
    assert profile.missing_summary(empty).count() == 3 and profile.duplicate_rows(empty).first()["n_rows"] == 0
    one = frame(spark, [(1.0, None), (None, None), (1.0, None)], "a double, b string")
    d = profile.duplicate_rows(one).first()
    assert (d["n_rows"], d["duplicates"]) == (3, 1)
    r = {x["column"]: x for x in profile.numeric_describe(one, ["a"]).collect()}["a"]
    assert (r["n"], r["median"], r["outliers"]) == (2, 1.0, 0)
    assert {x["column"]: x["cardinality"] for x in profile.cardinality(one, ["a", "b"]).collect()} == {"a": "constant", "b": "constant"}


def test_types(spark):
    rows = [("1", "31/12/2020", "true", "x"), (" 2 ", "01/02/2020", "false", "x"), ("N/A", "05/06/2021", "true", "x"), ("4", None, None, "x")] * 30
    df = types.normalize_nulls(frame(spark, rows, "n string, d string, b string, c string"))
    assert {r["column"]: r["type"] for r in types.infer_types(df, ["n", "d", "b", "c"]).collect()} == {"n": "numeric", "d": "datetime", "b": "boolean", "c": "categorical"}
    assert dict(types.standardize(df).dtypes) == {"n": "double", "d": "timestamp", "b": "boolean", "c": "string"}
    nothing = frame(spark, [(None,)], "x string")
    assert types.infer_types(nothing, ["x"]).first()["type"] == "categorical"
    assert types.clean_name("  A--b C!") == "a_b_c" and types.clean_names(frame(spark, [(1, 2)], "`A b` int, `a-B` int")).columns == ["a_b", "a_b_2"]


def test_clean(spark):
    df = frame(spark, [(" A ", 1.0), ("NaN", None), (None, 3.0)], "t string, v double")
    assert [r["t"] for r in clean.clean_text(df, ["t"]).collect()] == ["a", "no answer", "no answer"]
    assert [r["v"] for r in clean.fill_median(df, ["v"]).collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        clean.expand_lists(df, "t", limit=1)


def test_ranks_and_gaps_equal_one_window(spark):
    x = np.random.default_rng(0).integers(0, 300, 2000)
    df = frame(spark, [(int(v),) for v in x], "x long").repartition(7)
    order = np.sort(x)
    want = {int(v): float(np.flatnonzero(order == v).mean() + 1) for v in np.unique(x)}
    assert {r["value"]: r["rank"] for r in average_ranks(df, "x").collect()} == want
    times = df.select(F.timestamp_seconds("x").alias("t"))
    found = {r["gap"]: r["n"] for r in gaps(times, "t").collect()}  # each length with how many gaps have it
    steps, n = np.unique(np.diff(order), return_counts=True)
    assert found == dict(zip(steps.tolist(), n.tolist(), strict=True))


def test_significance(spark):
    df = frame(spark, [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "g string, h string")
    r = relate.chi_square(df, "g", "h").first()
    n = np.array([[10, 20], [30, 5]])
    e = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
    assert abs(r["chi2"] - ((np.abs(n - e) - 0.5) ** 2 / e).sum()) < 1e-9 and r["degrees"] == 1 and r["p"] < 0.001
    assert relate.anova(frame(spark, [("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double"), "g", "v").count() == 0


def test_least_squares_equals_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 2))
    y = 1 + x @ [2, -3] + r.normal(size=500)
    df = frame(spark, [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = {v["term"]: v["coefficient"] for v in causal.ols(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.column_stack((np.ones(500), x)), y, rcond=None)[0]
    assert np.allclose([got["const"], got["a"], got["b"]], want)
    v = {k["column"]: k["vif"] for k in relate.vif(df, ["a", "b"]).collect()}
    g = x.T @ x
    assert np.allclose([v["a"], v["b"]], np.diag(g) * np.diag(np.linalg.inv(g)))


def test_planted_effect(spark):
    r = np.random.default_rng(2)
    z = r.normal(size=4000)
    t = (r.uniform(size=4000) < 1 / (1 + np.exp(-z))).astype(int)
    y = 5 * t + 3 * z + r.normal(size=4000)
    df = frame(spark, [(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, z, y, strict=True))], "k long, t int, z double, y double")
    scored = causal.propensity(df, "t", ["z"])
    assert abs(causal.weighted_effect(scored, "t", "y", "score").first()["ate_hajek"] - 5) < 0.5
    pairs = causal.match_nearest(scored.repartition(5), "k", "t", "y", "score")
    assert abs(causal.matched_effect(pairs).first()["att_pairs"] - 5) < 0.5
    s = {r["k"]: (r["t"], r["score"]) for r in scored.collect()}
    controls = np.array([p for a, p in s.values() if a == 0])
    for r in pairs.collect():
        assert abs(abs(r["score"] - r["control_score"]) - np.abs(controls - s[r["key"]][1]).min()) < 1e-12


def test_cox_finds_planted_hazard(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=3000)
    t = r.exponential(1 / np.exp(0.7 * x))
    df = frame(spark, [(float(min(a, 3)), int(a < 3), float(b)) for a, b in zip(t, x, strict=True)], "t double, e int, x double")
    assert abs(cox(df, "t", "e", ["x"]).first()["coefficient"] - 0.7) < 0.08


def test_isolation_flags_planted_outliers(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(950, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(50)]
    got = models.anomalies(frame(spark, rows, "k long, a double, b double"), "k", ["a", "b"]).where("is_anomaly").collect()
    assert len([g for g in got if g["k"] >= 1000]) >= 45


def test_features(spark):
    df = frame(spark, [(1.0, "a"), (2.0, "b"), (None, None), (4.0, "b")], "v double, c string")
    assert [r["c"] for r in features.impute_categories(df, ["c"]).collect()][2] == "b"
    assert features.one_hot(df, "c").columns[-2:] == ["c__a", "c__b"]
    scores = [r["v"] for r in features.scale(df, ["v"], "quantile").collect()]
    assert scores[2] is None and scores[0] < scores[1] < scores[3]
    with pytest.raises(ValueError):
        features.one_hot(df, "c", limit=1)


def test_time_and_charts(spark):
    s = frame(spark, [(i, float(i % 7)) for i in range(9)], "period int, value double")
    assert timeseries.decompose(s).count() == 0  # under ten periods
    flat = frame(spark, [(5.0,)] * 3, "x double")
    h = describe.histogram(flat, "x").orderBy("bin").collect()
    assert len(h) == 20 and sum(r["n"] for r in h) == 3 and h[0]["lo"] == 4.5
    assert describe.histogram(flat.where("x > 9"), "x").count() == 0


ENTRY = "import __spark_entry__ as e; n = set(e.queries()); print(len(n), sum(x.startswith('op') or x == 'pipeline' for x in n), set(e.oracle_sql()) <= n)"


@pytest.mark.parametrize("broken", [False, True])
def test_entry_without_training_data_package(tmp_path, broken):
    """On a copy without the package and the pipeline all other queries register; a package that is there but fails is an error."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "corpus_pipeline.py").write_text("import a_wheel_that_is_missing")
    got = subprocess.run([sys.executable, "-c", ENTRY], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    if broken:
        assert got.returncode and "a_wheel_that_is_missing" in got.stderr
    else:
        assert got.stdout.split() == [str(len(core_queries())), "0", "True"], got.stderr


@pytest.mark.parametrize("rows", [[], [("a", "x", 1.0, 2.0)], [("a", "x", 1.0, 1.0)] * 2, [("a", "x", 1.0, 1.0), ("b", "x", 1.0, 1.0)] * 3])
def test_no_division_by_zero(spark, rows):
    """Empty, one-row, constant, tied and one-level frames have defined results."""
    from tessera.operators import causal, profile, roles

    df = frame(spark, rows, "g string, h string, v double, w double")
    for out in (
        relate.chi_square(df, "g", "h"),
        relate.anova(df, "g", "v"),
        relate.category_impact(df, "g", ["v", "w"]),
        profile.numeric_advanced(df, ["v", "w"]),
        causal.instrument_effect(df, "v", "w", "v"),
        causal.business_effect(df, "v", "w"),
        roles.outcome_scores(df, ["v", "w"]),
        roles.treatment_scores(df, ["g", "h"], "v"),
        roles.group_scores(df, ["g", "h"], "v"),
        roles.id_scores(df, ["g", "v"]),
        roles.time_scores(df),
        roles.auto_config(df),
    ):
        out.collect()


def test_types_of_times(spark):
    from tessera.operators import types

    texts = ["2020-01-01 03:04:05", "2020-01-01T03:04:05", "2020/01/02", "2020-01-01T03:04", "31.12.2020 23:59", "2020-01-01T03:04:05+02:00", "2020-01-01 03:04:05.250"]
    df = frame(spark, [(x,) for x in texts] + [(None,)], "t string")
    assert types.infer_types(df, ["t"]).first()["type"] == "datetime"
    assert [str(r["t"]) for r in types.standardize(df).collect()][:3] == ["2020-01-01 03:04:05", "2020-01-01 03:04:05", "2020-01-02 00:00:00"]


def test_auto_config(spark):
    r = np.random.default_rng(1)
    rows = [(i, "yes" if i % 2 else "no", ["red", "green", "blue"][i % 3], float((i % 2) * 5 + r.normal()), float(i % 7)) for i in range(200)]
    from tessera.operators import roles

    got = {(x["role"], x["column"]) for x in roles.auto_config(frame(spark, rows, "id long, paid string, color string, spend double, week double")).collect()}
    assert {("treatment", "paid"), ("group", "color"), ("user", "id"), ("event", "paid")} <= got
