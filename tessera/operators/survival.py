"""Cox proportional hazards by Newton steps on sums by distinct time."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import q
from tessera.functions.ranks import ranged, running


def cox(df: DataFrame, duration: str, event: str, covariates: list[str], steps: int = 20) -> DataFrame:
    """Coefficients and errors (Breslow ties).

    Rows are dealt by ranges of time once.  A step sums exp(bx), x exp(bx) and xx' exp(bx) by distinct time, runs
    backwards within and across the ranges for the risk sets, and brings k + k * k sums to the driver.
    """
    whole = df.dropna(subset=[duration, event, *covariates])
    means = whole.agg(*[F.avg(q(c)) for c in covariates]).first()
    k = len(covariates)
    x = [q(c).cast("double") - F.lit(m) for c, m in zip(covariates, means, strict=True)]
    rows = whole.select(q(duration).cast("double").alias("t"), q(event).cast("int").alias("d"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if means[0] is None:
        return df.sparkSession.createDataFrame([], "term string, coefficient double, se double")
    rows = ranged(rows, "t")  # equal times share a part
    b, info = np.zeros(k), np.eye(k)
    for _ in range(steps):
        w = F.exp(reduce(lambda a, c: a + c, [F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(b)]))
        by = rows.groupBy("part", "t").agg(
            F.sum("d").alias("d"),
            F.sum(w).alias("s0"),
            *[F.sum(w * F.col(f"x{i}")).alias(f"s1_{i}") for i in range(k)],
            *[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s2_{i}_{j}") for i, j in pairs],
            *[F.sum(F.col("d") * F.col(f"x{i}")).alias(f"e{i}") for i in range(k)],
        )
        names = ["s0", *[f"s1_{i}" for i in range(k)], *[f"s2_{i}_{j}" for i, j in pairs]]
        risk = running(by, "t", {f"r_{n}": n for n in names}, descending=True)
        row = risk.agg(
            *[F.sum(F.col(f"e{i}") - F.col("d") * F.col(f"r_s1_{i}") / F.col("r_s0")) for i in range(k)],
            *[F.sum(F.col("d") * (F.col(f"r_s2_{i}_{j}") / F.col("r_s0") - F.col(f"r_s1_{i}") * F.col(f"r_s1_{j}") / F.col("r_s0") ** 2)) for i, j in pairs],
        ).first()
        gradient = np.array([v or 0.0 for v in row[:k]])
        for (i, j), v in zip(pairs, row[k:], strict=True):
            info[i, j] = info[j, i] = v or 0.0
        step = np.linalg.pinv(info) @ gradient
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0))
    return df.sparkSession.createDataFrame([(c, float(v), float(s)) for c, v, s in zip(covariates, b, se, strict=True)], "term string, coefficient double, se double")
