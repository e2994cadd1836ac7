"""Forests of tables of any length, by cells: trees see rows through the bins of their features, so sums by cell say all that a split asks.

One pass gives every row its bootstrap count for every tree and adds counts and targets by cell (one bin of each feature); a tree then
grows from the sums of its cells.  Nothing that is kept or moved grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import q
from tessera.functions.grams import POISSON, fewer

#: Bins of a feature, quantiles among which distinct values are sought, and cells times classes that a task holds for each tree.
BINS, GRID, CELLS = 32, 1024, 1 << 16


def edges_of(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """The upper edges of each column's bins but the last: its values, if few, else quantiles."""
    row = df.agg(*[F.percentile_approx(q(c).cast("double"), [i / GRID for i in range(GRID + 1)], 10_000) for c in columns]).first()
    out = []
    for grid in row:
        values = np.unique(np.array(grid or [], dtype=float))
        chosen = values if len(values) <= BINS else np.unique(np.array(grid)[[i * GRID // BINS for i in range(1, BINS)]])
        out.append(chosen[:-1] if len(values) <= BINS else chosen[chosen < values[-1]])
    return out


def n_cells(edges: list[np.ndarray]) -> int:
    return math.prod(len(e) + 1 for e in edges)


def cell_of(x: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """The cell of each row: its bins as the digits of one number."""
    cell = np.zeros(len(x[0]), np.int64)
    for v, e in zip(x, edges, strict=True):
        cell = cell * (len(e) + 1) + np.searchsorted(e, v)
    return cell


def _sums(df: DataFrame, columns: list[str], target: str, levels: list | None, edges: list[np.ndarray], trees: int, seed: int) -> DataFrame:
    """(key, data): bootstrap counts by class and cell, or counts and sums of the target by cell, in a few partial sums of each tree (the key)."""
    cells, k = n_cells(edges), len(columns)
    classes = len(levels) if levels else 0
    y = F.array_position(F.array(*[F.lit(v) for v in levels]), q(target)) - 1 if levels else q(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = np.zeros((trees, classes or 2, cells))
        for b in batches:
            x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]
            v = b.column(k).to_numpy(zero_copy_only=False)
            cell = cell_of(x, edges)
            if classes:
                cell = v.astype(np.int64) * cells + cell
            for t in range(trees):
                w = POISSON[rng.integers(0, 1 << 16, len(v), dtype=np.uint16)]
                if classes:
                    total[t] += np.bincount(cell, w, classes * cells).reshape(classes, cells)
                else:
                    total[t, 0] += np.bincount(cell, w, cells)
                    total[t, 1] += np.bincount(cell, w * v, cells)
        for t in range(trees):
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([total[t].tobytes()], pa.binary())], names=["key", "data"])

    rows = df.select(*[q(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], y.cast("double").alias("_y"))
    return fewer(rows.mapInArrow(run, "key long, data binary"))


def tree_gains(n: np.ndarray, s: np.ndarray, bins: np.ndarray, counts: list[int], tried: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """What each feature's splits take off the impurity (times the weight) in one tree, as shares."""
    return grown(n, s, bins, counts, tried, depth, rng)[0]


def grown(n: np.ndarray, s: np.ndarray, bins: np.ndarray, counts: list[int], tried: int, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The shares of ``tree_gains``, and what the tree says of each cell (the mean of its leaf), cells without rows included.

    Cells have a weight ``n``, sums ``s`` (of the target: variance; of each class: Gini) and bins.  Each node tries ``tried`` features.
    """
    gains, told = np.zeros(len(counts)), np.zeros(s.shape)
    usable = [f for f, c in enumerate(counts) if c > 1]
    open_ = [(np.arange(len(n)), depth)]
    while open_:
        at, left = open_.pop()
        all_n, all_s = n[at].sum(), s[:, at].sum(1)
        told[:, at] = (all_s / all_n if all_n else all_s)[:, None]
        if left == 0 or (n[at] > 0).sum() < 2:
            continue
        least = 1e-12 * (s[:, at] ** 2 / np.maximum(n[at], 1e-300)).sum()
        best = (least, -1, -1)
        for f in rng.permutation(len(counts))[:tried]:
            if f not in usable:
                continue
            b = bins[f][at]
            low_n = np.bincount(b, n[at], counts[f]).cumsum()[:-1]
            low_s = np.stack([np.bincount(b, r[at], counts[f]).cumsum()[:-1] for r in s])
            ok = np.flatnonzero((low_n > 0) & (low_n < all_n))
            if len(ok):
                gain = (low_s[:, ok] ** 2).sum(0) / low_n[ok] + ((all_s[:, None] - low_s[:, ok]) ** 2).sum(0) / (all_n - low_n[ok]) - (all_s**2).sum() / all_n
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), int(ok[i]))
        if best[1] >= 0:
            gains[best[1]] += best[0]
            low = bins[best[1]][at] <= best[2]
            open_ += [(at[low], left - 1), (at[~low], left - 1)]
    return gains / (gains.sum() or 1.0), told


def forest_shares(df: DataFrame, columns: list[str], target: str, levels: list | None, edges: list[np.ndarray], trees: int, depth: int, seed: int) -> np.ndarray:
    """The importance of each column in a forest on complete rows, as MLlib defines it: a third (classes: the root) of the features a node."""
    cells, counts, k = n_cells(edges), [len(e) + 1 for e in edges], len(columns)
    tried = math.ceil(math.sqrt(k)) if levels else math.ceil(k / 3)
    tried = k if trees == 1 else tried
    centre = None if levels else (df.agg(F.avg(q(target).cast("double"))).first()[0] or 0.0)
    if centre is not None:
        df = df.withColumn(target, q(target).cast("double") - F.lit(centre))  # large means cost no digits

    def grow(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.float64) for d in parts["data"]).reshape(-1, cells)
        n, s = (total.sum(0), total) if levels else (total[0], total[1:])
        bins = np.array(np.unravel_index(np.arange(cells), counts))
        return pd.DataFrame({"gains": [tree_gains(n, s, bins, counts, tried, depth, np.random.default_rng([seed, int(key[0])]))]})

    rows = _sums(df, columns, target, levels, edges, trees, seed).groupBy("key").applyInPandas(grow, "gains array<double>").toPandas()
    total = np.sum(np.stack(rows["gains"]), axis=0)
    return total / (total.sum() or 1.0)


def forest_values(df: DataFrame, columns: list[str], target: str, edges: list[np.ndarray], trees: int, depth: int, seed: int) -> np.ndarray:
    """What a forest on complete rows says of each cell: the mean of its trees."""
    cells, counts, k = n_cells(edges), [len(e) + 1 for e in edges], len(columns)
    centre = df.agg(F.avg(q(target).cast("double"))).first()[0] or 0.0

    def grow(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        n, total = sum(np.frombuffer(d, np.float64) for d in parts["data"]).reshape(2, cells)
        bins = np.array(np.unravel_index(np.arange(cells), counts))
        return pd.DataFrame({"told": [grown(n, total[None], bins, counts, math.ceil(k / 3), depth, np.random.default_rng([seed, int(key[0])]))[1][0]]})

    less = df.withColumn(target, q(target).cast("double") - F.lit(centre))
    rows = _sums(less, columns, target, None, edges, trees, seed).groupBy("key").applyInPandas(grow, "told array<double>").toPandas()
    return np.mean(np.stack(rows["told"]), axis=0) + centre
