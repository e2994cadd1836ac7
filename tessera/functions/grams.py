"""Products of many columns at once: partial matrices of every task, added by a tree.

The plan has one node whatever the columns: Arrow batches become matrices, a task keeps one partial sum, and partials are cut into
blocks of rows that are added in two steps.  Only the k x k sums reach the driver.  A column less its mean is multiplied, so
large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import q

#: Rows of a block of a matrix, and tasks among which the first sums of a block are dealt.
ROWS, FAN = 64, 32


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """The first columns as doubles; null and infinite values are NaN."""
    x = np.empty((batch.num_rows, columns))
    for i in range(columns):
        x[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
    x[~np.isfinite(x)] = np.nan
    return x


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(data.as_buffer(), np.float64)
            held[key] = held[key] + x if key in held else x.copy()
    for key, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["key", "data"])


def fewer(parts: DataFrame) -> DataFrame:
    """(key, data) with the arrays of doubles of a key added where they meet: FAN partial sums of each key at most, whatever the tasks before."""
    return parts.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(FAN))).repartition("key", "turn").select("key", "data").mapInArrow(_add, "key long, data binary")


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """key -> sum of its arrays of doubles."""
    table = fewer(parts).repartition("key").mapInArrow(_add, "key long, data binary").toArrow()
    return {k: np.frombuffer(d, np.float64) for k, d in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)}


def _doubles(df: DataFrame, columns: list[str], *others: Column) -> DataFrame:
    return df.select(*[q(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], *others)


def means(df: DataFrame, columns: list[str], complete: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Counts and means of finite values; of rows without a missing one, if ``complete``."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k))
        for b in batches:
            x = _matrix(b, k)
            if complete:
                x = x[~np.isnan(x).any(1)]
            total += np.stack([(~np.isnan(x)).sum(0), np.nansum(x, 0)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["key", "data"])

    n, s = _added(_doubles(df, columns).mapInArrow(run, "key long, data binary")).get(0, np.zeros(2 * k)).reshape(2, k)
    return n, s / np.maximum(n, 1)


def pairwise(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """n, sums (of the row's column), products and squares (of the row's column) over the rows where both columns of a pair have a value.

    Values are less the column's mean.  Each is a k x k matrix.
    """
    k = len(columns)
    shift = means(df, columns)[1]
    blocks = -(-k // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            x = _matrix(b, k) - shift
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x)
            total += np.stack([there.T @ there, x.T @ there, x.T @ x, (x * x).T @ there])
        data = [np.ascontiguousarray(total[:, i * ROWS : (i + 1) * ROWS]).tobytes() for i in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int64()), pa.array(data, pa.binary())], names=["key", "data"])

    found = _added(_doubles(df, columns).mapInArrow(run, "key long, data binary"))
    full = np.concatenate([found[i].reshape(4, -1, k) for i in range(blocks)], axis=1) if found else np.zeros((4, k, k))
    return dict(zip(("n", "sums", "products", "squares"), full, strict=True))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson's r of each pair of columns over the rows where both have a value; NaN where one of the two doesn't vary there."""
    m = pairwise(df, columns)
    n = np.maximum(m["n"], 1)
    spread = m["squares"] - m["sums"] ** 2 / n
    spread[spread <= 1e-12 * m["squares"]] = 0  # what rounding leaves of a column without spread
    r = np.full(spread.shape, np.nan)
    both = np.sqrt(spread * spread.T)
    np.divide(m["products"] - m["sums"] * m["sums"].T / n, both, out=r, where=both > 0)
    return np.clip(r, -1, 1)


def products(df: DataFrame, columns: list[str], fold: Column | None) -> tuple[int, np.ndarray, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """Of the rows where all columns have a value: n, means, and for each fold n, sums and products of columns less their means over all rows."""
    k = len(columns)
    counts, shift = means(df, columns, complete=True)
    n = int(counts[0]) if k else 0
    if not n:
        return 0, np.zeros(k), {}
    blocks = -(-(k + 1) // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = _matrix(b, k) - shift
            whole = ~np.isnan(x).any(1)
            x = np.column_stack([x[whole], np.ones(whole.sum())])  # the last row and column are sums and the count
            of = b.column(k).to_numpy()[whole]
            for f in np.unique(of):
                own = x[of == f]
                total[int(f)] = total.get(int(f), 0) + own.T @ own
        keys = [f * blocks + i for f in total for i in range(blocks)]
        data = [np.ascontiguousarray(total[f][i * ROWS : (i + 1) * ROWS]).tobytes() for f in total for i in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["key", "data"])

    rows = _doubles(df, columns, (F.lit(0) if fold is None else fold).cast("int").alias("_fold"))
    found = _added(rows.mapInArrow(run, "key long, data binary"))
    out = {}
    for f in sorted({key // blocks for key in found}):
        full = np.concatenate([found[f * blocks + i].reshape(-1, k + 1) for i in range(blocks)])
        out[f] = (int(round(full[k, k])), full[k, :k].copy(), full[:k, :k].copy())
    return n, shift, out


def _poisson_table(mean: float) -> np.ndarray:
    """The Poisson count of each of 2^16 equal steps of (0, 1)."""
    u, counts, term, at = (np.arange(1 << 16) + 0.5) / (1 << 16), np.zeros(1 << 16), np.exp(-mean), np.exp(-mean)
    for i in range(1, 40):
        counts += u >= at
        term *= mean / i
        at += term
    return counts


POISSON = _poisson_table(1.0)


def replicate_weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates): Poisson counts of mean 1 from 16 bits for each row and replicate, which a splitmix step draws from the row's hash."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, -(-replicates // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return POISSON[(x ^ (x >> np.uint64(31))).view("<u2")[:, :replicates]]


def replicate_sums(df: DataFrame, key: Column, columns: list[str], pairs: list[tuple[int, int]], replicates: int) -> np.ndarray:
    """(replicates, 1 + columns + pairs): sums of weights, weighted columns and weighted products on Poisson bootstraps.

    The weights of a batch are a matrix, so all replicates are one product of matrices: rows are not repeated.  Rows with a missing
    value are left out; columns should be near their means.
    """
    k, m = len(columns), 1 + len(columns) + len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, m))
        for b in batches:
            x = _matrix(b, k)
            whole = ~np.isnan(x).any(1)
            x = x[whole]
            z = np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i, j in pairs]])
            total += replicate_weights(b.column(k).to_numpy()[whole], replicates).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["key", "data"])

    found = _added(_doubles(df, columns, key.alias("_hash")).mapInArrow(run, "key long, data binary"))
    return found.get(0, np.zeros(replicates * m)).reshape(replicates, m)
