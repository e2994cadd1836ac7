"""Vector code compression: product quantisation with integer codebooks, exact to the last digit.

1. Components become integers floor(256 x); vectors are cut into equal consecutive parts.
2. Each part position has a codebook of its own.  It starts as that part of the vectors of the smallest ids.
3. A round broadcasts the codebooks.  Arrow batches compute all distances of their parts at once: |x|^2 - 2 x.c + |c|^2,
   the products as int64 matrices, the nearest entry by the first argmin.  A task adds its batches' components for each
   entry and sends one number for each; a grouped shuffle merges them, and the quotients, rounded down, are the new entries.
4. After the last round every part is assigned once more: codes and squared errors.

What reaches the driver is a codebook: a number for each component of each entry, whatever the rows.  Sums of integers
don't depend on order, so reruns and recomputed tasks agree.

Rows whose vector is null, or holds null or non-finite components, are dropped.  Shorter vectors, empty ones included,
count as filled up with zeros to the longest, and that to a multiple of the parts.  A null id comes after all others when
the first entries are chosen; rows of equal ids count by their components.  Fewer rows than entries make shorter codebooks;
an empty table gives an empty result.  Repeated rows are coded one by one.  Components too large for sums of squares in
a long are an error, not a wrong number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Components are multiplied by SCALE before they are rounded down.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are numbers."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def longest(df: DataFrame, vector: str = "embedding") -> int:
    return int(df.agg(F.max(F.size(vector))).first()[0] or 0)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Arrays of doubles as rows of integers, filled up with zeros."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    scaled = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    # Twice a component squared, over all components, stays far below 2^63.
    if scaled.size and 4 * width * float(np.abs(scaled).max()) ** 2 >= 2.0**55:
        raise ValueError("components are too large: sums of their squares would not fit a long")
    out[np.arange(width) < lengths[:, None]] = scaled.astype(np.int64)
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer vectors: the index of each part's nearest entry, and the squared distances summed over parts."""
    parts, _, width = books.shape
    codes = np.zeros((len(x), parts), np.int64)
    error = np.zeros(len(x), np.int64)
    for p in range(parts if len(x) else 0):
        own = x[:, p * width : (p + 1) * width]
        far = (books[p] ** 2).sum(1) - 2 * (own @ books[p].T)
        codes[:, p] = far.argmin(1)
        error += (own * own).sum(1) + far[np.arange(len(x)), codes[:, p]]
    return codes, error


def first_books(vectors: DataFrame, parts: int, entries: int, length: int) -> np.ndarray:
    """(parts, entries, components): the vectors of the smallest ids, cut."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    width = max(1, -(-length // parts))
    x = matrix(pa.array([r[0] for r in rows], pa.list_(pa.float64())), parts * width)
    return np.ascontiguousarray(x.reshape(len(rows), parts, width).transpose(1, 0, 2))


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the entries' means, rounded down; entries that nothing is nearest to stay."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last number counts
        for b in batches:
            x = matrix(b.column(0), parts * width)
            codes, _ = nearest(x, shared.value)
            for p in range(parts):
                np.add.at(total[p, :, :width], codes[:, p], x[:, p * width : (p + 1) * width])
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        used = np.flatnonzero(np.repeat(total[:, :, width] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], names=["slot", "total"])

    rows = vectors.select("embedding").mapInArrow(sums, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
    merged = np.zeros(parts * entries * (width + 1), np.int64)
    merged[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    merged = merged.reshape(parts, entries, width + 1)
    count = merged[:, :, width:]
    return np.where(count > 0, merged[:, :, :width] // np.maximum(count, 1), books)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, length: int | None = None) -> np.ndarray:
    """Codebooks of ``vectors`` (vec_id, embedding as doubles, all finite); without entries if there are no rows."""
    books = first_books(vectors, parts, entries, longest(vectors) if length is None else length)
    for _ in range(rounds if books.shape[1] else 0):
        books = improved(vectors, books)
    return books


def usable(df: DataFrame, *others: str) -> DataFrame:
    """(vec_id, embedding as doubles, others...) of the rows that take part."""
    return df.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), *others)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) without the vectors, with code (hex, two digits an index, more from 256 entries on) and error."""
    parts, entries, width = books.shape
    digits = max(2, -(-max(entries - 1, 1).bit_length() // 4))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(max(entries, 1))])
        for b in batches:
            codes, error = nearest(matrix(b.column(1), parts * width), shared.value)
            texts = np.ascontiguousarray(names[codes]).view(f"<U{digits * parts}").ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(texts.tolist(), pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "embedding", "label").mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of all rows that take part.

    Errors are summed over labels first (combined before they are sent), and the sums come back by a join: no label's
    rows meet in one task.
    """
    vectors = usable(df, "label")
    books = trained(vectors, parts, entries, rounds)
    rows = written(encoded(vectors, books), "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_ASSIGNED = """
  a{i} AS (SELECT vec_id, part, x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT v.vec_id, v.part, v.x, c.entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda k: (v.x[k] - c.x[k]) * (v.x[k] - c.x[k])))::BIGINT AS d
    FROM parts v JOIN c{i} c ON v.part = c.part) GROUP BY vec_id, part, x)"""
_MEANS = """
  m{i} AS (SELECT part, entry, list(q ORDER BY k) AS x FROM (
    SELECT part, entry, k, CAST(CASE WHEN sum(v) >= 0 THEN sum(v) // count(*) ELSE -((count(*) - 1 - sum(v)) // count(*)) END AS BIGINT) AS q
    FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM a{i}) GROUP BY part, entry, k) GROUP BY part, entry),
  c{j} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)"""

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {
    "op12_vector_codes": f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
  c0 AS (SELECT part, entry, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 64),
  {_ASSIGNED.format(i=0)}, {_MEANS.format(i=0, j=1)}, {_ASSIGNED.format(i=1)}, {_MEANS.format(i=1, j=2)}, {_ASSIGNED.format(i=2)},
  coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
  books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""
}
