"""What the operators share: written tables, samples, whole groups in batches, digests of spans."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import new_path, written  # noqa: F401  (the operators take them from here)

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


#: Hashes of a sample are of so many bits: enough to keep a few rows of any number.
SAMPLE_BITS = 62


def sampled(rows: int, total: int) -> int:
    """Hashes below this number keep about ``rows`` of ``total`` rows."""
    return min(1 << SAMPLE_BITS, -(-(rows << SAMPLE_BITS) // max(total, 1)))


def sample_by_key(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), chosen by a hash of ``key`` and the other columns: the same on every run.

    Rows of one key, null included, are chosen apart unless they are equal.  No row of a table that has some is an error.
    """
    total = df.count()
    if total <= rows:
        return df
    others = [c for c in df.columns if c != key]
    out = df.where(F.shiftrightunsigned(F.xxhash64(key, *others, F.lit(17)), 64 - SAMPLE_BITS) < F.lit(sampled(rows, total)))
    if out.isEmpty():
        raise ValueError(f"a sample of {rows} of {total} rows is empty: are they all equal?")
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def by_key(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table | None], schema: str, rows: int = 20_000) -> DataFrame:
    """``fn`` over tables of whole groups of ``key``, many groups at once: rows are dealt and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                keys = table.column(key).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if cut and (out := fn(table.slice(0, cut))) is not None:
                    yield from out.to_batches()
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield from out.to_batches()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


class Covered:
    """Whether a stretch meets any of some spans (start, end): they are joined once, then looked up."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def span_digest(df: DataFrame, kinds: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Counts of each base kind, SHA-256 of the base spans and all spans as text."""
    counts = [F.size(of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select(key, *counts, F.sha2(span_text(of_kinds(F.col("spans"), kinds)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
