"""Best-fit packing of documents into training sequences, with conflicts.

Documents are dealt by a hash of what packing knows of them to shards of bounded size, rows alike in turns to shard after
shard; each shard packs its own, longest first, so that the layout doesn't depend on how the input is partitioned.  A
sequence (bin) carries bitmaps of the sources and duplicate clusters it holds, and takes a document only
if neither bit is set.  Bins are ordered by residual room; the search starts at the smallest residual
that fits and goes to the next one until a compatible bin is found: the tightest one.  Bins of one
residual that hold the same sources are looked at together, so a hot source is passed over at once.

A document longer than a sequence is cut: full pieces fill sequences alone, the rest is packed.  Lengths
are in words plus one separator.  Documents without words (null or empty texts) are returned with a null
bin.  A null source conflicts with nothing; a null cluster likewise.  Repeated rows are packed one by one
(as exact copies they share a cluster and so never a bin).  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, written

#: Words of a sequence, and words (about) of a shard.
CAPACITY, SHARD_WORDS = 2048, 2_000_000
PACKED = "doc_id long, piece int, n_words long, source string, cluster long, bin_id string, bin_offset int"


def measured(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster (that column, or a hash of the words: exact copies), n_words."""
    own = F.lit(None).cast("long") if cluster is None else F.col(cluster).cast("long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys = [], []
        for text, key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or "").encode().lower().split()
            sizes.append(len(words))
            keys.append(key if cluster is not None else xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "source", "cluster", "n_words"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), own.alias("cluster")), run, "doc_id long, source string, cluster long, n_words long")


class Bins:
    """Open bins by residual, then by the bitmap of their sources."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.at: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.used: list[int] = []
        self.clusters: list[int] = []

    def _put(self, b: int, sources: int) -> None:
        left = self.capacity - self.used[b]
        if left < 2:  # no document has fewer than one word and its separator
            return
        if left not in self.at:
            bisect.insort(self.residuals, left)
        self.at[left][sources].append(b)

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that a piece goes to, and its offset there."""
        for i in range(bisect.bisect_left(self.residuals, size), len(self.residuals)):
            left = self.residuals[i]
            classes = self.at[left]
            for sources, bins in classes.items():
                if sources & source:
                    continue
                for k, b in enumerate(bins):
                    if not self.clusters[b] & cluster:
                        bins[k] = bins[-1]
                        bins.pop()
                        if not bins:
                            del classes[sources]
                            if not classes:
                                del self.at[left]
                                self.residuals.pop(i)
                        offset = self.used[b]
                        self.used[b] += size
                        self.clusters[b] |= cluster
                        self._put(b, sources | source)
                        return b, offset
        b = len(self.used)
        self.used.append(size)
        self.clusters.append(cluster)
        self._put(b, source)
        return b, 0


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one shard: rows of (shard, doc_id, source, cluster, n_words, copies), in any order."""
    pdf = pdf.sort_values(["n_words", "doc_id", "source", "cluster"], ascending=[False, True, True, True], na_position="last", kind="stable")
    pdf = pdf.loc[pdf.index.repeat(pdf["copies"].astype("int64"))]
    repeated = pdf["cluster"].dropna().value_counts()
    bit = {c: 1 << i for i, c in enumerate(sorted(repeated[repeated > 1].index))}
    name = {s: 1 << i for i, s in enumerate(sorted(pdf["source"].dropna().unique()))}
    bins, rows, alone = Bins(capacity), [], 0
    shard = pdf["shard"].iat[0] if len(pdf) else 0
    tails = []
    for doc_id, source, cluster, n in zip(pdf["doc_id"], pdf["source"], pdf["cluster"], pdf["n_words"], strict=True):
        n, piece = int(n), 0
        base = (doc_id, source, cluster)
        if n == 0:
            rows.append((*base, 0, 0, None, None))
            continue
        while n + 1 > capacity:
            rows.append((*base, piece, capacity - 1, f"{shard}-full-{alone}", 0))
            alone, piece, n = alone + 1, piece + 1, n - (capacity - 1)
        if n:
            tails.append((n, piece, base))
    tails.sort(key=lambda x: -x[0])
    for n, piece, base in tails:
        b, offset = bins.add(n + 1, 0 if pd.isna(base[1]) else name[base[1]], 0 if pd.isna(base[2]) else bit.get(base[2], 0))
        rows.append((*base, piece, n, f"{shard}-{b}", offset))
    out = pd.DataFrame(rows, columns=["doc_id", "source", "cluster", "piece", "n_words", "bin_id", "bin_offset"])
    return out.astype({"doc_id": "Int64", "cluster": "Int64", "piece": "int32", "n_words": "int64", "bin_offset": "Int32"})[["doc_id", "piece", "n_words", "source", "cluster", "bin_id", "bin_offset"]]


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS, cluster: str | None = None) -> DataFrame:
    """A row for each piece of each document: where it lies (bin_id, bin_offset in words)."""
    alike = ["doc_id", "source", "cluster", "n_words"]
    sized = written(measured(docs, cluster).groupBy(*alike).agg(F.count("*").alias("copies")), "sizes")
    total = sized.agg(F.sum((F.col("n_words") + 1) * F.col("copies")).alias("n"), F.sum("copies").alias("rows")).first()
    # Rows count too, so that shards of many short documents stay small.
    shards = max(1, -(-int(total["n"] or 0) // shard_words), -(-int(total["rows"] or 0) // 50_000))
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("copies", F.lit(shards)) - 1))
    dealt = sized.withColumn("turn", turn).withColumn("shard", F.pmod(F.pmod(F.xxhash64(*alike), F.lit(shards)) + F.col("turn"), F.lit(shards)).cast("int"))
    share = F.floor(F.col("copies") / shards) + F.when(F.col("turn") < F.col("copies") % shards, 1).otherwise(0)
    spread = dealt.select("shard", *alike, share.cast("long").alias("copies")).repartition(shards, "shard")
    # Positions in Int64 columns, since pandas would turn nullable longs into doubles.
    return spread.groupBy("shard").applyInArrow(lambda t: pa.Table.from_pandas(pack_shard(t.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), capacity), schema=ARROW, preserve_index=False), PACKED)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of what ``pack`` returned: bins, pieces, words, and the share of the bins' room that words and separators take (null without bins)."""
    bins = packed.where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.count("*").alias("pieces"), F.sum("n_words").alias("words"))
    used = F.sum("words") + F.sum("pieces")
    return bins.agg(F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("words").alias("words"), F.try_divide(used, F.count("*") * capacity).alias("fill"))


ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_words", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("bin_id", pa.string()), ("bin_offset", pa.int32())])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
