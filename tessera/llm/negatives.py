"""Hard-negative mining: product-quantised scores with rigorous bounds filter, exact integer products decide.

1. Components become integers floor(256 x).  Codebooks (``codes``) are trained on all rows; every row is stored with its
   integer components, its codes and the norm of its residual (what the codes leave of it).
2. Rows are dealt to blocks by a hash of their id; every anchor is sent to every block (a stated query set against all
   rows).  A task holds one block, and its anchors pass by in batches: memory is bounded by BLOCK and BATCH.
3. For a batch, a table holds the product of each anchor's part with each entry.  Looked up and summed, it gives the
   score with a row's codes; the true score differs by at most |anchor| |residual| (Cauchy and Schwarz).  Rows are sorted
   by label and residual, so that chunks have narrow bounds.
4. First pass: the best rows of the anchor's label.  Rows whose score plus bound doesn't reach the place-th best exact
   score so far can't get in; the others are scored exactly.  Blocks' best are merged by rank.
5. Second pass: each positive's window of scores, [80 %, 100 %] of its own.  Rows of other labels whose bounds miss all
   windows of the anchor, or fall below what fills them already, are left out; exact products complete each window.

No bound drops a row that belongs to the result: which rows are left out depends on the data, the result does not.

Rows with a null id or label, a null vector, or null or non-finite components take no part; of rows that share an id the
one of the smallest label, then the smallest components, counts.  Shorter vectors count as filled up with zeros.  Anchors without
others of their label have no positives; a negative score has an empty window.  Fewer rows than asked for are all
returned, ties by the smaller id.  An empty table gives an empty result.  Components too large for exact products in a
long are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codes import matrix, nearest, trained, usable
from .common import written

#: Entries of a codebook, and components of a part: residuals of about 15 % of a vector that has no structure.
ENTRIES, WIDTH = 128, 2
#: Rows of a block (about), anchors that a task handles at once, rows of a chunk.
BLOCK, BATCH, CHUNK = 65_536, 256, 4096
#: Positives of an anchor, negatives of a positive, the window in per cent of the positive's score.
POSITIVES, NEGATIVES, FLOOR, CEILING = 5, 5, 80, 100
#: Pairs that are scored exactly at once.
PAIRS = 1 << 16
LEAST = np.iinfo(np.int64).min

ROWS = "block int, vec_id long, label long, comps binary, codes binary, rest double"


def indexed(vectors: DataFrame, books: np.ndarray, blocks: int) -> DataFrame:
    """Every row (vec_id, embedding, label) with its block, integer components, codes and residual norm."""
    parts, _, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"), parts * width)
            codes, error = nearest(x, shared.value)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("block"), b.column("vec_id"), b.column("label"), binary(x.astype(np.int32)), binary(codes.astype(np.uint16)), pa.array(np.sqrt(error.astype(np.float64)))],
                names=["block", "vec_id", "label", "comps", "codes", "rest"],
            )

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    return vectors.select(block, "vec_id", F.col("label").cast("long"), "embedding").mapInArrow(run, ROWS)


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each group, ties by the smaller id; ordered by group and rank."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < k]


class Tops:
    """The k best (score, id) of some groups, and the score that a new one has to reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.least = k, floors.copy()
        self.groups = self.scores = self.ids = np.empty(0, np.int64)

    def add(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(groups):
            return
        g, s, i = (np.concatenate(p) for p in ((self.groups, groups), (self.scores, scores), (self.ids, ids)))
        keep = best(g, s, i, self.k)
        self.groups, self.scores, self.ids = g[keep], s[keep], i[keep]
        count = np.bincount(self.groups, minlength=len(self.least))
        last = np.cumsum(count) - 1
        full = count >= self.k
        self.least[full] = np.maximum(self.least[full], self.scores[last[full]])


class Block:
    """One block's rows, sorted by label and residual, repeated ids left out."""

    def __init__(self, rows: pa.Table, books: np.ndarray):
        ids = rows.column("vec_id").to_numpy()
        first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)  # they come by id, label, components
        labels, rest = rows.column("label").to_numpy()[first], rows.column("rest").to_numpy()[first]
        order = np.lexsort((rest, labels))
        raw = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(len(ids), -1)[first][order]
        self.books, self.ids, self.labels, self.rest = books, ids[first][order], labels[order], rest[order]
        self.comps, self.codes = raw("comps", np.int32), raw("codes", np.uint16)
        self.most = float(np.abs(self.comps).max(initial=0))

    def looked_up(self, table: list[np.ndarray], rows: slice, kind: type) -> np.ndarray:
        """(rows, anchors): scores with the rows' codes."""
        out = np.zeros((rows.stop - rows.start, table[0].shape[1]), kind)
        for p, t in enumerate(table):
            out += t[self.codes[rows, p]]
        return out

    def exact(self, comps: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Integer products of pairs (row of the block, anchor)."""
        if not len(rows):
            return np.empty(0, np.int64)
        return np.concatenate([np.einsum("ij,ij->i", self.comps[rows[s : s + PAIRS]].astype(np.int64), comps[cols[s : s + PAIRS]]) for s in range(0, len(rows), PAIRS)])

    def tables(self, comps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, type]:
        """Products of the anchors' parts with all entries, the anchors' norms, and a type that holds all sums exactly."""
        parts, _, width = self.books.shape
        most = max(float(np.abs(self.books).max(initial=0)), self.most) * float(np.abs(comps).max(initial=0)) * parts * width
        kind = np.int32 if most < 2**30 else np.int64
        table = [(self.books[p] @ comps[:, p * width : (p + 1) * width].T).astype(kind) for p in range(parts)]
        return table, np.sqrt((comps * comps).sum(1).astype(np.float64)), kind

    def reach(self, norms: np.ndarray, rest: np.ndarray | float) -> np.ndarray:
        """How far a true score can be from the looked-up one, rounded up beyond any error of the doubles."""
        return np.ceil(norms * rest * (1 + 1e-9)).astype(np.int64) + 1

    def positives(self, ids: np.ndarray, labels: np.ndarray, comps: np.ndarray, k: int) -> Tops:
        """The best rows of each anchor's own label, the anchor left out."""
        tops = Tops(np.full(len(ids), LEAST // 2), k)
        for label in np.unique(labels):
            lo, hi = np.searchsorted(self.labels, label, "left"), np.searchsorted(self.labels, label, "right")
            own = np.flatnonzero(labels == label)
            if lo == hi:
                continue
            table, norms, kind = self.tables(comps[own])
            for start in range(lo, hi, CHUNK):
                rows = slice(start, min(start + CHUNK, hi))
                scores = self.looked_up(table, rows, kind)
                n = rows.stop - rows.start
                if start == lo:  # a first guess sets the place-th best score; what it scores is exact
                    guess = np.argpartition(scores, max(n - 2 * k, 0), axis=0)[max(n - 2 * k, 0) :].T
                    i, j = guess.ravel(), np.repeat(np.arange(len(own)), guess.shape[1])
                    self._keep(tops, comps, ids, own, rows, i, j)
                need = tops.least[own] - self.reach(norms, self.rest[rows.stop - 1])
                i, j = np.nonzero(scores >= need)
                close = scores[i, j] + self.reach(norms[j], self.rest[rows][i]) >= tops.least[own[j]]
                i, j = i[close], j[close]
                if start == lo:  # the guess was counted
                    seen = np.zeros((len(own), n), bool)
                    np.put_along_axis(seen, guess, True, axis=1)
                    fresh = ~seen[j, i]
                    i, j = i[fresh], j[fresh]
                self._keep(tops, comps, ids, own, rows, i, j)
        return tops

    def _keep(self, tops: Tops, comps: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: slice, i: np.ndarray, j: np.ndarray) -> None:
        i, j = i + rows.start, own[j]
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        tops.add(j, self.exact(comps, i, j), self.ids[i])

    def negatives(self, labels: np.ndarray, comps: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Tops:
        """The best rows of other labels within windows [low, high] of scores; window w belongs to ``anchor[w]``, ascending."""
        tops = Tops(low, k)
        first = np.searchsorted(anchor, np.arange(len(labels)), "left")
        many = np.searchsorted(anchor, np.arange(len(labels)), "right") - first
        table, norms, kind = self.tables(comps)
        highest = np.maximum.reduceat(np.append(high, LEAST), np.minimum(first, len(high)))
        highest = np.where(many > 0, highest, LEAST // 2)
        for start in range(0, len(self.ids), CHUNK):
            rows = slice(start, min(start + CHUNK, len(self.ids)))
            scores = self.looked_up(table, rows, kind)
            lowest = np.minimum.reduceat(np.append(tops.least, -LEAST - 1), np.minimum(first, len(low)))
            lowest = np.where(many > 0, lowest, -(LEAST // 2))
            widest = self.reach(norms, self.rest[rows].max())
            i, j = np.nonzero((scores >= lowest - widest) & (scores <= highest + widest))
            own = self.reach(norms[j], self.rest[rows][i])
            close = (scores[i, j] + own >= lowest[j]) & (scores[i, j] - own <= highest[j]) & (self.labels[rows][i] != labels[j])
            i, j = i[close] + start, j[close]
            score = self.exact(comps, i, j)
            # Each scored pair, for each window of its anchor that it falls into.
            pair = np.repeat(np.arange(len(i)), many[j])
            w = first[j][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many[j]) - many[j], many[j])
            fits = (score[pair] >= tops.least[w]) & (score[pair] <= high[w])
            tops.add(w[fits], score[pair[fits]], self.ids[i[pair[fits]]])
        return tops


def over_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, books: np.ndarray, fn: Callable[[Block, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` of every block and every batch of anchors.

    Anchors (vec_id, label, comps, pos_ids, pos_scores) are copied to each block; a block's rows come first, its anchors pass by.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = {"pos_ids": "array<long>", "pos_scores": "array<long>"}
    held = rows.select("block", F.lit(0).alias("kind"), "vec_id", "label", "comps", "codes", "rest", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "comps", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("rest"), *kinds
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, loading, waiting, n = None, None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, n
            if waiting and block is not None:
                yield fn(block, pa.Table.from_batches(waiting))
            waiting, n = [], 0

        for b in batches:
            key = b.column("block").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
                part, (own, kind) = b.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                if own != at:
                    yield from flush()
                    block, at, loading = None, own, []
                if kind == 0:
                    loading.append(part)
                    continue
                if loading:
                    block, loading = Block(pa.Table.from_batches(loading), shared.value), []
                while part.num_rows:
                    take = part.slice(0, BATCH - n)
                    waiting.append(take)
                    n += take.num_rows
                    part = part.slice(take.num_rows)
                    if n >= BATCH:
                        yield from flush()
        yield from flush()

    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id", "label", "comps")
    return dealt.mapInArrow(run, schema)


def _anchors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    comps = np.frombuffer(b"".join(t.column("comps").to_pylist()), np.int32).reshape(t.num_rows, -1).astype(np.int64)
    return t.column("vec_id").to_numpy(), t.column("label").to_numpy(), comps


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def ranked(df: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    """The k best rows of each key; Spark keeps k of each key in every task before it sends them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), row))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(vectors: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, ceiling: int = CEILING) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label), with ``asked`` true for anchors."""
    spark = vectors.sparkSession
    rows = usable(vectors.where("vec_id IS NOT NULL AND label IS NOT NULL"), "label")
    size = rows.agg(F.max(F.size("embedding")), F.count("*")).first()
    length, total = int(size[0] or 0), int(size[1])
    # No fewer blocks than cores, unless that made them tiny.
    blocks = max(1, -(-total // BLOCK), min(2 * spark.sparkContext.defaultParallelism, total // 1024))
    books = trained(rows, max(1, -(-length // WIDTH)), ENTRIES, length=length)
    index = written(indexed(rows, books, blocks), "index")
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "comps"))
    anchors = written(index.where(asked).select("vec_id", "label", "comps", one.alias("one")).where("one = 1").drop("one"), "anchors")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("pos_ids", "pos_scores")]

    def first_pass(block: Block, t: pa.Table) -> pa.RecordBatch:
        ids, labels, comps = _anchors(t)
        tops = block.positives(ids, labels, comps, positives)
        return _longs(ids[tops.groups], tops.ids, tops.scores, names=["anchor_id", "positive_id", "positive_score"])

    found = over_blocks(index, anchors.select("*", *none), blocks, books, first_pass, "anchor_id long, positive_id long, positive_score long")
    near = ranked(found, ["anchor_id"], "positive_score", "positive_id", positives)
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    asking = written(anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "comps", F.col("p.positive_id").alias("pos_ids"), F.col("p.positive_score").alias("pos_scores")), "positives")

    def second_pass(block: Block, t: pa.Table) -> pa.RecordBatch:
        ids, labels, comps = _anchors(t)
        lists = t.column("pos_ids").combine_chunks()
        anchor = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        pos, score = lists.flatten().to_numpy(), t.column("pos_scores").combine_chunks().flatten().to_numpy()
        low, high = -((-floor * score) // 100), (ceiling * score) // 100
        tops = block.negatives(labels, comps, anchor, low, high, negatives)
        g = tops.groups
        return _longs(ids[anchor[g]], pos[g], score[g], tops.ids, tops.scores, names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = over_blocks(index, asking, blocks, books, second_pass, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return ranked(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
WITH kept AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM kept a JOIN kept r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
  positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""
}
