"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

1. Equal vectors become one node.  For the graph, vectors get one more coordinate that makes all norms equal, so
   that inner products of any norms are near exactly where the extended vectors are.  With E the largest norm, the
   coordinate is E - gap, and products less E^2 are x.y + gap gap' - E gap - E gap': no large numbers cancel.
2. Nodes are numbered within parts of about PART nodes, by the sides of a few random projections (a crowded side is
   dealt further by hash).  A part is what one task joins: it asks for each vector it needs once.
3. The first graph comes from a few random partitions.  Each orders the nodes by the sides of random projections and
   by one more projection; ranges of that order are dealt to tasks, and runs of CELL nodes are compared.  However
   crowded a region is, a run has CELL nodes at most.
4. NN-descent: every node gathers its neighbours and (K at most, new ones first, by hash) reverse neighbours, and
   tells each pair of them with a new one that is nearer than what they have; rounds end when at most CHANGES of
   the entries of all lists were changed, however many rounds that takes.
5. A query is a node of the index (every row is indexed).  Its beam starts with its own list (and the longest
   vectors, where norms differ); each round expands the nodes of the beam that weren't expanded yet, asking for the
   lists and vectors of those alone, until every beam has only expanded nodes.
6. The best of the beam are scored with the original vectors in double precision, and copies are listed by id.

Partitions and beams grow with the logarithm of the nodes; nothing else depends on the size.  Steps 2 to 5 use
vectors of 16 bits a component with a scale and gap of their own; only step 6's scores are returned.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; shorter
vectors count as filled up with zeros; of rows that share an id the smallest vector counts.  Fewer candidates than
asked for are all returned, ties by the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_key, written

#: Length of lists, nodes of a run, nodes of a part (about), share of changed entries at which descent ends.
K, CELL, PART, CHANGES = 40, 256, 4096, 0.02
#: Beam for each doubling of the nodes; candidates that are scored exactly for each that is asked for.
BEAM, SCORED = 6, 3
#: Where norms differ, the longest vectors are starts of every walk as well: inner products favour them.
HEADS = 64
#: Entries that a task holds before it keeps the best ones alone, and lists that it joins at once.
HELD, AT_ONCE = 2_000_000, 512
BITS = 32
LISTS = pa.schema([("part", pa.int64()), ("nodes", pa.binary()), ("code", pa.binary()), ("sizes", pa.binary()), ("nbrs", pa.binary()), ("scores", pa.binary())])
GRAPH = "node long, code binary, nbrs binary, scores binary, fresh binary, worst double, changes long"
PACKS = pa.schema([("part", pa.int64()), ("centers", pa.binary()), ("sizes", pa.binary()), ("members", pa.binary()), ("fresh", pa.binary())])
BEAMS = pa.schema([("part", pa.int64()), ("query", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary()), ("done", pa.binary()), ("found", pa.binary())])
_TYPES = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


def part_of(node: str) -> Column:
    return F.shiftright(node, BITS)


def _blobs(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and how many each row has; nulls have none."""
    values = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(values), kind), np.array([len(x) for x in values], np.int64) // np.dtype(kind).itemsize


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary of each stretch of values."""
    data, end = values.tobytes(), np.cumsum(sizes) * values.itemsize
    return pa.array([data[i:j] for i, j in zip([0, *end[:-1]], end, strict=True)] if len(end) else [], pa.binary())


def _coded(x: np.ndarray, top: float) -> list[bytes]:
    """16-bit components, then scale, gap and E * gap as floats."""
    square = (x * x).sum(1)
    gap = square / (math.sqrt(top) + np.sqrt(np.maximum(0.0, top - square)))
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 32767
    code = np.rint(x / scale[:, None]).astype(np.int16)
    tail = np.stack((scale, gap, math.sqrt(top) * gap), 1).astype(np.float32)
    return [c.tobytes() + t.tobytes() for c, t in zip(code, tail, strict=True)]


def _decoded(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with their gap as the last component, and E * gap."""
    values = column.to_pylist()
    return _read(np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1))


def _read(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tail = np.ascontiguousarray(codes[:, -12:]).view(np.float32)
    x = np.ascontiguousarray(codes[:, :-12]).view(np.int16).astype(np.float32) * tail[:, :1]
    return np.concatenate((x, tail[:, 1:2]), 1), tail[:, 2]


def _embeddings(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column(1).to_pylist(), dtype=np.float64)


def _sides(x: np.ndarray, seed: int, planes: int) -> np.ndarray:
    """A number of ``planes`` bits for each vector: its sides of random planes."""
    return ((x @ np.random.default_rng(seed).normal(size=(x.shape[1], planes))) > 0) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(x), np.int64)


def mean_of(vectors: DataFrame, n: int) -> np.ndarray:
    """The mean vector, from a sum for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_embeddings(b).sum(0) for b in batches if b.num_rows]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, 0)], pa.list_(pa.float64()))], names=["sums"])

    parts = vectors.select("first_id", "embedding").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    return np.array([r["x"] for r in parts.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]) / n


def numbered(distinct: DataFrame, n: int, mean: np.ndarray) -> DataFrame:
    """Adds node: the part in the upper bits, a number within the part in the lower BITS."""
    planes = max(0, round(math.log2(n / PART)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sides(_embeddings(b) - mean, 999, planes))], names=["first_id", "side"])

    sides = written(distinct.select("first_id", "embedding").mapInArrow(run, "first_id long, side long"), "sides")
    crowd = sides.groupBy("side").agg(F.ceil(F.count("*") / PART).cast("int").alias("pieces"))
    part = F.pmod(F.xxhash64("side", F.pmod(F.xxhash64("first_id"), F.col("pieces"))), F.lit(1 << 30)).alias("part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first_id")).cast("long")
    parts = sides.join(crowd, "side").select("first_id", part).withColumn("node", F.shiftleft("part", BITS).bitwiseOR(rank))
    return distinct.join(parts.select("first_id", "node"), "first_id")


def coded(nodes: DataFrame, top: float, trees: int, planes: int, mean: np.ndarray) -> DataFrame:
    """node, code, and places: sides and one more projection for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _embeddings(b)
            if not len(x):
                continue
            code, centered = _coded(x, top), x - mean
            sides = np.stack([_sides(centered, 1000 + t, planes) for t in range(trees)], 1)
            along = centered @ np.random.default_rng(7).normal(size=(x.shape[1], trees))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.binary()), pa.array(list(sides), pa.list_(pa.int64())), pa.array(list(along), pa.list_(pa.float64()))], names=["node", "code", "sides", "along"])

    return nodes.select("node", "embedding").mapInArrow(run, "node long, code binary, sides array<long>, along array<double>")


def best_of(u: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best distinct v of each u (numbers under 2^31), in order of u, best first; ties to the smaller v."""
    _, first = np.unique(u.astype(np.int64) << 32 | v, return_index=True)
    u, v, score = u[first], v[first], score[first].astype(np.float32)
    bits = score.view(np.int32).astype(np.int64)
    rising = np.where(bits >= 0, bits + (1 << 31), ~bits & 0x7FFFFFFF)  # floats in the order of whole numbers
    order = np.argsort(u.astype(np.int64) << 32 | (0xFFFFFFFF - rising), kind="stable")
    u, v, score = u[order], v[order], score[order]
    start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))[: len(u)]
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
    keep = rank < k
    return u[keep], v[keep], score[keep]


def _lists(node: np.ndarray, nbr: np.ndarray, score: np.ndarray) -> pa.Table:
    """A row for each part of the nodes: entries in order of node."""
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))[: len(node)]
    sizes = np.diff(np.append(start, len(node)))
    own, rows = np.unique(node[start] >> BITS, return_counts=True)
    many = np.unique(node >> BITS, return_counts=True)[1]
    return pa.Table.from_arrays([pa.array(own), _cut(node[start], rows), pa.nulls(len(own), pa.binary()), _cut(sizes, rows), _cut(nbr, many), _cut(score, many)], schema=LISTS)


def run_lists(table: pa.Table) -> pa.Table:
    """The K nearest of each node within a run, with its code."""
    node = table.column("node").to_numpy()
    x, bias = _decoded(table.column("code"))
    s = x @ x.T - bias - bias[:, None]
    np.fill_diagonal(s, -np.inf)
    k = min(K, len(node) - 1)
    best = np.argpartition(-s, k - 1, 1)[:, :k] if k else np.zeros((len(node), 0), np.int64)
    sizes, one = np.full(len(node), k), np.ones(len(node), np.int64)
    return pa.Table.from_arrays([pa.array(node >> BITS), _cut(node, one), table.column("code"), _cut(sizes, one), _cut(node[best].ravel(), sizes), _cut(np.take_along_axis(s, best, 1).ravel(), sizes)], schema=LISTS)


def first_lists(codes: DataFrame) -> DataFrame:
    """Lists from runs of CELL nodes in the order of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * CELL:  # the last run of a task has CELL to 2 * CELL nodes
                table = pa.Table.from_batches(held)
                at = 0
                while n - at >= 2 * CELL:
                    yield from run_lists(table.slice(at, CELL)).to_batches()
                    at += CELL
                held, n = table.slice(at).to_batches(), n - at
        table = pa.Table.from_batches(held) if n else None
        for at in range(0, n, CELL):
            yield from run_lists(table.slice(at, CELL)).to_batches()

    places = F.explode(F.arrays_zip(F.transform("sides", lambda s, t: t).alias("tree"), F.col("sides").alias("side"), F.col("along").alias("along"))).alias("p")
    rows = codes.select("node", "code", places).select("node", "code", "p.tree", "p.side", "p.along")
    return rows.repartitionByRange("tree", "side", "along").sortWithinPartitions("tree", "side", "along").select("node", "code").mapInArrow(run, _ddl(LISTS))


def merged(table: pa.Table) -> pa.Table:
    """The K best of each node's lists; fresh marks those that its known list (the row that has ``known``) didn't have, changes counts them."""
    nodes, rows = _blobs(table.column("nodes"), np.int64)
    sizes, _ = _blobs(table.column("sizes"), np.int64)
    nbrs, _ = _blobs(table.column("nbrs"), np.int64)
    scores, _ = _blobs(table.column("scores"), np.float32)
    own, at = np.unique(nodes, return_inverse=True)
    ids, v = np.unique(nbrs, return_inverse=True)
    u = np.repeat(at, sizes)
    known = np.repeat(np.repeat(table.column("known").to_numpy(zero_copy_only=False), rows), sizes)
    before = np.sort(u[known].astype(np.int64) << 32 | v[known])
    u, v, s = best_of(u, v, scores, K)
    pairs = u.astype(np.int64) << 32 | v
    fresh = before[np.minimum(np.searchsorted(before, pairs), len(before) - 1)] != pairs if len(before) else np.ones(len(u), bool)
    count = np.bincount(u, minlength=len(own))
    changes = np.bincount(u, weights=fresh, minlength=len(own)).astype(np.int64)
    worst = np.full(len(own), -1e30)
    last = np.cumsum(count) - 1
    worst[count >= K] = s[last[count >= K]]
    code: list[bytes] = [b""] * len(own)
    for i, c in zip(at[np.cumsum(rows) - rows].tolist(), table.column("code").to_pylist(), strict=True):
        if c is not None:  # rows with a code are of one node
            code[i] = c
    return pa.table({"node": own, "code": pa.array(code, pa.binary()), "nbrs": _cut(ids[v], count), "scores": _cut(s, count), "fresh": _cut(fresh, count), "worst": worst, "changes": changes})


def lists_of(graph: DataFrame) -> DataFrame:
    """A graph's lists as rows to merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sizes = b.column(0).to_numpy(), [len(x) // 8 for x in b.column(2).to_pylist()]
            one = np.ones(len(node), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node >> BITS), _cut(node, one), b.column(1), _cut(np.array(sizes, np.int64), one), b.column(2), b.column(3)], names=LISTS.names)

    return graph.select("node", "code", "nbrs", "scores").mapInArrow(run, _ddl(LISTS))


def edges(graph: DataFrame) -> DataFrame:
    """(node, nbr, fresh) of every list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nbrs, sizes = _blobs(b.column(1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(nbrs), pa.array(_blobs(b.column(2), np.bool_)[0])], names=["node", "nbr", "fresh"])

    return graph.select("node", "nbrs", "fresh").mapInArrow(run, "node long, nbr long, fresh boolean")


def packed(table: pa.Table) -> pa.Table:
    """A row for each part: its centers with a new member, and the members of each."""
    part, center, member, fresh = (table.column(c).to_numpy(zero_copy_only=False) for c in ("part", "center", "member", "fresh"))
    order = np.lexsort((~fresh, member, center))
    part, center, member, fresh = part[order], center[order], member[order], fresh[order]
    new = np.concatenate(([True], (center[1:] != center[:-1]) | (member[1:] != member[:-1])))
    part, center, member, fresh = part[new], center[new], member[new], fresh[new]
    start = np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1])))
    live = np.repeat(np.logical_or.reduceat(fresh, start), np.diff(np.append(start, len(center))))
    part, center, member, fresh = part[live], center[live], member[live], fresh[live]
    start = np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1])))[: len(center)]
    sizes = np.diff(np.append(start, len(center)))
    # Parts are the upper bits of centers, so they are in order, too.
    own, rows = np.unique(part[start], return_counts=True)
    many = np.unique(part, return_counts=True)[1]
    return pa.Table.from_arrays([pa.array(own), _cut(center[start], rows), _cut(sizes, rows), _cut(member, many), _cut(fresh, many)], schema=PACKS)


SHIPPED = pa.schema([("part", pa.int64()), ("nodes", pa.binary()), ("codes", pa.binary()), ("worst", pa.binary())])


def shipped(packs: DataFrame, column: str, graph: DataFrame, also: str | None = None) -> DataFrame:
    """Vectors of all nodes that rows' lists (and a node of each row, ``also``) hold, by the asking part: one request, and one answer, for two parts.

    (part, nodes, codes, worst), each a binary of a part's nodes.  Rows go with the pairs of parts that have to do with each other, not with nodes;
    rows of one part should lie together, and its answers may hold a node more than once.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes = _blobs(b.column(1), np.int64)
            part = b.column(0).to_numpy()
            of = np.repeat(part, sizes)
            if also is not None:
                nodes, of = np.concatenate((nodes, b.column(2).to_numpy())), np.concatenate((of, part))
            both = np.unique(np.stack((of, nodes), 1), axis=0)  # in order, so the nodes of two parts are together
            of, nodes = both[:, 0], both[:, 1]
            start = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (nodes[1:] >> BITS != nodes[:-1] >> BITS)))) if len(of) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[start] >> BITS), pa.array(of[start]), _cut(nodes, np.diff(np.append(start, len(nodes))))], names=["home", "part", "nodes"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not len(asked) or not len(own):
            return SHIPPED.empty_table()
        order = np.argsort(own.column("node").to_numpy())
        ids, worst = own.column("node").to_numpy()[order], own.column("worst").to_numpy()[order]
        values = own.column("code").to_pylist()
        codes = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)[order]
        nodes, sizes = _blobs(asked.column("nodes"), np.int64)
        at = np.searchsorted(ids, nodes)
        return pa.Table.from_arrays([asked.column("part").combine_chunks(), _cut(nodes, sizes), _cut(codes[at].view(f"V{codes.shape[1]}").ravel(), sizes), _cut(worst[at], sizes)], schema=SHIPPED)

    asked = packs.select("part", column, *([also] if also else [])).mapInArrow(ask, "home long, part long, nodes binary")
    own = graph.select(part_of("node").alias("home"), "node", "code", "worst")
    return asked.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(answer, _ddl(SHIPPED))


def _unpacked(vectors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``shipped``: the nodes in order, each once, their codes, and their worst scores."""
    ids, worst = _blobs(vectors.column("nodes"), np.int64)[0], _blobs(vectors.column("worst"), np.float64)[0]
    codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1) if len(ids) else np.zeros((0, 12), np.uint8)
    ids, at = np.unique(ids, return_index=True)
    return ids, codes[at], worst[at]


def proposals(packs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Local joins of a part's centers: pairs of members, one of them new, nearer than the worst either has, as lists by part of the member."""
    if not len(packs) or not len(vectors):
        return LISTS.empty_table()
    ids, codes, worst = _unpacked(vectors)
    x, bias = _read(codes)
    sizes, member, fresh = (_blobs(packs.column(c), t)[0] for c, t in (("sizes", np.int64), ("members", np.int64), ("fresh", np.bool_)))
    member, begin = np.searchsorted(ids, member), np.cumsum(sizes) - sizes
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for i in range(0, len(sizes), AT_ONCE):
        own, width = sizes[i : i + AT_ONCE], int(sizes[i : i + AT_ONCE].max())
        at = begin[i : i + AT_ONCE, None] + np.arange(width)
        real = np.arange(width) < own[:, None]
        at = np.where(real, at, begin[i])
        m, new = member[at], fresh[at]
        y = x[m]
        s = y @ y.transpose(0, 2, 1) - bias[m][:, :, None] - bias[m][:, None, :]
        good = (s > worst[m][:, :, None]) & (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :]
        good[:, np.arange(width), np.arange(width)] = False
        c, a, b = np.nonzero(good)
        held.append((m[c, a], m[c, b], s[c, a, b]))
        n += len(c)
        if n > HELD:
            u, v, s = best_of(*(np.concatenate(z) for z in zip(*held, strict=True)), K)
            count = np.bincount(u, minlength=len(ids))
            last = np.cumsum(count) - 1
            full = count >= K
            worst[full] = np.maximum(worst[full], s[last[full]])
            held, n = [(u, v, s)], len(u)
    u, v, s = best_of(*(np.concatenate(z) for z in zip(*held, strict=True)), K)
    return _lists(ids[u], ids[v], s)


def descend(graph: DataFrame) -> DataFrame:
    """One round of NN-descent: the lists that the members of each neighbourhood propose to each other."""
    forward = edges(graph)
    rank = F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("fresh"), F.xxhash64("node", "nbr")))
    reverse = forward.withColumn("rank", rank).where(F.col("rank") <= K).select(F.col("nbr").alias("center"), F.col("node").alias("member"), "fresh")
    both = forward.select(F.col("node").alias("center"), F.col("nbr").alias("member"), "fresh").unionByName(reverse)
    packs = written(by_key(both.withColumn("part", part_of("center")), "part", packed, _ddl(PACKS), rows=1), "packs")
    vectors = shipped(packs, "members", graph)
    return packs.groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(proposals, _ddl(LISTS))


class Index:
    """Nodes with their original vectors, the copies of each, and the graph of lists and 16-bit vectors."""

    def __init__(self, nodes: DataFrame, copies: DataFrame, graph: DataFrame | None, size: int = 0, heads: DataFrame | None = None):
        self.nodes, self.copies, self.graph, self.size, self.heads, self.changes = nodes, copies, graph, size, heads, []


def build(vectors: DataFrame) -> Index:
    """Indexes every usable row of (vec_id, embedding)."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = written(rows, "vectors")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("embedding"))).alias("embedding")
    rows = rows.select("vec_id", filled).withColumn("h", F.xxhash64("embedding"))
    distinct = written(rows.groupBy("h", "embedding").agg(F.min("vec_id").alias("first_id")), "distinct")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, top, low = distinct.agg(F.count("*"), F.max(norm), F.min(norm)).first()
    if not n:
        return Index(distinct.withColumn("node", F.col("first_id")), rows.select("vec_id", F.col("vec_id").alias("node")), None)
    mean = mean_of(distinct, n)
    nodes = written(numbered(distinct, n, mean), "nodes")
    copies = written(rows.join(nodes.select("h", "embedding", "node"), ["h", "embedding"]).select("vec_id", "node"), "copies")
    heads = written(nodes.orderBy(norm.desc(), "node").limit(HEADS).select("node"), "heads") if low < 0.9 * top else None
    codes = written(coded(nodes, top, max(2, round(math.log2(n) / 4)), max(0, round(math.log2(n / CELL))), mean), "codes")
    join = lambda lists: written(by_key(lists, "part", merged, GRAPH, rows=1), "graph")
    graph = join(first_lists(codes).withColumn("known", F.lit(False)))
    index = Index(nodes, copies, graph, n, heads)
    while True:
        graph = join(lists_of(graph).withColumn("known", F.lit(True)).unionByName(descend(graph).withColumn("known", F.lit(False))))
        index.changes.append(graph.agg(F.sum("changes")).first()[0])
        if index.changes[-1] <= CHANGES * n * K:
            index.graph = graph
            return index


def _split(blob: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)


def walk(beams: pa.Table, lists: pa.Table) -> pa.Table:
    """Expands every node of each beam that wasn't: found has the neighbours that aren't in the beam."""
    near = dict(zip(lists.column("node").to_pylist(), lists.column("nbrs").to_pylist(), strict=True))
    done, found = [], []
    for ids, old in zip(beams.column("ids").to_pylist(), beams.column("done").to_pylist(), strict=True):
        ids, old = _split(ids), _split(old)
        new = ids[~np.isin(ids, old)]
        done.append(np.concatenate((old, new)).tobytes())
        found.append(np.setdiff1d(_split(b"".join([near[i] for i in new.tolist()])), ids).tobytes())
    return pa.Table.from_arrays([*(beams.column(c) for c in BEAMS.names[:4]), pa.array(done, pa.binary()), pa.array(found, pa.binary())], schema=BEAMS)


def widened(beam: int) -> Callable:
    """The best ``beam`` of each beam and what it found."""

    def run(beams: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(beams):
            return BEAMS.empty_table()
        known, codes, _ = _unpacked(vectors)
        x = _read(codes)[0] if len(known) else None
        ids, scores, done = [], [], []
        for query, own, s, old, found in zip(*(beams.column(c).to_pylist() for c in BEAMS.names[1:]), strict=True):
            if not found:
                ids.append(own)
                scores.append(s)
                done.append(old)
                continue
            found = _split(found)
            at = np.searchsorted(known, found)
            # Queries have no extra coordinate: the score is the inner product.
            more = x[at, :-1] @ x[np.searchsorted(known, query), :-1]
            keep = found != query
            own, s = np.concatenate((_split(own), found[keep])), np.concatenate((_split(s, np.float32), more[keep]))
            best = np.lexsort((own, -s))[:beam]
            ids.append(own[best].tobytes())
            scores.append(s[best].astype(np.float32).tobytes())
            old = _split(old)
            done.append(old[np.isin(old, own[best]) | (old == query)].tobytes())
        return pa.Table.from_arrays([beams.column("part"), beams.column("query"), pa.array(ids, pa.binary()), pa.array(scores, pa.binary()), pa.array(done, pa.binary()), pa.nulls(len(ids), pa.binary())], schema=BEAMS)

    return run


def frontier(beams: DataFrame) -> DataFrame:
    """(part, node) of the nodes of beams that weren't expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [np.setdiff1d(_split(i), _split(d)) for i, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            sizes = [len(x) for x in new]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.concatenate(new))], names=["part", "node"])

    return beams.select("part", "ids", "done").mapInArrow(run, "part long, node long")


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest found of each query (query_id, a vec_id of the index): query_id, rank, vec_id, score; never itself."""
    asked = queries.select("query_id").distinct().join(index.copies.select(F.col("vec_id").alias("query_id"), "node"), "query_id")
    if index.graph is None:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("node").alias("vec_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    beam, scored = max(SCORED * k, BEAM * math.ceil(math.log2(index.size + 1))), SCORED * k
    starts = written(asked.select("node").distinct(), "starts")
    part, nothing = part_of("node").alias("part"), F.lit(None).cast("binary")
    # A beam begins with the query itself (and the longest vectors) to be expanded.
    first = starts.select(part, F.col("node").alias("query"), "node")
    if index.heads is not None:
        first = first.unionByName(first.drop("node").join(F.broadcast(index.heads)))  # HEADS rows

    def begun(table: pa.Table) -> pa.Table:
        part, query, node = (table.column(c).to_numpy() for c in ("part", "query", "node"))
        order = np.lexsort((node, query))
        start = np.flatnonzero(np.concatenate(([True], query[order][1:] != query[order][:-1])))
        ids = _cut(node[order], np.diff(np.append(start, len(node))))
        empty = pa.array([b""] * len(start), pa.binary())
        return pa.Table.from_arrays([pa.array(part[order][start]), pa.array(query[order][start]), ids, empty, empty, pa.nulls(len(start), pa.binary())], schema=BEAMS)

    beams = written(by_key(first, "query", begun, _ddl(BEAMS)), "beams")
    graph = index.graph
    started = False
    while not frontier(beams).isEmpty():
        lists = frontier(beams).distinct().join(graph.select("node", "nbrs"), "node")
        asks = beams.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(walk, _ddl(BEAMS))
        if not started:  # the starts themselves have no score yet
            asks, started = asks.withColumns({"found": F.concat("found", "ids"), "ids": F.lit(b"")}), True
        asks = written(asks, "asks")
        walking = asks.where(F.length("found") > 0)
        vectors = shipped(walking, "found", graph, also="query")
        beams = written(asks.groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(widened(beam), _ddl(BEAMS)), "beams")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [_split(x)[:scored] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in best])), pa.array(np.concatenate([np.zeros(0, np.int64), *best]))], names=["query", "node"])

    candidates = beams.select("query", "ids").mapInArrow(ids_of, "query long, node long").unionByName(starts.select(F.col("node").alias("query"), "node"))
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = candidates.join(index.nodes.select("node", F.col("embedding").alias("a")), "node").join(index.nodes.select(F.col("node").alias("query"), F.col("embedding").alias("b")), "query").select("query", "node", exact.alias("score"))
    # Ties are broken by the smallest vec_id of the copies.
    pairs = pairs.join(index.nodes.select("node", "first_id"), "node")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_id"))).where(F.col("r") <= k + 1)
    few = index.copies.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("node", "vec_id")
    listed = asked.withColumnRenamed("node", "query").join(pairs.select("query", "node", "score"), "query").join(few, "node").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build(vectors), vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id")))


QUERIES = {"op6_neighbours": op6_neighbours}
