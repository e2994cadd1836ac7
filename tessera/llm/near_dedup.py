"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct 5-word shingles (hashed to 64 bits).  Its sketch has BINS coordinates:
in round i each shingle is placed in one hashed bin with the value (i, hash), and the rounds end once every
bin is filled; from round BINS on, round i fills bin i - BINS alone, so all bins are filled for certain.
BANDS bands of ROWS coordinates make buckets: a pair of similarity 0.75 shares none with probability
(1 - 0.75^4)^32, 5 in a million; more similar pairs less: a stated recall of at least 0.99999 a pair, and higher for a
group, whose members need one path only.  Candidates are confirmed on full sets.

Equal sets become one node first, so a group of copies costs one.  Within a bucket every node is first confirmed
against a leader, then against LEADERS others, and links merge components: this unites large groups of near
copies in linear time.  Buckets that still hold two components are cut in chunks; each pair of chunks is one
piece of work, which compares 8 bits of each coordinate of nodes in different components and hands on only pairs
with MIN_EQUAL equal ones (a pair of similarity 0.75 has 96 on average, deviation 5, and falls below with a
chance of 3 in a million) whose shingles, cut to 16 bits, could be similar enough.  Each pair of a bucket is thus confirmed, refuted or already in one component.

Texts that are null or without words have empty sets and are linked with nothing.  Null ids never become the
component of others while another id is there; repeated rows share their set and so their component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_key, map_batches, written
from .graph import components

SHINGLE, BINS, BANDS, ROWS = 5, 128, 32, 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Leaders of a bucket in the second round, nodes of a chunk, coordinates that candidates of the last round share.
LEADERS, CHUNK, MIN_EQUAL = 4, 256, 74
#: Ids up to which those of candidates are broadcast (about 30 bytes each) to read their texts; beyond, the join shuffles.
BROADCAST_IDS = 500_000
U = np.uint64
ODD = (np.random.default_rng(7).integers(1, 1 << 63, size=8, dtype=np.uint64) << U(1)) | U(1)
SEEDS = np.random.default_rng(11).integers(0, 1 << 63, size=2 * BINS, dtype=np.uint64)
FULL = U((1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of the whole sequence, if it is shorter."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * ODD[i]
    return np.unique(mixed(s))


def sketch(s: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set that isn't empty: the round in the top 8 bits, then the smallest hash of the bin."""
    out = np.full(BINS, FULL)
    at = 0
    while at < BINS and out.max() == FULL:
        k = min(BINS - at, max(1, 400 // len(s)))
        x = mixed((s[None, :] ^ SEEDS[at : at + k, None]) * ODD[7])
        v = (x >> U(8)) | (np.arange(at, at + k, dtype=np.uint64) << U(56))[:, None]
        np.minimum.at(out, (x & U(BINS - 1)).astype(np.intp).ravel(), v.ravel())
        at += k
    for b in np.flatnonzero(out == FULL):
        out[b] = (mixed((s ^ SEEDS[BINS + b]) * ODD[7]) >> U(8)).min() | U((BINS + int(b)) << 56)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    return mixed((rows * ODD[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64) * ODD[5]).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, fp (128 bits of the set; null if empty), bands, short (8 bits of each coordinate)."""
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, fp, own, short = [], [], [], []
        for text in batch.column(2):
            s = shingles(text.as_py(), hashes)
            n.append(len(s))
            fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            coordinates = sketch(s) if len(s) else None
            own.append(bands(coordinates) if len(s) else None)
            short.append((coordinates & U(255)).astype(np.uint8).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(own, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["doc_id", "key", "n_shingles", "fp", "bands", "short"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string")), run, "doc_id long, key long, n_shingles long, fp binary, bands array<long>, short binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """fp, the sorted shingles of every document with words, and 16 bits of each."""
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x for t in batch.column(0) if len(x := shingles(t.as_py(), hashes))]
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([(s & U(0xFFFF)).astype(np.uint16).tobytes() for s in sets], pa.binary())], names=["fp", "shingles", "tiny"])

    return map_batches(docs.select(F.col("text").cast("string")), run, "fp binary, shingles array<long>, tiny binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(two, "b").join(one, "a")
    common, na, nb = F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb")
    return both.where(100 * common >= PERCENT * (na + nb - common)).select("a", "b")


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """Candidates (a, b, ca, cb) among rows of (bucket, k, node, n, component, short, bands, tiny), k being the bucket's rows.

    A pair is compared in its first common bucket alone.  (Where that one is closed, or had one of the two as a
    leader, the pair is in one component or tested.)  Pairs handed on are those whose sets, cut to 16 bits a shingle,
    could reach the similarity: cutting adds common shingles and loses none.
    """
    chunks = F.ceil(F.col("k") / CHUNK).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    work = rows.withColumn("other", other).select(F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("work"), "bucket", "chunk", "node", "n", "component", "short", "bands", "tiny")

    def compare(table: pa.Table) -> pa.Table:
        key, bucket, chunk, node, n, component = (table.column(c).to_numpy() for c in ("work", "bucket", "chunk", "node", "n", "component"))
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        own = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        tiny = table.column("tiny").to_pylist()
        flat, upto = np.frombuffer(b"".join(tiny), dtype=np.uint16), np.cumsum([0, *(len(x) // 2 for x in tiny)])
        holds = np.zeros(1 << 16, dtype=bool)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        found = []
        for i, j in zip(start, np.append(start[1:], len(key)), strict=True):
            across = (chunk[i:j] != chunk[i]).any()  # pairs within a chunk have their own piece of work
            for at in range(i, j, CHUNK):
                to = min(at + CHUNK, j)
                fits = (node[at:to, None] < node[None, i:j]) & (component[at:to, None] != component[None, i:j])
                fits &= PERCENT * np.maximum(n[at:to, None], n[None, i:j]) <= 100 * np.minimum(n[at:to, None], n[None, i:j])
                if across:
                    fits &= chunk[at:to, None] != chunk[None, i:j]
                a, b = np.nonzero(fits)
                for k in range(0, len(a), 20_000):
                    x, y = a[k : k + 20_000] + at, b[k : k + 20_000] + i
                    first = (own[x] == own[y]).argmax(1)
                    keep = own[x, first] == bucket[i]
                    x, y = x[keep], y[keep]
                    keep = (short[x] == short[y]).sum(1) >= MIN_EQUAL
                    x, y = x[keep], y[keep]
                    if not len(x):
                        continue
                    # Candidates of one node at a time: its shingles in a table, those of all others looked up there.
                    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                    for p, q in zip(cuts, np.append(cuts[1:], len(x)), strict=True):
                        mine = flat[upto[x[p]] : upto[x[p] + 1]]
                        holds[mine] = True
                        theirs = np.concatenate([flat[upto[r] : upto[r + 1]] for r in y[p:q]])
                        sizes = upto[y[p:q] + 1] - upto[y[p:q]]
                        common = np.add.reduceat(holds[theirs].astype(np.int64), np.cumsum(sizes) - sizes)
                        holds[mine] = False
                        good = 100 * common >= PERCENT * (n[x[p]] + n[y[p:q]] - common)
                        found.append((x[p:q][good], y[p:q][good]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": node[a], "b": node[b], "ca": component[a], "cb": component[b]})

    return by_key(work, "work", compare, "a long, b long, ca long, cb long").dropDuplicates(["a", "b"])


def linked(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, key (of the text), n_shingles, fp, component (null without words), component_id (the smallest doc_id reachable), n_same_set."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(sketched(docs), "sketches")
    distinct = rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same_set"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    # Nodes are numbered in the order of their smallest id: originals tend to lead their copies.
    nodes = written(distinct.orderBy("first_id").withColumn("node", F.monotonically_increasing_id()), "nodes")

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    shared = written(members.join(crowded, "bucket").join(nodes.select("node", "n"), "node"), "buckets")
    wanted = shared.select("node").distinct().join(nodes, "node").select("node", "fp", "first_id")
    ids = written(wanted.select("first_id").distinct(), "wanted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = written(full_sets(texts).join(wanted.select("fp", "node"), "fp").select("node", "shingles", "tiny").dropDuplicates(["node"]), "sets")

    merged = nodes.select("node", F.col("node").alias("component"))
    open_rows, tested = shared.withColumn("component", F.col("node")), None
    for leaders in (1, LEADERS, None):
        if leaders:
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
            heads = open_rows.withColumn("rank", rank).where(F.col("rank") <= leaders).select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
            sizes = PERCENT * F.greatest("n", "na") <= 100 * F.least("n", "na")
            pairs = open_rows.join(heads, "bucket").where((F.col("node") > F.col("a")) & (F.col("component") != F.col("ca")) & sizes).select("a", F.col("node").alias("b"), "ca", F.col("component").alias("cb")).dropDuplicates(["a", "b"])
        else:
            pairs = chunk_pairs(open_rows.join(nodes.select("node", "short", "bands"), "node").join(sets.select("node", "tiny"), "node"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        confirmed = similar(pairs.select("a", "b"), sets)
        links = pairs.join(confirmed, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moves = components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
        step = lambda df: df.join(moves, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
        merged = written(step(merged), "merged")
        if not leaders:
            break
        # Leaders have met all of their bucket; buckets of one component have nothing left to find.
        rest = step(open_rows.join(heads.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti"))
        several = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("bucket", "k")
        open_rows = written(rest.drop("k").join(several, "bucket"), "open")
        if open_rows.isEmpty():
            break
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
    ids = nodes.join(merged, "node")
    low = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = ids.join(low, "component").select("fp", "component", "component_id", "n_same_set")
    return rows.select("doc_id", "key", "n_shingles", "fp").join(found, "fp", "left")


def link(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept, n_same_set."""
    out = linked(docs)
    component = F.when(F.col("fp").isNull() | F.col("doc_id").isNull() & F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id").eqNullSafe(component), F.lit(False)).alias("kept"), F.coalesce("n_same_set", F.lit(1)).cast("long").alias("n_same_set"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group stays, and every row without words; the columns stay.

    It is the row of the smallest id (null ids last, then by the text's hash); of rows repeated with that id and text one stays.
    Rows are told apart by id and text, so that a row that shares a dropped one's id but not its text isn't dropped with it.
    """
    rows = written(linked(docs).where(F.col("component").isNotNull()).select("doc_id", "key", "component"), "linked")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    told = written(rows.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n")).join(best, "component").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), kept.alias("kept"), "n"), "told")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    out = docs.join(told.where(~F.col("kept")), same, "left_anti")
    repeated = told.where(F.col("kept") & (F.col("n") > 1)).select("_id", "_key")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    once = out.join(repeated, same).dropDuplicates(["_id", "_key"]).select(*docs.columns)
    return out.join(repeated, same, "left_anti").select(*docs.columns).unionByName(once)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
