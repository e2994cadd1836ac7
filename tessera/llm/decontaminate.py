"""Benchmark decontamination in DataFrame operations only.

Words are lower-cased runs without white space, shingles five of them (items of fewer words are one shingle).
A document is contaminated by an item of n shingles if one of its windows of n shingles has a weighted
similarity of 0.75 or more with the item: the sum of smaller counts over the sum of larger counts.

1. Only windows that begin at a shingle of the item and hold at least 75 % of n such shingles can get there
   (moving a window's begin to its first shared shingle loses none); the others are dropped by counting, in time
   linear in the places of an item's shingles.  A filter of windows: which items they resemble is the index's to say.
2. The windows left, one for equal contents, get 64-bit SimHash fingerprints weighted by counts.
3. A multi-index over BLOCKS blocks finds, among all items of a window's size, those within RADIUS bits: of RADIUS flips, one block
   has FLIPS at most, so items are indexed under all values within FLIPS of each block.  A similarity
   of 0.75 turns 11 bits on average (deviation 3), so RADIUS lies four deviations above.
4. Candidates are verified with exact counts.

Null or empty texts and items match nothing.  Null ids are kept apart by a hash of the text; equal rows count once.
A very long text is one row of places for each item whose shingles it holds, as many as its words at most.  Of windows
with equal similarity the first is given.  Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE, SIMILARITY = 5, 0.75
BLOCKS, WIDTH, FLIPS, RADIUS = 8, 8, 2, 23
#: Shingles of a benchmark up to which they are broadcast (about 40 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
FLIPPED = [x for x in range(1 << WIDTH) if x.bit_count() <= FLIPS]


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of the ``size``-word shingles of an array of word hashes, in order."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at)).otherwise(F.array().cast("array<long>"))


def fingerprints(rows: DataFrame, *key: str) -> DataFrame:
    """SimHash of exploded shingles ``h`` by ``key``: a bit is set where most shingles have it."""
    ones = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n_h"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return rows.groupBy(*key).agg(F.count("*").alias("n_h"), *ones).select(*key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def blocks(fp: str) -> Column:
    """(block, value) of each block of a fingerprint."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftright(fp, b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").alias("value")) for b in range(BLOCKS)])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, similarity, first_word, n_shingles, text_key."""
    spark = docs.sparkSession
    item_words = benchmark.select(F.col("item_id").cast("long"), word_hashes(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    item_words = item_words.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    sizes = sorted(r["k"] for r in item_words.select("k").distinct().collect())  # five values at most
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, first_word int, n_shingles int, text_key long")

    def shingled(rows: DataFrame, k: int) -> DataFrame:
        words = rows.select("doc_id", "text_key", word_hashes(F.col("text")).alias("words"))
        return words.select("doc_id", "text_key", shingle_hashes("words", k).alias("shingles"))

    items = written(reduce(DataFrame.unionByName, [item_words.where(F.col("k") == k).select("item_id", "k", shingle_hashes("words", k).alias("shingles")) for k in sizes]).withColumn("n", F.size("shingles")), "items")
    counted = items.select("item_id", "k", "n", F.explode("shingles").alias("h")).groupBy("item_id", "k", "n", "h").agg(F.count("*").alias("c"))
    counted = written(counted, "item-shingles")
    small = counted.count() <= BROADCAST_ROWS

    found = []
    for k in sizes:
        own = counted.where(F.col("k") == k).select("h", "item_id", "n")
        # Outer: the filter that a plain explode implies would be pushed into the scan, and split each text again for every shingle.
        places = shingled(texts, k).select("doc_id", "text_key", F.size("shingles").alias("m"), F.posexplode_outer("shingles").alias("pos", "h"))
        hits = places.join(F.broadcast(own) if small else own, "h")
        # The places of an item's shingles in a document: as many as its words at most.
        near = hits.groupBy("doc_id", "text_key", "item_id", "n", "m").agg(F.sort_array(F.collect_set("pos")).alias("places")).where(F.size("places") >= SIMILARITY * F.col("n"))
        # Places are in order: the window that begins at one holds enough if the place that makes it enough lies within it.
        n, last = F.col("n"), F.greatest(F.lit(0), F.col("m") - F.col("n"))
        enough = F.ceil(SIMILARITY * n).cast("int")
        whole = F.transform("places", lambda p, i: F.when((p <= last) & (F.get("places", i + enough - 1) < p + n), p))
        tail = F.when(F.size(F.filter("places", lambda p: p >= last)) >= enough, last)
        begins = near.withColumn("first_word", F.explode(F.array_distinct(F.array_compact(F.concat(whole, F.array(tail))))))
        found.append(begins.select("doc_id", "text_key", F.lit(k).alias("k"), "n", "first_word", (F.col("first_word") == last).alias("is_last")))
    begins = written(reduce(DataFrame.unionByName, found).distinct(), "begins")

    # The shingles of the windows: only of documents that have one.
    wanted = begins.select("text_key").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    again = texts.join(F.broadcast(wanted) if few else wanted, "text_key", "left_semi")
    arrays = reduce(DataFrame.unionByName, [shingled(again, k).dropDuplicates(["text_key", "doc_id"]).withColumn("k", F.lit(k)) for k in sizes])
    same = [arrays[c].eqNullSafe(begins[c]) for c in ("text_key", "doc_id", "k")]
    windows = begins.join(arrays, same).select(begins["doc_id"], begins["text_key"], begins["k"], "n", "first_word", "is_last", F.slice("shingles", F.col("first_word") + 1, F.col("n")).alias("window"))
    windows = written(windows.withColumns({"w1": F.xxhash64("window"), "w2": F.hash("window")}), "windows")
    distinct = windows.groupBy("w1", "w2", "k", "n").agg(F.first("window").alias("window"))
    exploded = written(distinct.select("w1", "w2", "k", "n", F.size("window").alias("n_window"), F.get("window", F.lit(0)).alias("h0"), F.explode("window").alias("h")), "window-shingles")

    window_prints = fingerprints(exploded, "w1", "w2", "k", "n", "n_window").withColumn("at", F.explode(blocks("fp")))
    flipped = F.explode(F.array(*[F.lit(x) for x in FLIPPED]))
    item_prints = fingerprints(items.select("item_id", "k", "n", F.explode("shingles").alias("h")), "item_id", "k", "n").withColumn("at", F.explode(blocks("fp")))
    index = item_prints.withColumn("flip", flipped).select("item_id", "k", "n", F.col("fp").alias("item_fp"), F.col("at.block").alias("block"), F.col("at.value").bitwiseXOR(F.col("flip")).alias("value"))
    # The index alone says which items a window is compared with: equal blocks among all items of its size.
    probes = window_prints.select("w1", "w2", "k", "n", "n_window", "fp", F.col("at.block").alias("block"), F.col("at.value").alias("value"))
    pairs = probes.join(index, ["k", "n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("w1", "w2", "k", "n", "n_window", "item_id").distinct()

    weights = exploded.groupBy("w1", "w2", "k", "n", "h").agg(F.count("*").alias("cw"), F.max(F.col("h") == F.col("h0")).alias("at_begin"))
    common = pairs.join(weights, ["w1", "w2", "k", "n"]).join(counted, ["item_id", "k", "n", "h"]).groupBy("w1", "w2", "k", "n", "n_window", "item_id").agg(F.sum(F.least("c", "cw")).alias("common"), F.max("at_begin").alias("at_begin"))
    union = F.col("n") + F.col("n_window") - F.col("common")
    verified = common.where(F.col("common") >= SIMILARITY * union).withColumn("similarity", F.col("common") / union)
    # Of equal windows the one that begins with a shingle of the item counts, or the document's last one.
    best = windows.drop("window").join(verified, ["w1", "w2", "k", "n"]).where("at_begin OR is_last").groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("first_word")).alias("at"), "n")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).cast("int").alias("first_word"), F.col("best.n").alias("n_shingles"), "text_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item of the benchmark; the columns stay."""
    bad = contaminated(docs, benchmark).select(F.col("text_key").alias("bad_key")).distinct()
    return docs.join(bad, F.xxhash64(F.col("text").cast("string")) == F.col("bad_key"), "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_shingles")


QUERIES = {"op8_decontaminate": op8_decontaminate}
_WORDS = r"list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
ORACLES = {
    "op8_decontaminate": rf"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 5) AS k, list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda x: array_to_string(w[x:x + least(len(w), 5) - 1], ' ')) AS s FROM iw WHERE len(w) > 0),
ic AS (SELECT item_id, k, n, h, count(*) AS c FROM (SELECT item_id, k, len(s) AS n, unnest(s) AS h FROM i) GROUP BY ALL),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ks AS (SELECT DISTINCT k FROM i),
d AS (SELECT doc_id, k, list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' ')) AS s FROM dw, ks WHERE len(w) >= k),
p AS (SELECT doc_id, k, len(s) AS m, unnest(s) AS h, unnest(range(len(s))) AS pos FROM d),
hit AS (SELECT DISTINCT doc_id, item_id, p.k, n, m, pos FROM p JOIN ic ON p.h = ic.h AND p.k = ic.k),
near AS (SELECT doc_id, item_id, k, n, m, list(pos) AS places FROM hit GROUP BY ALL HAVING count(*) >= 0.75 * n),
b AS (SELECT DISTINCT doc_id, item_id, k, n, m, least(x, greatest(0, m - n)) AS first_word FROM (SELECT *, unnest(places) AS x FROM near)),
wc AS (SELECT b.doc_id, b.item_id, b.k, b.n, b.m, b.first_word, p.h, count(*) AS c FROM b JOIN p ON p.doc_id = b.doc_id AND p.k = b.k AND p.pos >= b.first_word AND p.pos < b.first_word + b.n GROUP BY ALL),
v AS (SELECT wc.doc_id, wc.item_id, wc.n, wc.first_word, sum(least(wc.c, ic.c)) AS common, least(wc.n, wc.m) AS nw FROM wc JOIN ic ON ic.item_id = wc.item_id AND ic.k = wc.k AND ic.h = wc.h GROUP BY ALL),
g AS (SELECT doc_id, item_id, n, first_word, common::DOUBLE / (n + nw - common) AS sim FROM v WHERE common >= 0.75 * (n + nw - common)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, first_word) AS rn FROM g)
SELECT doc_id, item_id, round(sim, 6) AS similarity, first_word::INT AS first_word, n::INT AS n_shingles FROM r WHERE rn = 1
"""
}
