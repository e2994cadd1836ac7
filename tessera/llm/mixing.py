"""Mixing sources to target weights by Pareto order sampling.

1. Sources share a multiple of all words by weight.  No target exceeds CAP times its source's words; what is over goes to the others by weight
   until none is above.  Sorted by (cap / weight), running sums tell at once which sources are capped: no rounds.
2. Whole copies are certain: every document is taken floor(target / source words) times.
3. The rest of the target is drawn.  Documents of a source are cut into classes by size (leading four bits, so sizes of a class differ by an
   eighth at most).  From the largest class down, each gets a fixed number of draws for its share of the rest, and what rounding
   leaves over, in words, is carried to the next class: a source ends within a small document of its target.
4. Within a class, documents are drawn with probabilities in proportion to their size, p = draws x size / words of the class, by Pareto order
   sampling: of all documents the fixed number with the smallest [u / (1 - u)] / [p / (1 - p)] is taken, u a hash of id and text in (0, 1).
   A document whose p reaches one is certain and comes first.

A document is therefore taken floor(ratio) or one more times, at most CAP times its size.  The n smallest of a class are found without
bringing a class together: buckets of the order are counted, and only the bucket that the edge falls into is ranked.

Nothing is random but by hash: reruns agree, however rows are dealt.  Null and empty texts have no words and are never drawn (taken 0);
a null source is a source, the last one.  A null id is drawn by its text.  Repeated rows are drawn one by one; equal rows
are interchangeable.  Very long texts count by their words like all others.  An empty table, or one without words, has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import ranged, running

from .common import written

#: Weights of the sources in order, repeating; share of all words that the mix takes, in halves; most copies of a document.
WEIGHTS, HALVES, CAP = (5, 2, 1), 3, 2
#: Buckets of the order in which a class is drawn.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words, u in (0, 1) by a hash of id and text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), u.alias("u"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of every source; many sources are dealt by ranges, no task holds them all."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Nulls last, the others by code point, which is how Spark orders texts.
    keyed = sources.withColumn("key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")))
    placed = running(ranged(keyed.withColumn("one", F.lit(1).cast("long")), "key"), "key", {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    common = 1
    for w in WEIGHTS:
        common *= w
    filled = placed.select("source", "source_size", weight.alias("weight")).withColumns({"cap": CAP * F.col("source_size"), "fill": (F.col("source_size") * common / F.col("weight")).cast("long")})
    sums = running(ranged(filled, "fill"), "fill", {"cap_upto": "cap", "weight_upto": "weight"})
    sums = written(sums.select("source", "source_size", "weight", "cap", "cap_upto", "weight_upto"), "sources")
    whole = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weights"))
    big = lambda c: c.cast("decimal(19,0)")
    before, left = F.col("cap_upto") - F.col("cap"), F.col("all_weights") - F.col("weight_upto") + F.col("weight")
    # cap <= weight * (what is left of the mix) / (weights that are left), in whole numbers.
    capped = big(2 * F.col("cap")) * big(left) <= big(F.col("weight")) * big(HALVES * F.col("all_words") - 2 * before)
    told = sums.crossJoin(whole).withColumn("capped", capped)  # one row
    rest = told.agg(
        F.max(HALVES * F.col("all_words")).alias("halves"), F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("gone"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open")
    )
    share = F.col("weight").cast("double") * ((F.col("halves") - 2 * F.col("gone")) / 2.0) / F.col("open").cast("double")
    return told.crossJoin(rest).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def size_class(size: str) -> Column:
    """Larger with the size: its number of bits, then its three bits after the first."""
    return F.expr(f"length(bin({size})) * 16L + shiftright({size}, greatest(length(bin({size})) - 4, 0))")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def drawn(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(_source, _class, copies, draws, words): how many documents of each class are drawn, and the words of the class."""
    classes = sized.where("size > 0").groupBy("source", size_class("size").alias("class")).agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).alias("squares")
    )
    # A source has a few hundred classes at most: sixteen for each bit of a size.
    lists = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "n", "words", (F.col("squares").cast("double") / F.col("words")).alias("mean"))), asc=False).alias("classes"))
    goal = lists.join(goals.withColumnRenamed("source", "_source"), same("source", "_source"))
    copies = F.floor(F.col("target") / F.col("source_size"))
    share = (F.col("target") - copies * F.col("source_size")) / F.col("source_size")
    start = F.struct(F.lit(0.0).alias("carry"), F.expr("array() :: array<bigint>").alias("draws"))

    def step(state: Column, c: Column) -> Column:
        want = F.col("share") * c["words"] + state["carry"]
        draws = F.greatest(F.lit(0).cast("long"), F.least(c["n"], F.floor(want / c["mean"] + 0.5)))
        return F.struct((want - draws * c["mean"]).alias("carry"), F.concat(state["draws"], F.array(draws)).alias("draws"))

    rows = goal.select("source", copies.alias("copies"), share.alias("share"), "classes").withColumn("draws", F.aggregate("classes", start, step)["draws"])
    each = rows.select(F.col("source").alias("_source"), "copies", F.inline(F.arrays_zip("classes", "draws")))
    return each.select("_source", "copies", F.col("classes.class").alias("_class"), F.col("classes.words").alias("words"), "draws")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    sized = written(measured(docs), "sizes")
    goals = written(targets(sized), "targets")
    plan = written(drawn(sized, goals), "draws")
    p = F.least(F.lit(1.0), F.col("draws") * F.col("size") / F.col("words").cast("double"))
    order = (F.col("u") / (1.0 - F.col("u"))) * ((1.0 - F.col("p")) / F.col("p"))
    told = sized.withColumn("class", F.when(F.col("size") > 0, size_class("size"))).join(plan, same("source", "_source") & (F.col("class") == F.col("_class")), "left")
    told = told.withColumn("p", F.when(F.col("draws") > 0, p)).withColumn("order", order).withColumn("bucket", F.floor(BUCKETS * (F.col("order") / (1.0 + F.col("order")))))
    told = told.select("doc_id", "source", "size", "class", "copies", "draws", "order", "bucket")
    # The bucket of each class that the last draw falls into, and how many draws are left for it.
    counts = told.where("draws > 0").groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.first("draws").alias("draws"))
    upto = F.sum("n").over(Window.partitionBy("source", "class").orderBy("bucket"))  # BUCKETS rows at most
    edges = counts.withColumn("upto", upto).where("upto >= draws AND upto - n < draws")
    edges = written(edges.select(F.col("source").alias("_source"), F.col("class").alias("_class"), F.col("bucket").alias("edge"), (F.col("draws") - F.col("upto") + F.col("n")).alias("left")), "edges")
    ranked = told.join(edges, same("source", "_source") & (F.col("class") == F.col("_class")), "left").drop("_source", "_class")
    decided = ranked.where("edge IS NULL OR bucket <> edge").withColumn("extra", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    # Equal rows are one row with a count here, so that a row that is repeated without end is no large group.
    close = ranked.where("bucket = edge").groupBy("doc_id", "source", "size", "class", "copies", "order", "left").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "class").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    close = close.withColumn("got", F.col("left") - before).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("extra", (F.col("k") <= F.col("got")).cast("int"))
    columns = ["doc_id", "source", "size", "copies", "extra"]
    out = decided.select(*columns).unionByName(close.select(*columns)).join(goals.withColumnRenamed("source", "_source"), same("source", "_source"))
    copies = F.coalesce(F.col("copies"), F.lit(0)) + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_mixing": op13_mixing}
ORACLES = {
    "op13_mixing": r"""
WITH RECURSIVE sized AS MATERIALIZED (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents),
  weighed AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
  summed AS (SELECT *, 2 * source_size AS cap, sum(2 * source_size) OVER w AS cap_upto, sum(weight) OVER w AS weight_upto, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights
    FROM weighed WINDOW w AS (ORDER BY source_size * 10 // weight, source ROWS UNBOUNDED PRECEDING)),
  capped AS (SELECT *, 2 * cap * (all_weights - weight_upto + weight) <= weight * (3 * all_words - 2 * (cap_upto - cap)) AS capped FROM summed),
  goals AS MATERIALIZED (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE)
      * (CAST(3 * all_words - 2 * coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE) / 2::DOUBLE) / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM capped),
  classed AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM sized WHERE size > 0),
  classes AS MATERIALIZED (
    SELECT g.source, class, count(*) AS n, sum(size)::DOUBLE AS words, sum(size * size)::DOUBLE / sum(size)::DOUBLE AS mean, any_value(floor(target / source_size)) AS copies,
      any_value((target - floor(target / source_size) * source_size) / source_size) AS share, row_number() OVER (PARTITION BY g.source ORDER BY class DESC) AS k
    FROM classed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source GROUP BY g.source, class),
  walk AS (
    SELECT source, CAST(0 AS BIGINT) AS k, 0::DOUBLE AS carry, CAST(0 AS BIGINT) AS draws FROM (SELECT DISTINCT source FROM classes)
    UNION ALL
    SELECT source, k, want - draws * mean, draws FROM (
      SELECT *, CAST(greatest(0, least(n, floor(want / mean + 0.5::DOUBLE))) AS BIGINT) AS draws FROM (
        SELECT c.source, c.k, c.n, c.mean, c.share * c.words + w.carry AS want FROM walk w JOIN classes c ON c.source IS NOT DISTINCT FROM w.source AND c.k = w.k + 1))),
  odds AS (
    SELECT d.doc_id, d.source, d.size, d.class, d.u, c.copies, w.draws, least(1::DOUBLE, (w.draws * d.size)::DOUBLE / c.words) AS p
    FROM classed d JOIN classes c ON c.source IS NOT DISTINCT FROM d.source AND c.class = d.class JOIN walk w ON w.source IS NOT DISTINCT FROM c.source AND w.k = c.k),
  taken AS (
    SELECT doc_id, source, size, copies + CASE WHEN row_number() OVER (PARTITION BY source, class ORDER BY (u / (1::DOUBLE - u)) * ((1::DOUBLE - p) / p), doc_id) <= draws THEN 1 ELSE 0 END AS copies FROM odds
    UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0)
SELECT t.doc_id, t.source, t.size, g.source_size, g.target, CAST(t.copies AS INTEGER) AS copies, CAST(t.size * t.copies AS BIGINT) AS taken
FROM taken t JOIN goals g ON t.source IS NOT DISTINCT FROM g.source"""
}
