"""Language identification by word-first backoff.

A known word scores each language by the log of its smoothed relative frequency there; an unseen word
falls back to its character n-grams, the longest order with a known gram first.  Counts come from Spark
aggregations over labelled rows.

Null texts and texts without a letter are ``und`` with score 0; null ids are passed through; rows with
a null language are predicted but never learned from; repeated rows are predicted one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sample_by_key, written

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: The bounds of the model: labelled documents (about), words and grams of an order kept for a language.
TRAIN_DOCS, WORDS, GRAMS = 20_000, 40_000, 10_000
#: Words, and grams of an order, of all languages together: with many languages each keeps fewer.
ENTRIES = 1_000_000
#: Counts that a training task holds before it hands them on.
FLUSH = 300_000
#: The evidence of a text counts as that of so many words at most, so that scores stay apart from 1.
EVIDENCE = 25
MIN_SCORE = 0.5


def held_out():
    """The rows that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; other signs that count as parts of words (superscripts, fractions) split them."""
    found = WORD.findall(text.lower())
    if "".join(found).isalpha():
        return found
    return [x for w in found for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


@dataclass
class Backoff:
    """Log frequencies by language: a row for each word and each gram, which holds only the languages that have it.

    ``begin[i]`` to ``begin[i + 1]`` are the entries of row i: a language and how much its log frequency lies above that of
    an unseen row of the same order.
    """

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    begin: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    order: np.ndarray
    unseen: np.ndarray
    cache: dict[str, list[int]] = field(default_factory=dict)

    def rows_of(self, word: str) -> list[int]:
        """The rows of an unseen word: its known grams of the longest order that has any."""
        if (out := self.cache.get(word)) is None:
            out = []
            for n in ORDERS:
                if out := [i for g in grams(word, n) if (i := self.grams.get(g)) is not None]:
                    break
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = out
        return out

    def evidence(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the rows' log frequencies, by language."""
        first, many = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        seen = np.bincount(self.lang[at], weights=self.above[at] * np.repeat(weights, many), minlength=len(self.languages))
        return seen + np.bincount(self.order[rows], weights=weights, minlength=len(self.unseen)) @ self.unseen

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else None
        if not found or not self.languages:
            return "und", 0.0
        rows, weights, seen = [], [], 0
        for word, n in Counter(found).items():
            if (i := self.words.get(word)) is not None:
                rows.append(i)
                weights.append(n)
                seen += n
            elif own := self.rows_of(word):
                rows += own
                weights += [n / len(own)] * len(own)
                seen += n
        total = self.evidence(np.array(rows), np.array(weights, dtype=float)) if rows else np.zeros(len(self.languages))
        if seen > EVIDENCE:
            total *= EVIDENCE / seen
        p = np.exp(total - total.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def _summed(df: DataFrame, add: Callable[[Counter, pa.RecordBatch], None]) -> DataFrame:
    """Sums by (lang, order, gram) of what ``add`` counts: in the task until FLUSH keys, then by Spark."""

    def out(found: Counter) -> pa.RecordBatch:
        keys = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "order", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            add(found, batch)
            if len(found) > FLUSH:
                yield out(found)
                found = Counter()
        yield out(found)

    return df.mapInArrow(run, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))


def _add_words(found: Counter, batch: pa.RecordBatch) -> None:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            for word, n in Counter(words_of(text)).items():
                found[lang, 0, word] += n


def _add_grams(found: Counter, batch: pa.RecordBatch) -> None:
    for lang, word, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        for n in ORDERS:
            for g in grams(word, n):
                found[lang, n, g] += count


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, words: int = WORDS, top_grams: int = GRAMS) -> Backoff:
    """Learns from text and non-null lang of about ``train_docs`` documents that are not held out.

    The model is bounded: the ``words`` most frequent words and ``top_grams`` most frequent grams of
    each order for a language, fewer where languages are many (there are no more of them than sampled documents), so collecting it is safe.
    """
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & ~held_out())
    words_seen = written(_summed(sample_by_key(usable, "doc_id", train_docs).select("lang", "text"), _add_words), "words")
    both = written(words_seen.unionByName(_summed(words_seen.select("lang", "gram", "n"), _add_grams)), "grams")
    total = {(r["order"], r["lang"]): r["n"] for r in both.groupBy("lang", "order").agg(F.sum("n").alias("n")).collect()}
    rank = Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram")
    per_lang = {lang: n for (order, lang), n in total.items() if order == 0}
    languages = sorted(per_lang)  # no more than the sample has documents
    words, top_grams = (min(x, max(1, ENTRIES // max(1, len(languages)))) for x in (words, top_grams))
    best = [x.select("*", F.row_number().over(rank).alias("k")).where(F.col("k") <= k).drop("k") for x, k in ((both.where("order = 0"), words), (both.where("order > 0"), top_grams))]
    found = best[0].unionByName(best[1]).toArrow().to_pydict()

    at = {x: i for i, x in enumerate(languages)}
    index: tuple[dict[str, int], dict[str, int]] = ({}, {})
    rows = []
    for lang, order, gram, n in zip(*(found[c] for c in ("lang", "order", "gram", "n")), strict=True):
        if lang in at:
            own = index[order > 0]
            rows.append((own.setdefault(gram, len(own)), order, at[lang], n))
    # Words come first; grams follow.
    size, n_rows = len(index[0]), len(index[0]) + len(index[1])
    smooth = 0.5 * max(1, size)
    denominator = np.array([[total.get((o, x), 0) for x in languages] for o in range(max(ORDERS) + 1)], dtype=float).reshape(max(ORDERS) + 1, len(languages))
    row, order, lang, n = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    row = row + size * (order > 0)
    sort = np.argsort(row, kind="stable")
    row, order, lang, n = row[sort], order[sort], lang[sort], n[sort]
    order_of = np.zeros(n_rows, dtype=np.int64)
    order_of[row] = order
    begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows)))).astype(np.int64)
    # log((n + 0.5) / d) lies log(2 n + 1) above log(0.5 / d), whatever d is.
    return Backoff(languages, index[0], {g: i + size for g, i in index[1].items()}, begin, lang.astype(np.int32), np.log(2.0 * n + 1).astype(np.float32), order_of, np.log(0.5 / (denominator + smooth)))


def identify(docs: DataFrame, model: Backoff | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the winner's share of the evidence)."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, model: Backoff | None = None) -> DataFrame:
    """Documents whose language is found with ``min_score`` at least; the columns stay."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def sure(texts):
        found = [shared.value.predict(None if t is None else str(t)) for t in texts]
        return texts.__class__([-1.0 if lang == "und" else x for lang, x in found])

    return docs.where(sure(F.col("text").cast("string")) >= F.lit(min_score))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_language_id": op5_language_id}
