"""Secret scan: fixed patterns, and random strings told from identifiers by two character Markov models.

Two first-order character models, one of random strings (the values the patterns find) and one of
ordinary identifiers (other words, digits at most at their end), are counted by Spark over a bounded sample of labelled rows.  A
candidate token is a secret where the log-likelihood ratio of the two models, a character, is high.

Null and empty texts have no spans; null ids are passed through; repeated rows are scanned one by one; texts are scanned
in time linear in their length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPANS, SPANS_ARROW, Covered, map_batches, sample_by_key, span_digest

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
#: A cheap test before ASSIGN, which has no literal start.
HINTS = ("passw", "secret", "token", "api_key", "apikey")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
JOINT = re.compile(r"[+/_=-]+")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z_-]{6,}[0-9]{0,2}(?![A-Za-z0-9_-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, -1, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = _i
N = len(ALPHABET)

#: Training documents at most (about); LLR a character and in all from which a candidate is a secret.
TRAIN_DOCS, MIN_RATE, MIN_TOTAL = 20_000, 0.6, 15.0
#: Shorter tokens, and those of letters alone, must be as unlike words without their case and joints too.
LONG = 20
#: Rows whose texts are rewritten at once.
SLICE = 1_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, value) of the base matches."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(*values: str) -> np.ndarray:
    """Codes of neighbouring characters within each value."""
    codes = CODE[np.frombuffer(" ".join(values).encode("ascii", "ignore"), dtype=np.uint8)]
    pairs = codes[:-1] * N + codes[1:]
    return pairs[(codes[:-1] >= 0) & (codes[1:] >= 0)]


@dataclass
class MarkovPair:
    """LLR of a step from one character to the next: random against identifier. ``trained``: both have samples."""

    llr: np.ndarray
    trained: bool

    def score(self, value: str) -> float:
        return float(self.llr[_pairs(value)].sum())

    @staticmethod
    def of(random: np.ndarray, ident: np.ndarray) -> MarkovPair:
        """Counts of character pairs, shape (N * N).

        Pairs back off to single characters: of identifiers, and evenly for random strings, whose model is
        mixed with the even one, as the patterns find mostly hexadecimal values.
        """
        r, i = random.reshape(N, N), ident.reshape(N, N)
        single = (i.sum(0) + 0.02) / (i.sum() + 0.02 * N)
        p = 0.5 * (r + 5 / N) / (r.sum(1, keepdims=True) + 5) + 0.5 / N
        q = (i + 5 * single) / (i.sum(1, keepdims=True) + 5)
        return MarkovPair(np.log(p / q).ravel(), bool(random.sum() and ident.sum()))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> MarkovPair:
    """Counts pairs of characters in labelled samples of about ``train_docs`` documents: at most 2 x N x N sums reach the driver."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        random: list[str] = []
        ident: list[str] = []
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            base = base_spans(text)
            covered = Covered([(s, e) for s, _, e, _ in base])
            random += [v for *_, v in base if len(v) >= 16]
            ident += {m[0] for m in IDENTIFIER.finditer(text) if not covered.meets(m.start(), m.end())}
        sums = np.stack([np.bincount(_pairs(*x), minlength=N * N) for x in (random, ident)])
        label, pair = np.nonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(sums[label, pair])], names=["label", "pair", "n"])

    sample = sample_by_key(docs.select("doc_id", "text"), "doc_id", train_docs).select("text")
    sums = np.zeros((2, N * N))
    for r in map_batches(sample, count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        sums[r["label"], r["pair"]] = r["n"]
    return MarkovPair.of(sums[0], sums[1])


def find(text: str | None, model: MarkovPair) -> list[dict]:
    """All spans of a text by start, then kind as listed: the base ones, and random strings that overlap none of them."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(s, k, e, 0.0) for s, k, e, _ in base]
    covered = Covered([(s, e) for s, _, e, _ in base])
    if model.trained:
        for m in CANDIDATE.finditer(text):
            v = m[0]
            if covered.meets(m.start(), m.end()) or not any(c.isalpha() for c in v):
                continue
            score = model.score(v)
            if len(v) < LONG or v.isalpha():  # camel case, constants and paths are made of words
                score = min(score, model.score(JOINT.sub(" ", v.lower())))
            if score >= max(MIN_TOTAL, MIN_RATE * (len(v) - 1)):
                spans.append((m.start(), 3, m.end(), score))
    names = (*KINDS, "random")
    return [{"kind": names[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(spans)]


def scan(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """Per document: doc_id, spans (kind, start, end, score; code points, end exclusive)."""
    model = model or fit(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = pa.array([find(t, model) for t in batch.column(1).to_pylist()], SPANS_ARROW)
        return pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, model: MarkovPair | None = None, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by ``mark`` (overlapping spans as one) and ``n_chars`` recounted; columns stay."""
    model = model or fit(docs)

    def cleaned(text: str | None) -> str | None:
        out, at = [], 0
        for s in find(text, model):
            if s["start"] >= at:
                out += [text[at : s["start"]], mark]
            at = max(at, s["end"])
        return text if not out else "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                at = b.schema.get_field_index("text")
                texts = [cleaned(t) for t in b.column(at).to_pylist()]
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if (at := b.schema.get_field_index("n_chars")) >= 0:
                    b = b.set_column(at, b.schema.field(at), pa.array([None if t is None else len(t) for t in texts], b.schema.field(at).type))
                yield b

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS)


QUERIES = {"op1_secret_scan": op1_secret_scan}
