"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens that could be some.

Nodes are the white-space tokens that hold a digit or an @; labels are none and the four kinds.  Besides chain
potentials between neighbouring tokens, tokens of a document with the same or nearly the same content share skip
potentials, however far apart; loopy message passing makes labels agree across the whole document.  The unary
weights and both potentials are learned together, by pseudo-likelihood, from tokens that the patterns label, over a
bounded sample of documents.  Tokens that the field labels and no pattern covers become spans of kind crf_<kind>.

Texts are searched in time linear in their length.  Null and empty texts have no spans; null ids are passed through; repeated rows are searched one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPANS, SPANS_ARROW, Covered, map_batches, sample_by_key, span_digest

#: The base patterns, in the order in which kinds are listed.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

ANY = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
EDGE = " \t\n.,;:!?\"'<>[]{}|"
#: Training documents (about) and tokens of a training document's kind, passes of messages, certainty of a span.
TRAIN_DOCS, TRAIN_TOKENS, PASSES, CERTAIN = 20_000, 40_000, 8, 0.9
#: The bound of a pair potential.
PAIR = 3.0


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of LOCAL+ @ DOMAIN: around each @, so that long runs without one cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and LOCAL.match(text[s - 1]):
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            found.append((s, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of the base matches."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def features(tokens: list[str]) -> np.ndarray:
    """Shapes of the tokens of a document and of the tokens beside them."""
    own = np.zeros((len(tokens), 26))
    for i, t in enumerate(tokens):
        c = t.strip(EDGE)
        n, dots = sum(x.isdigit() for x in c), c.count(".")
        letters, runs = sum(x.isalpha() for x in c), len(re.findall(r"[0-9]+", c))
        bucket = 0 if n == 0 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 9 else 4 if n <= 13 else 5 if n <= 19 else 6
        own[i, bucket] = 1
        own[i, 7 + min(dots, 4)] = 1
        own[i, 12 + min(runs, 5)] = 1
        own[i, 18:26] = (letters == 0, 0 < letters <= 3, letters > 3, "@" in c, c.startswith("+"), "(" in t or ")" in t, "-" in c, bool(c) and c.replace(".", "").replace("-", "").isdigit())
    around = np.zeros((len(tokens), 8))
    around[1:, :4] = own[:-1][:, [1, 22, 23, 24]]
    around[:-1, 4:] = own[1:][:, [2, 22, 23, 24]]
    return np.concatenate((own, around, np.ones((len(tokens), 1))), 1)


WIDTH = 26 + 8 + 1


def graph(text: str) -> tuple[list[tuple[int, int]], list[str], np.ndarray, np.ndarray]:
    """Tokens that could be personal data (spans and texts), chain edges and skip edges between them.

    A token's likes are linked one to the next, so links grow with the tokens and yet join all of them.
    """
    spans, tokens, chain, seen, skip = [], [], [], {}, []
    last = -2
    for k, m in enumerate(TOKEN.finditer(text)):
        if not ANY.search(m[0]):
            continue
        i = len(tokens)
        if k - last == 1:
            chain.append((i - 1, i))
        last = k
        spans.append((m.start(), m.end()))
        tokens.append(m[0])
        plain = re.sub(r"[\W_]+", "", m[0].lower())
        keys = {plain, re.sub(r"[^0-9]", "", plain)} if sum(c.isdigit() for c in plain) >= 6 else {plain}
        for key in keys if len(plain) >= 4 else ():
            if key in seen:
                skip.append((seen[key], i))
            seen[key] = i
    pairs = lambda x: np.array(sorted(set(x)), dtype=np.int64).reshape(-1, 2)
    return spans, tokens, pairs(chain), pairs(skip)


def gold(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token by the first pattern that covers most of it, 0 for none; both in order of start."""
    y = np.zeros(len(spans), dtype=np.int64)
    near: list[tuple[int, int, int]] = []
    k = 0
    for i, (s, e) in enumerate(spans):
        while k < len(base) and base[k][0] < e:
            near.append(base[k])
            k += 1
        near = [x for x in near if x[2] > s]  # of each kind one at most goes on
        y[i] = next((kind + 1 for b, kind, f in near if min(e, f) - max(s, b) > 0.5 * (e - s)), 0)
    return y


@dataclass
class Field:
    """Log potentials: unary weights (WIDTH x labels), chain and skip (labels x labels)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    trained: bool

    def marginals(self, tokens: list[str], chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities of each token, by PASSES damped passes of loopy sum-product messages."""
        own = features(tokens) @ self.unary
        edges = np.concatenate((chain, skip))
        if len(edges):
            pot = np.concatenate((np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)))
            # Messages both ways: edge e goes from a to b, e + n back.
            a, b = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
            pot = np.concatenate((pot, pot.transpose(0, 2, 1)))
            n, msg = len(edges), np.zeros((2 * len(edges), len(LABELS)))
            back = np.concatenate((np.arange(n, 2 * n), np.arange(n)))
            for _ in range(PASSES):
                belief = own.copy()
                np.add.at(belief, b, msg)
                x = (belief[a] - msg[back])[:, :, None] + pot
                top = x.max(1, keepdims=True)
                new = (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
                msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
            own = own.copy()
            np.add.at(own, b, msg)
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 300) -> np.ndarray:
    """Multinomial logistic regression with row weights by gradient steps with momentum; L2 of 0.01 a row."""
    theta, speed = np.zeros((x.shape[1], len(LABELS))), 0.0
    target = np.eye(len(LABELS))[y]
    total = w.sum()
    for _ in range(steps):
        z = x @ theta
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ ((p - target) * w[:, None]) / total + 1e-4 * theta
        speed = 0.9 * speed - 0.5 * g
        theta = theta + speed
    return theta


def beside(edges: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many neighbours of each label every token has, two at most."""
    out = np.zeros((len(y), len(LABELS)))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(out, (edges[:, a], y[edges[:, b]]), 1)
    return np.minimum(out, 2)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_tokens: int = TRAIN_TOKENS) -> Field:
    """Learns unary weights and both pair potentials from about ``train_docs`` documents by the field's pseudo-likelihood.

    That is the likelihood of each token's label given its features and its neighbours' labels.  Tokens reach the driver
    as counts of distinct (features, labels beside, label), ``train_tokens`` of them at most, the most frequent ones.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple, int] = {}
        for text in batch.column(0).to_pylist():
            if not text or not ANY.search(text):
                continue
            spans, tokens, chain, skip = graph(text)
            y = gold(spans, base_spans(text))
            rows = np.concatenate((features(tokens), beside(chain, y), beside(skip, y)), 1).astype(np.uint8)
            for row, label in zip(rows, y, strict=True):
                key = (row.tobytes(), int(label))
                found[key] = found.get(key, 0) + 1
        columns = list(zip(*found, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["x", "y", "n"])

    sample = sample_by_key(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", train_docs).select("text")
    sums = map_batches(sample, count, "x binary, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    tokens = sums.orderBy(F.desc("n"), "x", "y").limit(train_tokens).collect()
    size = len(LABELS)
    if not tokens:
        return Field(np.zeros((WIDTH, size)), np.zeros((size, size)), np.zeros((size, size)), False)
    x = np.stack([np.frombuffer(r["x"], np.uint8) for r in tokens]).astype(float)
    theta = _logistic(x, np.array([r["y"] for r in tokens]), np.array([r["n"] for r in tokens], dtype=float))
    pair = lambda m: np.clip((m + m.T) / 2, -PAIR, PAIR)  # noqa: E731  (a potential has no direction)
    return Field(theta[:WIDTH], pair(theta[WIDTH : WIDTH + size]), pair(theta[WIDTH + size :]), True)


def find(text: str | None, model: Field) -> list[dict]:
    """All spans of a text by start, then kind as listed: base ones, and runs of tokens that only the field labels."""
    if not text or not ANY.search(text):
        return []
    base = base_spans(text)
    spans = [(s, k, e, 1.0) for s, k, e in base]
    if model.trained:
        places, tokens, chain, skip = graph(text)
        p = model.marginals(tokens, chain, skip)
        label, sure = p.argmax(1), p.max(1)
        linked = {(int(i), int(j)) for i, j in chain}
        covered = Covered([(s, e) for s, _, e in base])
        run: list | None = None
        for i, (s, e) in enumerate(places):
            if not label[i] or sure[i] < CERTAIN or covered.meets(s, e):
                run = None
                continue
            s += len(text[s:e]) - len(text[s:e].lstrip(EDGE))
            e = s + len(text[s:e].rstrip(EDGE))
            if run and run[1] == label[i] and (i - 1, i) in linked and KINDS[label[i] - 1] == "phone":
                run[2], run[3] = e, min(run[3], float(sure[i]))
            elif s < e:
                run = [s, label[i], e, float(sure[i])]
                spans.append(run)
            else:
                run = None
        spans = [tuple(x) if isinstance(x, tuple) else (x[0], x[1] + 3, x[2], x[3]) for x in spans]
    names = (*KINDS, *(f"crf_{k}" for k in KINDS))
    return [{"kind": names[int(k)], "start": s, "end": e, "score": x} for s, k, e, x in sorted(spans)]


def scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Per document: doc_id, spans (kind, start, end, score; code points, end exclusive)."""
    model = model or fit(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = pa.array([find(t, model) for t in batch.column(1).to_pylist()], SPANS_ARROW)
        return pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, spans {SPANS}")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS)


QUERIES = {"op4_personal_data": op4_personal_data}
