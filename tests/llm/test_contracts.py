"""Every opN query on the smallest table, against plain versions of its contract; and the cases that all of them must bear."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import brute_components, brute_cut

import __spark_entry__
from tessera.llm import html, language, packing, pii, secrets, warc


@pytest.fixture(scope="module")
def queries():
    return __spark_entry__.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)).encode()).hexdigest()


def found(kinds, text):
    """Leftmost matches of the patterns of the contract, those that fail their test dropped."""
    out = []
    for i, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text or "") if good(m)]
    return out


def luhn(m):
    d = [int(c) for c in m[0] if c.isdigit()][::-1]
    return 14 <= len(d) <= 19 and sum(d[::2] + [x // 5 + 2 * x % 10 if x >= 5 else 2 * x for x in d[1::2]]) % 10 == 0


SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m[0]) <= 15),
)


@pytest.mark.parametrize(("name", "kinds"), [("op1_secret_scan", SECRETS), ("op4_personal_data", PERSONAL)])
def test_spans(spark, queries, docs, name, kinds):
    rows = queries[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want = found(kinds, docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == digest(want)
        assert all(r[f"n_{k}"] == sum(x[3] == k for x in want) for k, _, _ in kinds)
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert spans == sorted(spans, key=lambda x: int(x[1])) and {f"{k}:{s}:{e}" for s, _, e, k in want} <= {":".join(x) for x in spans}


def test_near_dedup(spark, queries, docs):
    rows = {r["doc_id"]: r for r in queries["op2_near_dedup"](spark, SF).collect()}
    want = brute_components([(i, d["text"]) for i, d in docs.items()])
    assert {i: r["component_id"] for i, r in rows.items()} == want and all(r["kept"] == (i == want[i]) for i, r in rows.items())


def test_warc(spark, queries):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    rows = queries["op3_warc"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r["page_id"]]
        again = len(body) >= 100 and first[body] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None)


def test_language(spark, queries, docs):
    rows = queries["op5_language_id"](spark, SF).collect()
    known = {d["lang"] for d in docs.values() if d["lang"]}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known if any(c.isalpha() for c in d["text"] or "") else r["lang_pred"] == "und"
    own = [(docs[r["doc_id"]]["lang"], r["lang_pred"]) for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([a == b for a, b in own]) >= 0.95


def test_neighbours(spark, queries):
    v = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] and np.isfinite(np.array(r["embedding"], float)).all() and np.any(np.array(r["embedding"], float))]
    ids, x = np.array([r["vec_id"] for r in v]), np.array([r["embedding"] for r in v], float)
    got = defaultdict(list)
    for r in queries["op6_neighbours"](spark, SF).collect():
        got[r["query_id"]].append(r)
    share = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        rows = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-9 for r in rows)
        s[ids == q] = -np.inf
        share.append(len({r["vec_id"] for r in rows} & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(share) >= 0.9


def test_html(spark, queries):
    """Columns, white space and the titles of the given pages; whole texts are held in test_vectors."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries["op7_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) and r["url"] == pages[r["page_id"]]["url"]
        body = pages[r["page_id"]]["html"] or ""
        if body.count("<article") == 1 and "</article>" in body:
            inner = re.sub(r"<(?!/?(?:p|h1|b|i|em|a|strong)\b)", "<", body.split("<article", 1)[1].split(">", 1)[1].split("</article>")[0])
            title = re.search(r"<h1>(.*?)</h1>", inner)
            if title:
                assert " ".join(html.entities.unescape(title[1]).split()) in r["text"]


def test_packing(spark, queries, docs):
    rows = queries["op9_best_fit_packing"](spark, SF).collect()
    words = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        words[r["doc_id"]] += r["n_words"]
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    assert dict(words) == {i: len((d["text"] or "").encode().lower().split()) for i, d in docs.items()}
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert len({r["source"] for r in own}) == len(own) or any(r["source"] is None for r in own)
        assert all(a["bin_offset"] + a["n_words"] + 1 <= b["bin_offset"] for a, b in zip(own, own[1:])) and own[-1]["bin_offset"] + own[-1]["n_words"] <= packing.CAPACITY


def test_suffix(spark, queries, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries["op10_suffix_dedup"](spark, SF).collect()}
    assert got == brute_cut([(i, d["text"]) for i, d in docs.items()])


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "page_id long, url string, html string, text string, digest string, n_bytes long")


def test_pages_with_edges(spark, tmp_path):
    """Null ids, urls and texts, repeated rows, clashing names, empty tables."""
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<article>Words of it</article>"), (3, "u", "<article>Twice said</article>"), (3, "u", "<article>Twice said</article>")]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(pages_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "Words of it", 11), (3, "Twice said", 10), (3, "Twice said", 10)], key=str)
    assert html.extract_pages(pages_of(spark, [])).collect() == []
    warc.write(pages_of(spark, rows), f"file://{tmp_path}/a")
    assert sorted(r["payload_bytes"] for r in warc.read(spark, f"file://{tmp_path}/a").collect()) == sorted(len((h or "").encode()) for *_, h in rows)
    warc.write(pages_of(spark, []), f"file://{tmp_path}/b")
    assert warc.read(spark, f"file://{tmp_path}/b").collect() == []


def test_documents_with_edges(spark):
    rows = [(1, None), (2, ""), (3, "the word " * 30000), (4, "same text here"), (4, "same text here"), (None, "no id")]
    table = spark.createDataFrame([(i, t, "en", "s", "k", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, spans string, score double")
    empty = table.where("doc_id < 0")
    for scan in (secrets.scan, pii.scan, language.identify, packing.pack):
        out = scan(table).select("doc_id").collect()
        assert sorted({r[0] for r in out}, key=str) == sorted({i for i, _ in rows}, key=str) and sum(r[0] == 4 for r in out) == 2
        assert scan(empty).collect() == []
    assert secrets.redact(table).count() == len(rows) and secrets.redact(empty).collect() == [] and language.keep_identified(empty).collect() == []


def test_pipeline_redacts(spark):
    import corpus_pipeline

    table = spark.createDataFrame([(i, f"some plain words of text {i} with api_key = {hashlib.sha1(str(i).encode()).hexdigest()} inside", "en", "s", 10) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.secrets_stage(spark, table, SF)
    assert out.columns == table.columns and all(hashlib.sha1(str(r["doc_id"]).encode()).hexdigest() not in r["text"] and r["n_chars"] == len(r["text"]) for r in out.collect())
    edges = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the words of a text", "en", None, 19), (3, "the long text " * 20000, "en", "s", 1)], table.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edges, SF).collect()
        assert stage(spark, edges.where("doc_id < 0"), SF).collect() == []
