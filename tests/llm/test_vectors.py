"""Operators 11 to 13 against plain versions, on hard frames; samples, archives and pages that were once lost."""

import gzip
import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tessera.llm import codes, common, html, mixing, negatives, warc

NEW = {"op11_hard_negatives": negatives, "op12_vector_codes": codes, "op13_mixing": mixing}
VECTORS = "vec_id long, embedding array<double>, label int, code string, rank int, score double"  # extra columns clash with the results'


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = NEW[name].QUERIES[name](spark, SF)
    cur = con.execute(NEW[name].ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))


def hard_vectors(spark, n=260, crowd=40):
    """Nulls, bad components, zeros, short vectors, ties, copies and repeated rows."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6) * r.uniform(0.2, 2)], int(r.integers(0, 4)), "x", 1, 0.5) for i in range(n)]
    rows += [(1000 + i, rows[3][1], i % 3, "x", 1, 0.5) for i in range(crowd)]  # copies: all scores tie
    rows += [(2000, [1.0], 1, "x", 1, 0.5), (2100, [], 2, "x", 1, 0.5), (2200, [0.0] * 6, 1, "x", 1, 0.5), (2300, [-v for v in rows[3][1]], None, "x", 1, 0.5)]
    bad = [(3000, None, 1), (3100, [None] + [1.0] * 5, 1), (3200, [float("nan")] * 6, 1), (3300, [float("inf")] + [0.0] * 5, 1)]
    rows += [(*b, "x", 1, 0.5) for b in bad] + [(100, rows[100][1], rows[100][2], "x", 1, 0.5)] * 2
    return rows, spark.createDataFrame(rows, VECTORS)


def integers(v, width):
    return [int(np.floor(256 * x)) for x in v] + [0] * (width - len(v))


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def test_negatives_against_brute_force(spark):
    rows, df = hard_vectors(spark)
    seen = {r[0]: (np.array(integers(r[1], 6)), r[2]) for r in usable(rows) if r[2] is not None}
    want = set()
    for a, (x, label) in seen.items():
        if a % 20:
            continue
        scored = sorted((-int(x @ y), i, other) for i, (y, other) in seen.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            hits = [(n, i) for n, i, other in scored if other != label and 80 * -s <= 100 * -n <= 100 * -s][:5]
            want |= {(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(hits)}
    for block, chunk in ((65_536, 4096), (64, 16)):  # many blocks and chunks as well
        old, negatives.BLOCK, negatives.CHUNK = (negatives.BLOCK, negatives.CHUNK), block, chunk
        try:
            got = negatives.mined(df, F.col("vec_id") % 20 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        finally:
            negatives.BLOCK, negatives.CHUNK = old
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert negatives.mined(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.mined(df.where("vec_id = 100"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_leave_rows_out():
    """Every score lies within its bound, and the bounds leave most rows out."""
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(3000, 16)) / 4).astype(np.int64)
    books = np.ascontiguousarray(x[:64].reshape(64, 8, 2).transpose(1, 0, 2))
    found, error = codes.nearest(x, books)
    import pyarrow as pa

    t = pa.table({"vec_id": np.arange(3000), "label": np.zeros(3000, np.int64), "rest": np.sqrt(error.astype(float)), "comps": [v.astype(np.int32).tobytes() for v in x], "codes": [c.astype(np.uint16).tobytes() for c in found]})
    block = negatives.Block(t, books)
    table, norms, kind = block.tables(x[:50])
    scores = block.looked_up(table, slice(0, 3000), kind)
    true = block.comps.astype(np.int64) @ x[:50].T
    reach = np.stack([block.reach(norms, v) for v in block.rest])
    assert (np.abs(true - scores) <= reach).all()
    assert (scores + reach >= np.sort(true, axis=0)[-6]).mean() < 0.5


def test_codes_against_brute_force(spark):
    rows, df = hard_vectors(spark)
    kept = usable(rows)
    x = [np.array(integers(r[1], 16)) for r in kept]  # six components, filled up to sixteen parts of one
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0], kept[i][1]))[:64]
    books = [[int(x[i][p]) for i in order] for p in range(16)]
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: ((int(v[p]) - books[p][e]) ** 2, e))
    for _ in range(2):
        sums = defaultdict(list)
        for v in x:
            for p in range(16):
                sums[p, nearest(v, p)].append(int(v[p]))
        books = [[sum(sums[p, e]) // len(sums[p, e]) if (p, e) in sums else b for e, b in enumerate(books[p])] for p in range(16)]
    digest = hashlib.sha256(",".join(str(b) for p in books for b in p).encode()).hexdigest()
    error = [sum((int(v[p]) - books[p][nearest(v, p)]) ** 2 for p in range(16)) for v in x]
    by = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        by[r[2]] += e
    want = sorted((r[0], "".join(f"{nearest(v, p):02x}" for p in range(16)), e, by[r[2]], digest) for r, v, e in zip(kept, x, error, strict=True))
    got = codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in codes.compressed(df.repartition(7)).select(*got.columns).collect()) == want
    assert codes.compressed(df.where("vec_id = 3000")).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compressed(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")).collect()


def hard_documents(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(r.pareto(1.2) * 20 + 1)), ["b", "a", "c", "hot", None][int(r.choice(5, p=[0.1, 0.1, 0.1, 0.6, 0.1]))]) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, " \t\n\x0b\x0c\r ", None), (5003, "x\x1cy z", "Z"), (5004, "only", "tiny"), (5005, None, "void"), (None, "no id", "a"), (5006, "long " * 200_000, "hot")]
    rows += [(6000, "the same words", "a")] * 50
    return rows, spark.createDataFrame([(*x, 9, 9, 9.0) for x in rows], "doc_id long, text string, source string, size int, taken int, target double")


def test_mixing(spark):
    rows, df = hard_documents(spark)
    out = mixing.mixed(df.select("doc_id", "text", "source", "size", "taken", "target"))
    got = out.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, count(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += count(t)
    names = [*sorted(s for s in sizes if s is not None), None]
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        left -= sum(2 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.01 * sizes[s] + 5, s
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(repr, (tuple(r) for r in again))) == sorted(map(repr, (tuple(r) for r in got)))
    assert mixing.mixed(df.where("doc_id < 0")).count() == 0
    assert {r["taken"] for r in mixing.mixed(df.where("text IS NULL")).collect()} == {0}


def test_pareto_order_draws_in_proportion(spark):
    """Over many seeds (other ids), documents of a class are drawn about as often as their sizes say."""
    rows = [(g * 100 + i, "w " * (128 + 4 * i), f"s{g:03}") for g in range(300) for i in range(4)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("copies * source_size <> target")
    drawn = out.withColumn("i", F.col("doc_id") % 100).groupBy("i").agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("p")).collect()
    p = {r["i"]: r["p"] for r in drawn}
    assert len(p) == 4 and max(p.values()) - min(p.values()) < 0.2 and 0.05 < min(p.values()) < 0.95


def test_samples_of_any_size():
    for total in (10**5, 10**9, 2 * 10**10, 10**12, 10**15):
        share = common.sampled(20_000, total) / (1 << common.SAMPLE_BITS)
        assert 20_000 <= share * total < 20_000 * 1.01


def test_sample_of_equal_rows_is_an_error(spark):
    df = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    try:
        assert common.sample_by_key(df, "doc_id", 10).count() == 1000
    except ValueError as e:
        assert "empty" in str(e)


def record(i, body):
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nWARC-Block-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n"
    return head % (i, hashlib.sha256(body).hexdigest().encode(), len(body)) + body + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [1 << 24, 3000])
def test_members_are_inflated_in_pieces(piece):
    data = b"".join(record(i, bytes([65 + i % 20]) * (i * 37 % 9000)) for i in range(400))
    found = list(warc.salvage(gzip.compress(data), piece))
    assert [x["payload"] for x in found] == [bytes([65 + i % 20]) * (i * 37 % 9000) for i in range(400)]
    broken = gzip.compress(data[:5000] + b"junk" + data[5000:]) + b"between" + gzip.compress(record(9, b"last"))
    found = list(warc.salvage(broken, piece))
    assert sum(x["kind"] == "gap" for x in found) == 2 and found[-1]["payload"] == b"last" and len(found) >= 398


def test_salvage_is_linear():
    import time

    began = time.time()
    found = list(warc.salvage(b"WARC/1.1\r\n" * 500_000 + b"\r\n\r\n" + record(1, b"good")))
    assert [x["kind"] for x in found] == ["gap", "resource"] and time.time() - began < 20


BODY = "".join(f"<p>word{i} alpha beta gamma delta epsilon zeta eta theta</p>" for i in range(20))
LATE = BODY.replace("word", "late")
NAV = "<nav><ul>" + "".join(f"<li><a href=x>nav{i} item</a></li>" for i in range(8)) + "</ul></nav>"
COMMENTS = '<section class="comments">' + "".join(f"<div><p>comment{i} {'nice post indeed ' * 5}</p></div>" for i in range(6)) + "</section>"
WHOLE = {
    "content-with-sidebar": f'<div class="content-with-sidebar">{BODY}</div>',
    "sidebar-left": f'<div class="layout sidebar-left"><div class="text">{BODY}</div></div>',
    "notice-board": f'<main id="notice-board">{BODY}</main>',
    "ad-free": f'<div class="post ad-free">{BODY}</div>',
    "dialog-content": f'<div class="dialog-content interview">{BODY}</div>',
    "social-history": f'<article><section class="social-history">{BODY}</section></article>',
    "aside between": f"<article>{BODY}<aside>{'<p>side words here</p>' * 600}</aside>{LATE}</article>",
    "many comments": f'<div class="entry">{BODY}</div>{COMMENTS * 10}',
    "plain": f"<div>{BODY}</div>",
}


@pytest.mark.parametrize("name", WHOLE)
@pytest.mark.parametrize("learned", [{}, {"article": 4.0, "footer": -4.0, "head": -4.0, "ad": -4.0, "nav": -4.0}])
def test_no_article_vanishes(name, learned):
    page = f"<html><body>{NAV}{WHOLE[name]}{COMMENTS}<footer>copyright us all</footer></body></html>"
    want = re.sub("<[^>]*>", " ", BODY + (LATE if "late" in WHOLE[name] else "")).split()
    assert html.extract(page, html.Weights(container=learned)).split() == want


@pytest.mark.parametrize(("name", "beside"), [("site-footer", True), ("nav-links", True), ("cookie-banner", True), ("post-comments", True), ("footer-content", False), ("sidebar-left", True), ("ad-free", False), ("no-comments", False), ("content-with-sidebar", False)])
def test_heads_of_compounds(name, beside):
    assert any(h in html.BESIDE for h in html.heads(name)) == beside


def test_articles_of_given_pages_are_whole(spark):
    """Whole texts: the article of a page without what names itself boilerplate, by another parser."""
    from html import unescape

    texts = {r["page_id"]: r["text"] for r in html.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    checked = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        own = r["html"] or ""
        if own.count("<article") != 1 or "</article>" not in own:
            continue
        inner = own.split("<article", 1)[1].split(">", 1)[1].split("</article>")[0]
        if re.search(r"<(?!/?(?:p|h[1-6]|b|i|em|a|strong|ul|ol|li|br|span)\b)|<[^>]*(?:class|id|role)=", inner):
            continue
        checked += 1
        plain = unescape(re.sub(r"</?(?:b|i|em|a|strong|span)\b[^>]*>", "", inner))
        assert texts[r["page_id"]] == " ".join(re.sub(r"<[^>]*>", " ", plain).split())
    assert checked >= 5


def index_hits(spark, pairs):
    """Whether the multi-index alone joins each (window, item), both lists of shingle hashes."""
    from tessera.llm import decontaminate as d

    rows = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(pairs)], "i long, w array<long>, t array<long>")
    side = lambda c: d.fingerprints(rows.select("i", F.explode(c).alias("h")), "i")
    probes = side("w").select("i", "fp", F.explode(d.blocks("fp")).alias("at")).select("i", "fp", "at.*")
    index = side("t").select(F.col("i").alias("j"), F.col("fp").alias("item_fp"), F.explode(d.blocks("fp")).alias("at"), F.array(*[F.lit(x) for x in d.FLIPPED]).alias("flips"))
    index = index.select("j", "item_fp", F.col("at.block").alias("block"), F.explode("flips").alias("flip"), F.col("at.value").alias("v")).withColumn("value", F.col("v").bitwiseXOR(F.col("flip")))
    found = probes.join(index, (probes.i == index.j) & (probes.block == index.block) & (probes.value == index.value)).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= d.RADIUS)
    return {r["i"] for r in found.select("i").distinct().collect()}


def test_index_finds_what_is_similar_enough(spark):
    """Windows at the threshold itself, where fingerprints differ most: the index finds them without any count of step 1."""
    r = np.random.default_rng(11)
    pairs = []
    for _ in range(3000):
        n = int(r.integers(8, 120))
        item = r.integers(-(1 << 62), 1 << 62, n)
        changed = n // 7  # (n - c) / (n + c) >= 0.75
        window = np.concatenate([item[changed:], r.integers(-(1 << 62), 1 << 62, changed)])
        pairs.append((window.tolist(), item.tolist()))
    assert len(index_hits(spark, pairs)) >= 2997
    far = [(r.integers(-(1 << 62), 1 << 62, 40).tolist(), r.integers(-(1 << 62), 1 << 62, 40).tolist()) for _ in range(300)]
    assert len(index_hits(spark, far)) < 30


def test_packing_is_best_fit_at_every_step():
    """A replay with plain loops: each piece went to the tightest bin that its source and cluster allow, or to a new one where none does."""
    import pandas as pd

    from tessera.llm import packing

    r = np.random.default_rng(13)
    sizes = r.permutation(np.arange(1, 900))[:400]  # all different, so the order of work is theirs
    rows = pd.DataFrame({"shard": 0, "doc_id": np.arange(400), "source": r.choice(["a", "b", "c", "d", None], 400, p=[0.4, 0.2, 0.2, 0.1, 0.1]), "cluster": r.integers(0, 150, 400), "n_words": sizes, "copies": 1}).astype({"doc_id": "Int64", "cluster": "Int64"})
    out = packing.pack_shard(rows, 500)
    room, held = {}, {}
    for x in out[~out.bin_id.str.contains("full")].sort_values("n_words", ascending=False).itertuples():
        tags = {("s", x.source)} if isinstance(x.source, str) else set()
        tags |= {("c", int(x.cluster))}
        size = int(x.n_words) + 1
        fits = [left for b, left in room.items() if left >= size and not held[b] & tags]
        if x.bin_id in room:
            assert room[x.bin_id] == min(fits) and not held[x.bin_id] & tags and x.bin_offset == 500 - room[x.bin_id]
        else:
            assert not [f for f in fits if f >= 2] and x.bin_offset == 0
            room[x.bin_id], held[x.bin_id] = 500, set()
        room[x.bin_id] -= size
        held[x.bin_id] |= tags
    assert int(out.n_words.sum()) == int(sizes.sum()) and min(room.values()) >= 0
