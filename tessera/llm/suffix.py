"""Removal of byte strings that an earlier document holds already, by logarithmic families of suffix arrays.

Every byte covered by a WIDTH-byte string that also starts in a document with a smaller id goes.  Texts are
UTF-8; matches never cross documents.

1. Documents are dealt to batches of bounded size.  A batch samples its suffixes by winnowing: each WIDTH-byte
   window owns the suffix at its smallest GRAM-byte hash, so two equal windows own equal suffixes, and about one
   position in fourteen is kept.  Batches send sorted 32-bit keys of their suffixes to key shards.
2. A key shard tells each batch which of its keys lie in more than one document.  Colliding keys only add work.
3. Batches send those suffixes' windows to shards, one copy for equal contexts (the smallest id; later copies in
   the batch, compared byte by byte, are removed as a whole there and then, and later ones of other batches in 4).
4. A shard takes them in order of document: each run of new documents gets a suffix array (the places of its
   windows in the order of their WIDTH bytes), is merge-scanned against the arrays of the levels that exist, and
   becomes a level; levels of about equal size merge, so there are logarithmically many.  Matches are equal bytes.
5. Matches go back to their batches, which cut the documents.

Messages have a row for a batch and a shard that share something: fewer than the sampled suffixes at any size, and
batches and shards are as few as memory allows.  A key of a third of all documents costs a shard at most one entry a
batch in (1), one context a batch in (3).

Null and empty texts have nothing to remove.  Rows with a null id neither lose bytes nor make others lose some.
Rows with the same id don't affect each other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, GRAM = 50, 24
WINDOW = WIDTH - GRAM + 1
#: Bytes of text of a batch, for a key shard and for a shard, and windows of a run of new documents.
BATCH_BYTES, KEY_BYTES, SHARD_BYTES, RUN_WINDOWS = 8_000_000, 48_000_000, 4_000_000, 1 << 18
CHUNK = 1 << 18
U = np.uint64
ODD = (np.random.default_rng(23).integers(1, 1 << 63, size=8, dtype=np.uint64) << U(1)) | U(1)
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def at_every_byte(data: bytes) -> np.ndarray:
    """The 8 bytes from each position, as an unaligned view; ``data`` is padded by 64 bytes."""
    return np.ndarray(shape=(len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))


def windows_of(data: bytes) -> np.ndarray:
    """The WIDTH bytes from each position, as an unaligned view; ``data`` is padded by 64 bytes."""
    return np.ndarray(shape=(len(data) - WIDTH,), dtype=f"S{WIDTH}", buffer=data, strides=(1,))


def gram_hashes(view: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(view[at] * ODD[0] + view[at + 8] * ODD[1] + view[at + 16] * ODD[2])


def window_hashes(view: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of the WIDTH bytes from each position."""
    h = np.zeros(len(at), dtype=np.uint64)
    for i, offset in enumerate((*range(0, WIDTH - 8, 8), WIDTH - 8)):
        h = h * ODD[7] + view[at + offset] * ODD[i]
        h ^= h >> U(29)
    return mixed(h)


class Batch:
    """The texts of a batch in one buffer, and its sampled suffixes."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").to_pylist()
        self.texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def suffixes(self) -> tuple[np.ndarray, ...]:
        """row, first window, windows (a run that owns the suffix), hash of the suffix's first GRAM bytes."""
        size = int(self.sizes.sum())
        self.data = b"".join([*self.texts, bytes(64)])
        self.texts = []
        self.view = view = at_every_byte(self.data)
        self.doc = np.array([-1 if i is None else i for i in self.ids], dtype=np.int64)
        known = np.array([i is not None for i in self.ids], dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in range(0, size, CHUNK):
            n = min(CHUNK, size - c)
            words = view[c : c + n + WINDOW - 1 + 16].copy()
            words = np.pad(words, (0, n + WINDOW + 15 - len(words)))
            g = mixed(words[:-16] * ODD[0] + words[8:-8] * ODD[1] + words[16:] * ODD[2])
            m = ((g >> U(20)) << U(20)) | np.arange(len(g), dtype=np.uint64)
            for k in (1, 2, 4, 8):
                m = np.minimum(m[:-k], m[k:])
            m = np.minimum(m[: -(WINDOW - 16)], m[WINDOW - 16 :])[:n]
            a = (m & U((1 << 20) - 1)).astype(np.int64) + c
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            found.append((a[first], first + c, np.append(first[1:], n) + c))
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        a, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
        row = np.searchsorted(self.begin, a, "right") - 1
        row = np.clip(row, 0, None)
        s = np.maximum(s, self.begin[row])
        e = np.minimum(e, self.begin[row] + self.sizes[row] - WIDTH + 1)
        keep = (s < e) & known[row] & (a < size)
        a, s, e, row = a[keep], s[keep], e[keep], row[keep]
        # Hashes of sampled suffixes are small ones: mixed once more, they spread evenly over the shards.
        return row, s, e - s, mixed(gram_hashes(view, a) * ODD[6])


def shard_key(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard in the upper 32 bits, the key in the lower."""
    return ((((h >> U(32)) * U(shards)) >> U(32)) << U(32)) | (h & U(0xFFFFFFFF))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards that occur in sorted keys, and where each begins, with the end."""
    shard = sorted_keys >> U(32)
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    return shard[first].astype(np.int64), np.append(first, len(shard))


def send_keys(shards: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        batch = Batch(table)
        row, _, _, h = batch.suffixes()
        v = shard_key(h, shards)
        order = np.argsort(v, kind="stable")
        v, doc = v[order], batch.doc[row[order]]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(v) else np.zeros(0, bool)
        keys = v[first]
        names, cuts = _cuts(keys)
        low = keys.astype(np.uint32)
        own = [(_blob(low[i:j][~several[i:j]]), _blob(low[i:j][several[i:j]])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"shard": pa.array(names, pa.int32()), "batch": pa.array([table.column("batch")[0].as_py()] * len(own), pa.int32()), "one": pa.array([x for x, _ in own], pa.binary()), "several": pa.array([x for _, x in own], pa.binary())})

    return run


def answer_keys(table: pa.Table) -> pa.Table:
    """Which keys of each batch lie in more than one document: batches hold different ones."""
    one = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("one")]
    several = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("several")]
    keys, n = np.unique(np.concatenate(one + several), return_counts=True)
    sure = np.concatenate([keys[n > 1], *several])
    shared = np.unique(sure)
    shard = table.column("shard")[0].as_py()
    own = [np.intersect1d(np.concatenate((a, b)), shared, assume_unique=True) for a, b in zip(one, several, strict=True)]
    keep = [i for i, x in enumerate(own) if len(x)]
    batch = table.column("batch").to_pylist()
    return pa.table({"batch": pa.array([batch[i] for i in keep], pa.int32()), "shard": pa.array([shard] * len(keep), pa.int32()), "keys": pa.array([_blob(own[i]) for i in keep], pa.binary())})


def copies(view: np.ndarray, windows: np.ndarray, s: np.ndarray, n: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal contexts (the bytes of n windows from s) of a group follow each other, and the smallest document of each.

    The windows at both ends hold all bytes of a context: hashes bring likely copies together, bytes decide.
    """
    context = mixed(window_hashes(view, s) * ODD[3] + window_hashes(view, s + n - 1) * ODD[4] + n.astype(np.uint64) * ODD[5])
    order = np.lexsort((s, doc, context, group))
    s, n, doc, context, group = s[order], n[order], doc[order], context[order], group[order]
    new = np.concatenate(([True], (context[1:] != context[:-1]) | (group[1:] != group[:-1])))[: len(s)]
    same = np.flatnonzero(~new)
    for i in range(0, len(same), CHUNK):
        k = same[i : i + CHUNK]
        new[k] = (n[k] != n[k - 1]) | (windows[s[k]] != windows[s[k - 1]]) | (windows[s[k] + n[k] - 1] != windows[s[k - 1] + n[k - 1] - 1])
    return order, doc[np.flatnonzero(new)[np.cumsum(new) - 1]]


CONTEXTS = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("done", pa.bool_()), ("row", pa.binary()), ("first", pa.binary()), ("n", pa.binary()), ("doc", pa.binary()), ("context", pa.binary())])


def send_contexts(key_shards: int, shards: int) -> Callable:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(answers) or not len(table):
            return CONTEXTS.empty_table()
        batch = Batch(table)
        row, s, n, h = batch.suffixes()
        v = shard_key(h, key_shards)
        wanted = np.sort(np.concatenate([np.frombuffer(k.as_py(), np.uint32).astype(np.uint64) | U(i.as_py() << 32) for k, i in zip(answers.column("keys"), answers.column("shard"), strict=True)]))
        at = np.minimum(np.searchsorted(wanted, v), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == v)
        row, s, n, v = row[hit], s[hit], n[hit], shard_key(h[hit], shards)
        doc = batch.doc[row]
        order, lowest = copies(batch.view, windows_of(batch.data), s, n, doc, v >> U(32))
        row, s, n, v, doc = row[order], s[order], n[order], v[order], doc[order]
        first = s - batch.begin[row]
        rows = []
        name = table.column("batch")[0].as_py()
        late = doc > lowest
        if late.any():
            rows.append((name % shards, name, True, _blob(row[late].astype(np.int32)), _blob(first[late].astype(np.int32)), _blob(n[late].astype(np.uint8)), b"", b""))
        sent = np.flatnonzero(~late)
        names, cuts = _cuts(v[sent])
        for shard, i, j in zip(names, cuts[:-1], cuts[1:], strict=True):
            k = sent[i:j]
            text = b"".join([batch.data[a:b] for a, b in zip(s[k].tolist(), (s[k] + n[k] + WIDTH - 1).tolist(), strict=True)])
            rows.append((int(shard), name, False, _blob(row[k].astype(np.int32)), _blob(first[k].astype(np.int32)), _blob(n[k].astype(np.uint8)), _blob(doc[k]), text))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), CONTEXTS, strict=True)], schema=CONTEXTS) if rows else CONTEXTS.empty_table()

    return run


class Family:
    """Suffix arrays of the windows of earlier documents: places in the order of their bytes, each level at least twice the size of the next."""

    def __init__(self, windows: np.ndarray) -> None:
        self.windows = windows
        self.levels: list[np.ndarray] = []

    def _merged(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two arrays in one order, ``one`` first among equals: a stable sort of two sorted runs is one merge. And where the next is equal."""
        keys = self.windows[np.concatenate((one, two))]
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(order), dtype=bool)
        for i in range(0, len(order) - 1, CHUNK):
            part = keys[order[i : i + CHUNK + 1]]
            same[i : i + len(part) - 1] = part[1:] == part[:-1]
        return order, same

    def scan(self, array: np.ndarray) -> np.ndarray:
        """Which windows of a suffix array a level holds, by a merge scan of each level."""
        found = np.zeros(len(array), dtype=bool)
        for level in self.levels:
            order, same = self._merged(level, array)
            found[order[np.flatnonzero(same) + 1] - len(level)] = True
        return found

    def add(self, array: np.ndarray) -> None:
        """A new level of windows that no level holds; merges levels of about equal size."""
        if len(array):
            self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = np.concatenate((self.levels[-1], last))[self._merged(self.levels[-1], last)[0]]


def earlier(windows: np.ndarray, places_of: Callable[[int, int], tuple[np.ndarray, np.ndarray]], ends: np.ndarray, docs: np.ndarray, run_windows: int | None = None) -> Iterator[np.ndarray]:
    """For entries in order of document: which of their windows does an earlier document hold?

    ``ends``: windows up to the end of each entry; ``places_of(i, j)``: where the windows of entries i to j lie,
    and the document of each.  Yields a mask of windows for each run, so only a run's windows are held at once.
    """
    family, i, before = Family(windows), 0, 0
    while i < len(ends):
        j = min(int(np.searchsorted(ends, before + (run_windows or RUN_WINDOWS))) + 1, len(ends))
        j = int(np.searchsorted(docs, docs[j - 1], "right"))  # a document is never split
        places, doc = places_of(i, j)
        keys = windows[places]
        order = np.argsort(keys, kind="stable")  # in order of document among equals
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        del keys
        group = np.cumsum(new) - 1
        array, d = places[order][new], doc[order]
        old = family.scan(array)
        out = np.zeros(len(places), dtype=bool)
        out[order] = old[group] | (d > d[new][group])
        family.add(array[~old])
        yield out
        i, before = j, int(ends[j - 1])


MATCHES = pa.schema([("batch", pa.int32()), ("row", pa.binary()), ("first", pa.binary()), ("mask", pa.binary())])


def match(table: pa.Table) -> pa.Table:
    """The windows of each batch that earlier documents hold: a mask from the first window of each context."""
    rows, parts = [], []
    for name, done, row, first, n, doc, text in zip(*(table.column(c).to_pylist() for c in ("batch", "done", "row", "first", "n", "doc", "context")), strict=True):
        n = np.frombuffer(n, np.uint8).astype(np.int64)
        if done:
            rows.append((name, row, first, _blob(((1 << n) - 1).astype(np.uint32))))
        else:
            parts.append((name, np.frombuffer(row, np.int32), np.frombuffer(first, np.int32), n, np.frombuffer(doc, np.int64), text))
    if parts:
        data = b"".join(p[5] for p in parts) + bytes(64)
        parts = [p[:5] for p in parts]
        row, first, n, doc = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
        length = n + WIDTH - 1
        begin = np.cumsum(length) - length
        windows = windows_of(data)
        # Later copies of a whole context are matched as a whole; the arrays take the others.
        order, lowest = copies(at_every_byte(data), windows, begin, n, doc, np.zeros(len(n), np.uint64))
        late = doc[order] > lowest
        back = np.zeros(len(n), dtype=np.int64)
        back[order[late]] = (1 << n[order[late]]) - 1
        order = order[~late]
        order = order[np.argsort(doc[order], kind="stable")]
        n, doc, begin = n[order], doc[order], begin[order]
        ends = np.cumsum(n)
        mask = np.zeros(len(n), dtype=np.int64)

        def places(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            """The entry of each window of entries i to j, and its offset there."""
            count = n[i:j]
            return np.repeat(np.arange(i, j), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)

        def places_of(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            entry, offset = places(i, j)
            return begin[entry] + offset, doc[entry]

        at = 0
        for hit in earlier(windows, places_of, ends, doc):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + len(hit))) + 1
            entry, offset = places(at, to)
            np.add.at(mask, entry[hit], np.int64(1) << offset[hit])
            at = to
        back[order] = mask
        upto = np.cumsum([len(p[1]) for p in parts])
        for p, x, y in zip(parts, upto - [len(p[1]) for p in parts], upto, strict=True):
            k = np.flatnonzero(back[x:y]) + x
            if len(k):
                rows.append((p[0], _blob(row[k]), _blob(first[k]), _blob(back[k].astype(np.uint32))))
    return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), MATCHES, strict=True)], schema=MATCHES) if rows else MATCHES.empty_table()


def cut(table: pa.Table, matches: pa.Table) -> pa.Table:
    """Documents of a batch without the matched bytes."""
    batch = Batch(table)
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(matches):
        row, first, mask = (np.concatenate([np.frombuffer(x.as_py(), t) for x in matches.column(c)]) for c, t in (("row", np.int32), ("first", np.int32), ("mask", np.uint32)))
        bits = (mask[:, None] >> np.arange(WINDOW, dtype=np.uint32)) & 1
        k, j = np.nonzero(bits)
        # Windows in order of row and place; a run ends where the next window begins after its end.
        at = np.sort(row[k].astype(np.int64) << 40 | (first[k].astype(np.int64) + j))
        new = np.concatenate(([True], at[1:] > at[:-1] + WIDTH))
        b, e = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + WIDTH
        owner, low = b >> 40, (1 << 40) - 1
        first_of = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for i, x in zip(first_of, np.append(first_of[1:], len(owner)), strict=True):
            spans[int(owner[i])] = (b[i:x] & low, e[i:x] & low)
    removed, count, kept = [], [], []
    for i, text in enumerate(batch.texts):
        b, e = spans.get(i, ((), ()))
        removed.append(int(sum(e) - sum(b)) if len(b) else 0)
        count.append(len(b))
        kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*b, len(text)], strict=True)) if len(b) else text)
    return pa.table({"doc_id": pa.array(batch.ids, pa.int64()), "n_bytes": pa.array(batch.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept": pa.array(kept, pa.binary())})


def digested(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable:
    """``fn`` with the SHA-256 of the kept bytes in their place, so that texts needn't leave the task."""

    def run(table: pa.Table, matches: pa.Table) -> pa.Table:
        out = fn(table, matches)
        return out.set_column(4, "kept_sha256", pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in out.column("kept")], pa.string()))

    return run


def remove_repeats(docs: DataFrame, digest: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and kept (bytes) or, with ``digest``, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, key_shards, shards = (max(1, -(-size // b)) for b in (batch_bytes, KEY_BYTES, SHARD_BYTES))
    batch = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int")
    dealt = docs.withColumn("batch", batch).repartition(n, "batch")
    own = lambda df: df.groupBy("batch")
    keys = own(dealt).applyInArrow(send_keys(key_shards), "shard int, batch int, one binary, several binary")
    answers = keys.groupBy("shard").applyInArrow(answer_keys, "batch int, shard int, keys binary")
    contexts = own(dealt).cogroup(own(answers)).applyInArrow(send_contexts(key_shards, shards), "shard int, batch int, done boolean, row binary, first binary, n binary, doc binary, context binary")
    matches = contexts.groupBy("shard").applyInArrow(match, "batch int, row binary, first binary, mask binary")
    schema = CUT.replace("kept binary", "kept_sha256 string") if digest else CUT
    return own(dealt).cogroup(own(matches)).applyInArrow(digested(cut) if digest else cut, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
