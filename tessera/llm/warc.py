"""WARC archives: Spark writes them, and a salvaging reader gets back what a damaged archive still holds.

Each row becomes one WARC/1.1 record; the files are written by Spark's text writer (a record's last line
feed is the line end), so commits, retries and any Hadoop file system work as usual.  Of equal payloads of
``MIN_REVISIT`` bytes or more, the one with the smallest id is a ``response``; the others are ``revisit``
records that refer to it.

The reader takes one file at a time (files hold few records where pages are long), plain or gzip members.  After
a failed check it searches for the next member or version line, recovers what follows and logs the bytes in
between as a gap.  A record of right length whose digest fails is quarantined as a whole, so that text inside
its payload is never taken for a record.

A null html is an empty payload, a null url an empty target.  Null ids never become the first of their
payload while another id is there, and stay null; rows repeated with the smallest id are all responses.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

MIN_REVISIT = 100
#: Bytes that a gzip member is inflated by at once: records leave memory before the next ones come.
PIECE = 1 << 24
#: Records of a file by the bytes of their payloads: a file is read as one row, of far less than 2 GB.
RECORDS_PER_FILE, LONG_BYTES, LONG_PER_FILE = 1000, 256_000, 4
#: Repeated payloads up to which their digests are broadcast (about 150 bytes each).
BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
RECORD = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"(?<![^\n])WARC/1\.[01]\r\n|\x1f\x8b\x08")
READ = "path string, first long, last long, kind string, record_id string, target string, refers_to string, digest string, payload_bytes long, payload binary, reason string"
READ_ARROW = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, n_bytes and refers_to: the smallest id of an equal payload, null for responses."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "n_bytes": F.octet_length("html").cast("long")})
    # Usually few payloads repeat: then their digests are sent to the pages, else both are dealt by digest.
    firsts = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where(F.col("n") > 1)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    firsts = written(firsts.select("digest", "first_id"), "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    return rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, date: str = DATE) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) to WARC files under ``path``; pages over LONG_BYTES to files of few records."""
    rows = with_revisits(pages)
    long = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) > LONG_BYTES
    _write(rows.where(~long), f"{path}/short", records_per_file, date)
    _write(rows.where(long), f"{path}/long", min(records_per_file, LONG_PER_FILE), date)


def _write(rows: DataFrame, path: str, records_per_file: int, date: str) -> None:
    revisit, end = F.col("refers_to").isNotNull(), "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(end * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20]", "%20")),
        F.lit(f"WARC-Date: {date}"),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2("block", 256)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    record = F.concat(F.concat_ws(end, *head), F.lit(end * 2), F.col("block"), F.lit(f"{end}\r"))
    rows.withColumn("block", block).select(record.alias("value")).write.option("maxRecordsPerFile", records_per_file).text(path)


def _header(data: bytes | bytearray, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Fields (lower-case names) of the lines after the one at ``at`` to the first empty one, and where the block begins.

    The first line without a colon ends the attempt, so that a stretch of version lines is read once.
    """
    fields: dict[bytes, bytes] = {}
    begin = data.find(b"\r\n", at)
    while begin >= 0:
        begin += 2
        end = data.find(b"\r\n", begin)
        if end == begin:
            return fields, begin + 2
        colon = data.find(b":", begin, end) if end >= 0 else -1
        if colon < 0:
            return None
        fields[bytes(data[begin:colon]).strip().lower()] = bytes(data[colon + 1 : end]).strip()
        begin = end
    return None


def parse_record(data: bytes | bytearray, at: int) -> tuple[int | None, dict | str]:
    """The end of the record at ``at``, and the record or why it fails; no end: its length can't be trusted."""
    if not RECORD.match(data, at):
        return None, "no version line"
    if not (head := _header(data, at)):
        return None, "broken header"
    fields, begin = head
    if not (size := fields.get(b"content-length", b"")).isdigit():
        return None, "no length"
    end = begin + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, "wrong length"
    block = bytes(data[begin:end])
    wanted = fields.get(b"warc-block-digest", b"")
    if wanted.startswith(b"sha256:") and hashlib.sha256(block).hexdigest().encode() != wanted[7:]:
        return end + 4, "wrong block digest"
    payload, n_bytes = block, len(block)
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        if not (http := _header(block, 0)):
            return end + 4, "broken HTTP header"
        payload, n_bytes = block[http[1] :], int(size) - http[1]
        if (own := http[0].get(b"content-length", b"")).isdigit():
            n_bytes = int(own)
    kind, digest = fields.get(b"warc-type", b"").decode("utf-8", "replace"), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("ascii", "replace")
    if kind != "revisit" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return end + 4, "wrong payload digest"
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    return end + 4, {"kind": kind, "record_id": text(b"warc-record-id"), "target": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"), "digest": digest or None, "payload_bytes": n_bytes, "payload": payload}


class Inflated:
    """The text of the gzip member at ``at``, inflated piece by piece as it is asked for."""

    def __init__(self, data: bytes, at: int, piece: int = PIECE):
        self.unzip, self.rest, self.piece, self.size = zlib.decompressobj(31), memoryview(data)[at:], piece, len(data)

    def more(self) -> bytes:
        """The next piece; empty at the end of the member, an error where it is broken or cut."""
        while not self.unzip.eof:
            out = self.unzip.decompress(self.rest, self.piece)
            self.rest = self.unzip.unconsumed_tail
            if out:
                return out
            if not self.rest and not self.unzip.eof:
                raise zlib.error("cut member")
        return b""

    def end(self) -> int:
        return self.size - len(self.unzip.unused_data)


def _member(data: bytes, at: int, piece: int) -> tuple[list[dict], int | None, str]:
    """Records and gaps of the gzip member at ``at``, its end, and why it fails; a record is parsed when it has come whole."""
    source, held, found, done = Inflated(data, at, piece), bytearray(), [], False
    try:
        while not done:
            wanted = len(held) + piece  # twice as much each time: a long record is parsed a few times only
            while len(held) < wanted and not done:
                done = not (got := source.more())
                held += got
            place = 0
            while not done and place < len(held):
                end, got = parse_record(held, place)
                if not isinstance(got, dict):
                    break  # cut by the piece, or damaged: told when more has come
                found.append(got)
                place = end
            del held[:place]
            piece = max(piece, len(held))
    except zlib.error:
        return [], None, "broken member"
    return found + list(salvage(bytes(held))), source.end(), ""


def salvage(data: bytes, piece: int = PIECE) -> Iterator[dict]:
    """Records and gaps of an archive, in order; every byte belongs to one of them or to a good gzip member."""
    at, gap, why = 0, None, ""
    while at < len(data):
        found, reason = [], ""
        if data.startswith(b"\x1f\x8b", at):
            own, end, reason = _member(data, at, piece)
            found = [x | {"first": at, "last": end} for x in own]
        else:
            end, got = parse_record(data, at)
            if isinstance(got, dict):
                found = [got | {"first": at, "last": end}]
            else:
                reason = got
        if reason:
            gap, why = (at, reason) if gap is None else (gap, why)
            if end is not None:
                at = end
            else:
                at = m.start() if (m := START.search(data, at + 1)) else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "first": gap, "last": at, "reason": why}
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield {"kind": "gap", "first": gap, "last": len(data), "reason": why}


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives under ``path``: see READ; ``payload=False`` leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows = [x | {"path": name.as_py()} | ({} if payload else {"payload": None}) for x in salvage(data.as_py())]
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 2000], schema=READ_ARROW)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    broken = F.concat(F.lit("damaged archive "), "path", F.lit(" from byte "), F.col("first").cast("string"), F.lit(": "), "reason")
    records = read(spark, path, payload=False).where(F.when(F.col("kind") == "gap", F.raise_error(broken).cast("boolean")).otherwise(True))
    number = lambda c: F.regexp_extract(c, "(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
}
