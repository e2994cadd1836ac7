"""JSON files that hold one array of records, or one object, read by many tasks.

A file is cut at closing braces into splits.  Whether a split begins within a string, and how deep, depends on all before it: each split is
scanned once for both cases, the outcomes are chained (a row for each split), and then every split knows its start and
cuts out its records.  A record that crosses splits is put together from its parts.  Records become lines, so that Spark infers and
parses them as it does any JSON lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tables import new_path, written

ESCAPED = re.compile(rb"\\.", re.S)
QUOTE, OPEN, CLOSE = ord('"'), (ord("{"), ord("[")), (ord("}"), ord("]"))


def _depths(data: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets outside strings, their steps (1 or -1), and whether the text ends within a string."""
    plain = ESCAPED.sub(b"__", data) if b"\\" in data else data
    b = np.frombuffer(plain, np.uint8)
    quotes = b == QUOTE
    outside = (np.cumsum(quotes) + quoted) % 2 == 0
    opens, closes = np.isin(b, OPEN) & outside, np.isin(b, CLOSE) & outside
    at = np.flatnonzero(opens | closes)
    return at, np.where(opens[at], 1, -1), bool((quotes.sum() + quoted) % 2)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """(file, split, text) of a batch's stretches of one split; the separator is put back."""
    files, starts, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    first = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], starts[i]) != (files[first], starts[first]):
            yield files[first], starts[first], "".join(f"{v}}}" for v in values[first:i]).encode()
            first = i


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, begun outside or within a string: how it ends, its step in depth, and its first character but white space."""
    found: dict[tuple[str, int], list] = {}
    for b in batches:
        for file, start, data in _pieces(b):
            own = found.setdefault((file, start), [False, True, 0, 0, ""])
            for h in (0, 1):
                _, steps, own[h] = _depths(data, own[h])
                own[2 + h] += int(steps.sum())
            own[4] = own[4] or data[:1000].lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin1")
    rows = [(f, s, *v) for (f, s), v in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "start", "end0", "end1", "step0", "step1", "first"])


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, place, value): the objects of the arrays (or the object) in the files under ``path``, as texts in one line.

    Items of an array that are no objects are left out.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    told = pieces.mapInArrow(_outcomes, "file string, start long, end0 boolean, end1 boolean, step0 long, step1 long, first string").orderBy("file", "start").collect()
    starts: dict[tuple[str, int], tuple[bool, int, int]] = {}  # in a string, depth, depth of records
    file = None
    for r in told:
        if r["file"] != file:
            file, quoted, depth, base = r["file"], False, 0, 1 if r["first"] == "[" else 0
        starts[file, r["start"]] = (quoted, depth, base)
        depth += r["step1"] if quoted else r["step0"]
        quoted = r["end1"] if quoted else r["end0"]
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and parts of those that cross an edge: place -1 goes on from before, the last may be open."""
        state: dict[tuple[str, int], list] = {}  # in a string, depth, records so far, text of the open one
        for b in batches:
            rows: list[tuple[str, int, int, bool, str]] = []
            for file, start, data in _pieces(b):
                quoted, depth, base = shared.value[file, start]
                own = state.setdefault((file, start), [quoted, depth, -1 if depth > base else 0, b""])
                at, steps, own[0] = _depths(data, own[0])
                after = own[1] + np.cumsum(steps)
                begins = at[(steps == 1) & (after == base + 1) & (np.frombuffer(data, np.uint8)[at] == OPEN[0])]
                ends = at[(steps == -1) & (after == base)] + 1
                first = 0
                if own[1] > base:  # the open record goes on
                    done = len(ends) > 0
                    own[3] += data[: ends[0]] if done else data
                    if done:
                        rows.append((file, start, own[2], True, own[3].decode("utf-8", "replace")))
                        own[2], own[3] = max(own[2], 0) + (own[2] >= 0), b""
                    first = 1
                ends = ends[first:]
                for i, begin in enumerate(begins):
                    end = ends[np.searchsorted(ends, begin)] if len(ends) and ends[-1] > begin else None
                    if end is None:
                        own[3] = data[begin:]
                    else:
                        rows.append((file, start, own[2], True, data[begin:end].decode("utf-8", "replace")))
                        own[2] += 1
                if len(after):
                    own[1] = int(after[-1])
            if rows:
                yield _batch(rows)
        rest = [(f, s, own[2], False, own[3].decode("utf-8", "replace")) for (f, s), own in state.items() if own[3]]
        if rest:
            yield _batch(rest)

    found = written(pieces.mapInArrow(cut, "file string, start long, place long, whole boolean, value string"), "json-parts")
    alone = found.where("place >= 0 AND whole")
    # Parts of one record: an open one, those that go on, and the one that ends it; a few for each edge.
    ordered = sorted(starts)
    opener: dict[tuple[str, int], int] = {}
    last = {(r["file"], r["start"]) for r in found.where("NOT whole AND place >= 0").select("file", "start").collect()}
    held: tuple[str, int] | None = None
    for key in ordered:
        if held and held[0] == key[0] and starts[key][1] > starts[key][2]:
            opener[key] = held[1]
        if key in last:
            held = key
    of = spark.createDataFrame([(f, s, o) for (f, s), o in opener.items()], "file string, start long, opener long")
    going = found.where("place = -1").join(F.broadcast(of), ["file", "start"]).select("file", F.col("opener"), "start", "value")
    parts = found.where("NOT whole AND place >= 0").select("file", F.col("start").alias("opener"), "start", "value").unionByName(going)
    crossing = parts.groupBy("file", "opener").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = crossing.select("file", F.col("opener").alias("start"), F.lit(1 << 60).alias("place"), F.concat_ws("", F.transform("parts", lambda x: x["value"])).alias("value"))
    both = alone.select("file", "start", "place", "value").unionByName(joined)
    return both.withColumn("value", F.translate("value", "\r\n", "  "))  # no line ends within strings of JSON


def _batch(rows: list[tuple[str, int, int, bool, str]]) -> pa.RecordBatch:
    f, s, p, w, v = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(s, pa.int64()), pa.array(p, pa.int64()), pa.array(w, pa.bool_()), pa.array(v, pa.string())], names=["file", "start", "place", "whole", "value"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON arrays (or single objects) under ``path``, with the types that Spark infers; nested fields stay nested."""
    lines = new_path(spark, "json-lines")
    record_texts(spark, path).select("value").write.text(lines)
    return spark.read.json(lines)
