"""Calls over chunks of stored objects: listings, whole lines by chunk, and what a function gets of a chunk.

Objects are named by a path or URL of any file system that Spark reads: a file, a folder (the files right
in it), a prefix that ends in "/" (all files below it) or a glob.  Everything goes through Spark's file
sources, so that executors need no other access.  Like these, listings leave out names that begin with "_"
or ".".  Web addresses are read by range requests of the tasks.
"""

from __future__ import annotations

import io
import pickle
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.globs import glob_to_regex
from weftline.plans.chunks import chunk_plan

@dataclass
class ObjectChunk:
    """A chunk as a function's ``obj``; ``data_stream`` can be read, sought and iterated."""

    url: str
    path: str
    bucket: str
    key: str
    part: int
    total_parts: int
    data_byte_range: tuple[int, int] | None
    chunk_size: int
    data_stream: io.BytesIO


def kind_of(sources: list[str]) -> str:
    """"url" or "path"; all sources of a job are of one kind."""
    kinds = {"url" if s.startswith(("http://", "https://")) else "path" for s in sources}
    if len(kinds) != 1 or not all(isinstance(s, str) for s in sources):
        raise ValueError("the sources of a job are web addresses or paths, not both")
    return kinds.pop()


def _load(source: str) -> tuple[str, bool, str | None]:
    """What Spark loads for a source: its root, whether with all below, and the expression that addresses must match."""
    if re.search(r"(?<!\\)[*?]", source):
        fixed = source[: re.search(r"(?<!\\)[*?]", source).start()].rpartition("/")[0]
        pattern = glob_to_regex(source.removeprefix(fixed + "/"))[1:]
        return fixed, True, re.escape(re.sub("^[a-z0-9]+:/+|^/+", "", fixed)) + "/" + pattern
    return source.rstrip("/"), source.endswith("/"), None


def _matching(df: DataFrame, pattern: str | None) -> DataFrame:
    return df.filter(F.col("uri").rlike("/" + pattern)) if pattern else df


def listing(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(uri, size) of the objects that the sources name, each once."""
    if kind_of(sources) == "url":
        return spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "uri string").mapInArrow(_heads, "uri string, size long")
    out = None
    for source in sources:
        root, below, pattern = _load(source)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower()).load(root)
        found = _matching(files.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size")), pattern)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def lines(spark: SparkSession, sources: list[str], separator: str = "\n") -> DataFrame:
    """(uri, start, line as bytes) of all lines, with the place of their first byte.

    Spark's text source gives each block of a file its whole lines.  Places are a running sum within a block and,
    over a table with a row for each block, of the blocks before it.
    """
    parts = []
    for source in sources:
        root, below, pattern = _load(source)
        files = spark.read.option("lineSep", separator).option("recursiveFileLookup", str(below).lower()).text(root)
        at = F.monotonically_increasing_id()
        parts.append(_matching(files.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), F.col("value").cast("binary").alias("line")), pattern))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    width = F.octet_length("line") + len(separator.encode())
    blocks = whole.groupBy("uri", "block").agg(F.sum(width).alias("bytes"))
    before = blocks.select("uri", "block", F.coalesce(F.sum("bytes").over(Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum(width).over(Window.partitionBy("uri", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = whole.withColumn("within", within).join(before, ["uri", "block"])
    return placed.select("uri", (F.col("before") + F.col("within")).cast("long").alias("start"), "line")


def plan(objects: DataFrame, number: int | None, chunk_size: int | None) -> DataFrame:
    """(uri, size, part, total_parts, range_start, range_end, call_id), calls in the order of addresses and parts.

    Empty objects have no chunk.  Numbers are summed over a table with a row for each object, not for each chunk.
    """
    parts = chunk_plan(objects, "uri", "size", number=number, chunk_size=chunk_size)
    counts = parts.groupBy("uri").agg(F.count("*").alias("n"))
    first = counts.select("uri", F.coalesce(F.sum("n").over(Window.orderBy("uri").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    joined = parts.join(objects, "uri").join(first, "uri")
    return joined.select("uri", "size", "part", "total_parts", "range_start", "range_end", (F.col("first") + F.col("part") - 1).cast("long").alias("call_id"))


def object_calls(spark: SparkSession, sources: list[str], number: int | None, chunk_size: int | None, newline: str | None, extra: dict[str, Any]) -> DataFrame:
    """(call_id, args, uri, part): a call for each chunk, with the chunk as ``obj``.

    With ``newline`` a chunk has the lines whose first byte lies in it, and may have none; without, the bytes of its range.
    """
    objects = listing(spark, sources)
    if objects.isEmpty():
        raise ValueError("no objects found")
    calls = plan(objects, number, chunk_size)
    whole = not number and not chunk_size
    if kind_of(sources) == "url":
        return calls.mapInArrow(_fetcher(newline, whole, extra), "call_id long, args binary, uri string, part long")
    if newline is None or whole:
        roots = [(*_load(s),) for s in sources]
        contents = None
        for root, below, pattern in roots:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower()).load(root)
            found = _matching(files.select(F.col("_metadata.file_path").alias("uri"), "content"), pattern)
            contents = found if contents is None else contents.unionByName(found)
        contents = contents.dropDuplicates(["uri"]) if len(sources) > 1 else contents
        body = F.substring(F.col("content"), F.col("range_start") + 1, F.col("range_end") - F.col("range_start"))
        return calls.join(contents, "uri").withColumn("content", body).mapInArrow(_packer(whole, extra), "call_id long, args binary, uri string, part long")
    size = F.ceil(F.col("size") / number).cast("long") if number else F.lit(chunk_size)
    placed = lines(spark, sources, newline).distinct() if len(sources) > 1 else lines(spark, sources, newline)
    owned = placed.join(objects, "uri").select("uri", (F.floor(F.col("start") / size) + 1).cast("long").alias("part"), "start", "line")
    return calls.groupBy("uri", "part").cogroup(owned.groupBy("uri", "part")).applyInArrow(_joiner(newline.encode(), extra), "call_id long, args binary, uri string, part long")


def _args(row: dict, body: bytes, byte_range: tuple[int, int] | None, extra: dict[str, Any]) -> bytes:
    path = re.sub("^[a-z0-9]+:/*", "/", row["uri"])
    bucket, _, key = path.lstrip("/").partition("/")
    chunk = ObjectChunk(row["uri"], path, bucket, key, row["part"], row["total_parts"], byte_range, len(body), io.BytesIO(body))
    return pickle.dumps({"obj": chunk, **extra})


def _calls(rows: list[tuple]) -> pa.Table:
    return pa.table({"call_id": pa.array([r[0] for r in rows], pa.int64()), "args": pa.array([r[1] for r in rows], pa.binary()), "uri": pa.array([r[2] for r in rows], pa.string()), "part": pa.array([r[3] for r in rows], pa.int64())})


def _packer(whole: bool, extra: dict[str, Any]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield from _calls([(r["call_id"], _args(r, r["content"], None if whole else (r["range_start"], r["range_end"] - 1), extra), r["uri"], r["part"]) for r in rows]).to_batches()

    return pack


def _joiner(separator: bytes, extra: dict[str, Any]):
    """A chunk's lines end to end; the last line of an object has a separator behind it only if there is one."""

    def join(key: tuple, calls: pa.Table, owned: pa.Table) -> pa.Table:
        out = []
        for r in calls.to_pylist():
            body = b"".join(x["line"] + (separator if x["start"] + len(x["line"]) + len(separator) <= r["size"] else b"") for x in owned.sort_by("start").to_pylist())
            out.append((r["call_id"], _args(r, body, (r["range_start"], r["range_end"] - 1), extra), r["uri"], r["part"]))
        return _calls(out)

    return join


# ---- web addresses ------------------------------------------------------------------------------


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes by HEAD requests; an address that tells none is an error, as its chunks cannot be planned."""
    for batch in batches:
        sizes = []
        for url in batch.column("uri").to_pylist():
            with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as answer:
                sizes.append(int(answer.headers["Content-Length"]))
        yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(sizes, pa.int64())], names=["uri", "size"])


def _ranged(url: str, first: int, last: int) -> bytes:
    """Bytes ``first`` to ``last``, both included, of an address; of servers without ranges, cut from the whole."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={first}-{last}"})) as answer:
        body = answer.read()
        return body if answer.status == 206 else body[first : last + 1]


def _owned_bytes(url: str, first: int, end: int, size: int, separator: bytes, step: int = 1 << 17) -> bytes:
    """The lines of an address whose first byte lies in [first, end)."""
    width = len(separator)
    back = min(first, width)
    body = _ranged(url, first - back, min(size, end) - 1)
    if back:
        found = body.find(separator)
        while found < 0 and first - back + len(body) < size and first - back + len(body) < end:
            body += _ranged(url, first - back + len(body), min(size, first - back + len(body) + step) - 1)
            found = body.find(separator)
        if found < 0 or first - back + found + width >= end:
            return b""
        body, first = body[found + width :], first - back + found + width
    while not body.endswith(separator) and first + len(body) < size:
        more = _ranged(url, first + len(body), min(size, first + len(body) + step) - 1)
        at = (body[-width + 1 :] if width > 1 else b"") + more
        found = at.find(separator)
        if found >= 0:
            return body + more[: found + width - (len(at) - len(more))]
        body += more
    return body


def _fetcher(newline: str | None, whole: bool, extra: dict[str, Any]):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if newline is None or whole:
                    body = _ranged(r["uri"], r["range_start"], r["range_end"] - 1)
                else:
                    body = _owned_bytes(r["uri"], r["range_start"], r["range_end"], r["size"], newline.encode())
                out.append((r["call_id"], _args(r, body, None if whole else (r["range_start"], r["range_end"] - 1), extra), r["uri"], r["part"]))
            yield from _calls(out).to_batches()

    return fetch
