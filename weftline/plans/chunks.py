"""Chunk plans and the ownership of lines by chunks, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_bytes(size: Column, number: int | None, chunk_size: int | None) -> Column:
    """Bytes of a chunk: the number of chunks beats their size; neither means whole objects."""
    if number:
        return F.ceil(size / F.lit(number)).cast("long")
    return F.lit(chunk_size).cast("long") if chunk_size else size


def chunk_plan(listing: DataFrame, key: str, size: str, *, number: int | None = None, chunk_size: int | None = None) -> DataFrame:
    """(key, part, total_parts, range_start, range_end) for each chunk; an empty object has none.

    Every byte lies in exactly one chunk, so that there are ceil(size / chunk) of them.
    """
    sized = listing.filter(F.col(size) > 0).select(key, F.col(size).cast("long").alias("_s"), chunk_bytes(F.col(size), number, chunk_size).alias("_c"))
    total = F.ceil(F.col("_s") / F.col("_c")).cast("long")
    each = sized.select("*", total.alias("total_parts"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("_k"))
    return each.select(key, (F.col("_k") + 1).alias("part"), "total_parts", (F.col("_k") * F.col("_c")).alias("range_start"), F.least((F.col("_k") + 1) * F.col("_c"), F.col("_s")).alias("range_end"))


def owned_lines(objects: DataFrame, key: str, text: str, chunk_size: int, separator: str = "\n") -> DataFrame:
    """(key, part, pos, line, start): a line belongs to the chunk with its first byte.

    Offsets are a running sum over the lines of one object.
    """
    width = len(separator.encode())
    lines = F.split(F.col(text), separator if separator == "\n" else "\\Q" + separator + "\\E", -1)
    sizes = F.transform(lines, lambda x: F.octet_length(x).cast("long") + width)
    each = objects.select(key, lines.alias("_lines"), sizes.alias("_sizes")).select(key, F.posexplode(F.arrays_zip("_lines", "_sizes")).alias("pos", "_z"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.select(key, F.col("pos").cast("long").alias("pos"), F.col("_z._lines").alias("line"), F.coalesce(F.sum("_z._sizes").over(w), F.lit(0)).cast("long").alias("start"))
    return placed.select(key, (F.floor(F.col("start") / chunk_size) + 1).cast("long").alias("part"), "pos", "line", "start")


def fixed_chunks(objects: DataFrame, key: str, text: str, chunk_size: int) -> DataFrame:
    """(key, part, chunk): bytes of ``chunk_size`` each, the last of an object shorter; lines may be cut."""
    body = F.col(text).cast("binary")
    parts = F.sequence(F.lit(0), F.ceil(F.octet_length(body) / chunk_size).cast("int") - 1)
    each = objects.filter(F.octet_length(body) > 0).select(key, body.alias("_b"), F.explode(parts).alias("_k"))
    return each.select(key, (F.col("_k") + 1).cast("long").alias("part"), F.substring("_b", F.col("_k") * chunk_size + 1, F.lit(chunk_size)).alias("chunk"))


def byte_range(text: str, first: int, last: int) -> Column:
    """The bytes ``first`` to ``last``, both included, counted from 0."""
    return F.substring(F.col(text).cast("binary"), first + 1, last - first + 1)
