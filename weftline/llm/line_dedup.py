"""Reversible line deduplication with sharded cuckoo filters over exact reference counts.

A line's key is its 128-bit BLAKE2b digest after stripping ASCII white space and folding A-Z.  The
index keeps one exact reference row per (key, document) in segments: inserting documents adds a
segment of new references, deleting them adds one that takes theirs back, so that a deletion restores
exactly the state before the insertion; many segments are merged to one.  Counts are taken anew only
for the keys that a change touches.

The keys that currently repeat are held in cuckoo filters, as many shards of a fixed size as they need
with room to spare, up to ``filter_bytes`` in all: this is what the tasks that read texts get.  A line
that its filter denies is certainly unique enough and never leaves its task; a line that it admits is
settled by an exact join with the reference counts.  A shard with more repeating keys than its filter
holds admits every line, the join settles all, and the filter is built again as soon as its keys fit.

Nulls and edge cases: a null or empty text is one empty line; a null id is never counted and its
text stays as it is; rows with equal ids are one document for the counts, and each keeps its row; of
documents with one line the largest id keeps it, wherever it stands there and however often; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import by_batches, byte_texts, discard, fresh, quoted, slices, stored, with_column

BUCKETS, SLOTS = 1 << 13, 4
SEGMENTS = 8  # beyond which they are merged


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where the line is too short to count."""
    line = line.strip().lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints; ``full`` marks one that admits everything."""

    def __init__(self, table: np.ndarray | None = None, full: bool = False, buckets: int = BUCKETS):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.full = full

    @property
    def capacity(self) -> int:
        """Keys that go in without many moves."""
        return self.table.size * 9 // 10

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[4:6], "little") or 1
        one = int.from_bytes(key[6:10], "little") % len(self.table)
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        """The other place of a mark, and back again: the number of buckets is a power of two."""
        return place ^ (mark * 0x5BD1E995 >> 7) % len(self.table)

    def insert(self, key: bytes) -> None:
        if self.full:
            return
        mark, one, two = self._places(key)
        for place in (one, two):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        place = one
        for turn in range(500):
            slot = (turn + mark) % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = self._other(place, mark)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        self.full = True

    def delete(self, key: bytes) -> None:
        """Take out one copy of a key that was inserted; a full filter stays full until it is built again."""
        if self.full:
            return
        mark, one, two = self._places(key)
        for place in (one, two):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return

    def __contains__(self, key: bytes) -> bool:
        if self.full:
            return True
        mark, one, two = self._places(key)
        return mark in self.table[one].tolist() or mark in self.table[two].tolist()


def _shard(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "big") % shards


def _references(docs: DataFrame, id_col: str, text_col: str, min_chars: int, shards: list[CuckooFilter] | None = None) -> DataFrame:
    """(key, doc_id) for each distinct line of each document that ``shards`` admit."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", docs.schema[id_col].dataType)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, owners = [], []
            ids = part.column(0)
            for row, text in enumerate(byte_texts(part.column(1))):
                found = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                if shards is not None:
                    found = [k for k in found if k in shards[_shard(k, len(shards))]]
                keys += found
                owners += [row] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids.take(pa.array(owners, pa.int64()))], names=["key", "doc_id"])

    return by_batches(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).filter("doc_id is not null"), emit, schema)


class LineIndex:
    """The exact reference rows of a corpus and the filters of its repeating keys."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20, filter_bytes: int = 32 << 20, buckets: int = BUCKETS):
        if min_docs < 2:
            raise ValueError("min_docs must be at least 2")
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.buckets, self.most_shards = buckets, max(1, filter_bytes // (buckets * SLOTS * 2))
        self.segments: list[tuple[DataFrame, int]] = []
        self.repeating: DataFrame | None = None
        self.filters: list[CuckooFilter] = []

    def live(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, doc_id) of all references, or of those with the given keys."""
        parts = [(s if keys is None else s.join(keys, "key", "left_semi")).select("key", "doc_id", F.lit(n).alias("n")) for s, n in self.segments]
        if len(parts) == 1:
            return parts[0].drop("n")
        whole = functools.reduce(DataFrame.unionByName, parts)
        return whole.groupBy("key", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0").drop("n")

    @property
    def references(self) -> DataFrame:
        return self.live()

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Count the lines of further documents; those that an id already has are not counted twice."""
        new = _references(docs, id_col, text_col, self.min_chars).distinct()
        if not self.segments:
            self.segments.append((stored(new, "line-references"), 1))
            return self._recount(None)
        new = stored(new, "line-references")
        touched = new.select("key").distinct()
        added = stored(new.join(self.live(touched), ["key", "doc_id"], "left_anti"), "line-references")
        discard(new)
        return self._add(added, 1)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Forget the documents with the given ids."""
        if not self.segments:
            return self
        gone = ids.select(F.col(quoted(id_col)).alias("doc_id")).distinct()
        return self._add(stored(self.live().join(gone, "doc_id", "left_semi").select("key", "doc_id"), "line-references"), -1)

    def _add(self, segment: DataFrame, sign: int) -> LineIndex:
        self.segments.append((segment, sign))
        self._recount(segment.select("key").distinct())
        if len(self.segments) > SEGMENTS:
            merged, old = stored(self.live(), "line-references"), [s for s, _ in self.segments]
            self.segments = [(merged, 1)]
            discard(*old)
        return self

    def _recount(self, touched: DataFrame | None) -> LineIndex:
        """Count the touched keys (None: all) and edit the filters by what came to repeat and what no longer does."""
        counts = self.live(touched).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        now, was = counts.filter(F.col("docs") >= self.min_docs), self.repeating
        if was is None:
            self.repeating = stored(now, "line-counts")
        else:
            self.repeating = stored(was.join(touched, "key", "left_anti").unionByName(now), "line-counts")
        sizes = self._sizes(self.repeating, max(1, len(self.filters)))
        room = CuckooFilter(buckets=self.buckets).capacity
        wanted = min(self.most_shards, 1 << max(0, -(-sum(sizes.values()) * 3 // (2 * room)) - 1).bit_length())
        if not self.filters or wanted > len(self.filters) or wanted * 8 < len(self.filters):
            self.filters = [CuckooFilter(buckets=self.buckets) for _ in range(wanted)]
            self._edit(self.repeating, insert=True)
        else:
            again = [s for s, f in enumerate(self.filters) if f.full and sizes.get(s, 0) <= room]
            self._edit(was.join(self.repeating, "key", "left_anti"), insert=False, leave=again)
            self._edit(self.repeating.join(was, "key", "left_anti"), insert=True, leave=again)
            if again:
                for s in again:
                    self.filters[s] = CuckooFilter(buckets=self.buckets)
                self._edit(self.repeating.filter(self._of(len(self.filters)).isin(again)), insert=True)
        if was is not None:
            discard(was)
        return self

    @staticmethod
    def _of(shards: int) -> Column:
        return (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % shards).cast("int")

    def _sizes(self, keys: DataFrame, shards: int) -> dict[int, int]:
        """How many of the keys each shard has: at most ``most_shards`` rows."""
        return {r["shard"]: r["n"] for r in keys.groupBy(self._of(shards).alias("shard")).agg(F.count("*").alias("n")).collect()}

    def _edit(self, keys: DataFrame, insert: bool, leave: list[int] | None = None) -> None:
        """Apply insertions or deletions to the filters but those to ``leave``, shard by shard, on the executors.

        A shard whose insertions exceed what a filter can hold becomes full without being sent, so
        that the rows in one group are at most a filter's capacity; a full one has nothing to edit.
        """
        keys = keys.select("key", self._of(len(self.filters)).alias("shard"))
        sizes = self._sizes(keys, len(self.filters))
        over = [s for s, n in sizes.items() if insert and n + int((self.filters[s].table > 0).sum()) > self.filters[s].capacity]
        for s in over:
            self.filters[s] = CuckooFilter(full=True, buckets=self.buckets)
        filters, skip = self.filters, [s for s in sizes if self.filters[s].full or s in (leave or ())]

        def apply(key: tuple, rows: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            own = filters[shard]
            held = CuckooFilter(own.table.copy(), own.full)
            for k in rows.column("key").to_pylist():
                held.insert(k) if insert else held.delete(k)
            return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([held.table.tobytes()], pa.binary()), "full": [held.full]})

        if len(sizes) > len(skip):
            edited = keys.filter(~F.col("shard").isin(skip)) if skip else keys
            for row in edited.groupBy("shard").applyInArrow(apply, "shard int, bits binary, full boolean").collect():  # at most filter_bytes
                self.filters[row["shard"]] = CuckooFilter(np.frombuffer(bytes(row["bits"]), np.uint16).reshape(-1, SLOTS).copy(), row["full"])

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` without the repeated lines, with ``_n_lines`` and ``_n_dropped`` appended, or these behind more underscores if ``docs`` has them.

        A repeating line stays in the document with the largest id only.  The result is lazy: use it before the index changes.
        """
        n_lines, n_dropped = fresh("_n_lines", docs.columns), fresh("_n_dropped", docs.columns)
        drop_name, drop_id = fresh("drop", docs.columns), fresh("drop_id", docs.columns)
        hits = _references(docs, id_col, text_col, self.min_chars, self.filters)
        drop = hits.join(self.repeating.select("key", "keeper"), "key").filter(F.col("doc_id") != F.col("keeper"))
        drop = drop.groupBy(F.col("doc_id").alias(drop_id)).agg(F.collect_set("key").alias(drop_name))
        joined = docs.join(drop, docs[quoted(id_col)] == drop[drop_id], "left").drop(drop_id)
        schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
        min_chars, names = self.min_chars, docs.columns

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                texts, lines, dropped = [], [], []
                for text, keys in zip(byte_texts(part.column(text_col)), part.column(drop_name).to_pylist(), strict=True):
                    if not keys:
                        texts.append(text)
                        lines.append(text.count(b"\n") + 1)
                        dropped.append(0)
                        continue
                    keys = set(keys)
                    all_lines = text.split(b"\n")
                    kept = [x for x in all_lines if line_key(x, min_chars) not in keys]
                    texts.append(b"\n".join(kept))
                    lines.append(len(all_lines))
                    dropped.append(len(all_lines) - len(kept))
                out = with_column(part, text_col, pa.array(texts, pa.binary()).cast(pa.string())).select(names)
                yield with_column(with_column(out, n_lines, pa.array(lines, pa.int64())), n_dropped, pa.array(dropped, pa.int64()))

        return by_batches(joined, rewrite, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """One-shot use of :class:`LineIndex`: count all documents, then drop their repeated lines."""
    return LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs, id_col, text_col).apply(docs, id_col, text_col)
