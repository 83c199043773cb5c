"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

A document is the multiset of its five-word shingles (ASCII white space, A-Z folded).  Hashed darts
fall on the unit cells below each shingle's weight as a Poisson process in rank; a document with
total weight S looks at ranks below about k (ln k + 3) / S, so that it meets some hundreds of darts
however long it is.  Coordinate j of its signature is the earliest dart marked j, and two documents
share it with probability their weighted Jaccard similarity.

Documents with equal multisets are one class from the start and go on as their smallest id.  In
each bucket of a band every member is compared with one leader first, and the comparison is exact,
over whole texts.  Rounds with other leaders follow among members that are still in different classes,
while they link a tenth of their pairs.  All pairs that are then still in different classes are settled by
a prefix filter over whole shingle sets: it passes every pair that is alike enough, and those that
it passes are compared exactly.

Nulls and edge cases: a null text is empty; texts without words are one class; a text of fewer than five
words is one shingle; rows with a null id are in no class (class null) and never removed; rows with
equal ids are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import by_batches, byte_texts, plain_text, slices, stored

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, hashes: dict, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their weights (how often each occurs)."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if len(h) and n < 1:
        h, n = np.concatenate([h, np.zeros(1 - n, np.uint64)]), 1
    total = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for j in range(width):
            total = _mix(total + h[j : j + n] * _ODD[j % 5])
    return np.unique(total, return_counts=True)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 1.0 for two empty ones."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][at], b[1][bt]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 1.0


def dart_signatures(docs: list[tuple[np.ndarray, np.ndarray]], k: int, seed: int = 1) -> np.ndarray:
    """Signatures (documents x k) of non-empty weighted sets of integer weights."""
    out = np.zeros((len(docs), k), np.uint64)
    todo, darts = np.arange(len(docs)), k * (np.log(k) + 3)
    with np.errstate(over="ignore"):
        while len(todo):
            weights = np.concatenate([docs[d][1] for d in todo])
            cell = np.repeat(np.concatenate([docs[d][0] for d in todo]), weights)
            level = np.arange(len(cell)) - np.repeat(np.cumsum(weights) - weights, weights)
            cell = _mix(cell + level.astype(np.uint64) * _ODD[0] + np.uint64(seed))
            sizes = np.array([docs[d][1].sum() for d in todo])
            owner = np.repeat(np.arange(len(todo)), sizes)
            limit = darts / sizes
            layers = np.ceil(limit).astype(np.int64)[owner]
            owner, cell = np.repeat(owner, layers), np.repeat(cell, layers)
            layer = np.arange(len(cell)) - np.repeat(np.cumsum(layers) - layers, layers)
            state = _mix(cell + layer.astype(np.uint64) * _ODD[1])
            end = np.minimum(layer + 1.0, limit[owner])
            rank, found = layer.astype(np.float64), []
            while len(state):  # the next dart of each unit of rank, until it lies beyond
                rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                inside = rank < end
                state, rank, owner, end = state[inside], rank[inside], owner[inside], end[inside]
                dart = _mix(state + _ODD[2])
                found.append((owner, rank, dart))
                state = _mix(state + _ODD[3])
            owner, rank, dart = (np.concatenate([f[i] for f in found]) for i in range(3))
            place = owner * k + (dart % np.uint64(k)).astype(np.int64)
            order = np.lexsort((rank, place))
            first = order[np.concatenate([[True], place[order][1:] != place[order][:-1]])] if len(order) else order
            got = np.zeros(len(todo) * k, bool)
            got[place[first]] = True
            values = np.zeros(len(todo) * k, np.uint64)
            values[place[first]] = dart[first]
            full = got.reshape(-1, k).all(axis=1)
            out[todo[full]] = values.reshape(-1, k)[full]
            todo, darts = todo[~full], darts * 2
    return out


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest of the multiset, bands: a hash for each band) of each row with an id."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        factors = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for part in slices(batches):
            sets = [shingles(t, hashes) for t in byte_texts(part.column(1))]
            digests = [hashlib.blake2b(h.tobytes() + w.tobytes(), digest_size=16).digest() for h, w in sets]
            some = [i for i, (h, _) in enumerate(sets) if len(h)]
            keys: list = [[] for _ in sets]
            if some:
                signed = dart_signatures([sets[i] for i in some], bands * rows).reshape(len(some), bands, rows)
                with np.errstate(over="ignore"):
                    banded = _mix((signed * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[4]).view(np.int64)
                for i, row in zip(some, banded, strict=True):
                    keys[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return by_batches(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), plain_text(text_col).alias("text")), sign, schema)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are at least ``threshold`` alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = _WordHashes(), None, None
        for part in slices(batches):
            keep = []
            for one, two in zip(byte_texts(part.column("text_a")), byte_texts(part.column("text_b")), strict=True):
                if one != last:
                    last, held = one, shingles(one, hashes)
                keep.append(jaccard(held, shingles(two, hashes)) >= threshold)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return by_batches(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b"), compare, schema)


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each end of ``links`` (a, b): the smallest id that links lead to.

    Labels fall to the smallest among the neighbours', seen through their labels' own labels, so that
    chains halve.  Every round is written to the shared folder.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), F.lit(True).alias("fell")), "labels")
    while not labels.filter("fell").isEmpty():
        far = labels.select("id", "label").join(labels.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left").select("id", F.coalesce("further", "label").alias("label"))
        near = both.join(far.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = far.join(near, far["id"] == near["a"]).select("id", F.least("label", "near").alias("label"))
        was = labels.select("id", F.col("label").alias("was"))
        labels = stored(stepped.join(was, "id").select("id", "label", (F.col("label") < F.col("was")).alias("fell")), "labels")
    return labels.select("id", "label")


BUCKET_PART = 1024  # rows of a large bucket that go together
DEALS = 8  # parts of any bucket while its size is not known


def _with_buckets(rows: DataFrame, buckets: DataFrame, keys: list[str], split: bool = True) -> DataFrame:
    """``rows`` (id, band, n, ...) joined with ``buckets`` (``keys``, size, ...): a bucket of ``size`` rows meets them in parts of BUCKET_PART."""
    if not split:
        return rows.join(buckets.drop("size"), keys)
    parts = lambda n: F.ceil(F.col(n) / BUCKET_PART).cast("long")
    each = buckets.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), parts("size") - 1))).drop("size")
    return rows.withColumn("deal", F.pmod(F.xxhash64("id"), parts("n"))).join(each, [*keys, "deal"]).drop("deal")


def _led(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, la, lb) of a leader a and a member b of its bucket or part of a bucket, in different classes."""
    if turn % 2:
        grouped = buckets.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "id"), F.ceil(F.col("n") / 4).cast("long"))).withColumn("crowd", F.lit(0))
    else:
        crowds = buckets.groupBy("id").agg(F.sum("n").alias("crowd"))
        grouped = buckets.withColumn("part", F.lit(0).cast("long")).join(crowds, "id")
    rank = F.struct((-F.col("crowd")).alias("c"), F.xxhash64(F.lit(turn), F.col("id")).alias("p"), "id", "label")
    lead = grouped.groupBy("band", "part").agg(F.min(rank).alias("lead"), F.max("n").alias("size"))
    met = _with_buckets(grouped, lead, ["band", "part"], split=turn % 2 == 0).filter("label <> lead.label")
    return met.select(F.col("lead.id").alias("a"), F.col("id").alias("b"), F.col("lead.label").alias("la"), F.col("label").alias("lb")).distinct()


def _units(members: DataFrame) -> DataFrame:
    """(id, label, size, unit): a row for each unit of weight of each shingle of ``members`` (id, label, text)."""
    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("label", kind), T.StructField("size", T.LongType()), T.StructField("unit", T.LongType())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for part in slices(batches, 64):
            sets = [shingles(t, hashes) for t in byte_texts(part.column("text"))]
            sizes = np.array([w.sum() for _, w in sets], np.int64)
            weights = np.concatenate([w for _, w in sets]).astype(np.int64)
            level = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
            with np.errstate(over="ignore"):
                unit = _mix(np.repeat(np.concatenate([h for h, _ in sets]), weights) + level.astype(np.uint64) * _ODD[0]).view(np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("label").take(at), pa.array(np.repeat(sizes, sizes)), pa.array(unit)], names=schema.names)

    return by_batches(members.select("id", "label", "text"), cells, schema)


def _unsettled(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, la, lb) of ``members`` (id, label, text) in different classes that a prefix filter cannot refute.

    All units are ordered alike: those of a single class first, then the rare before the frequent.  Two sets of sizes s
    and t that are alike enough share a unit among the first s - ceil(threshold * s) + 1 of the one and likewise of the
    other, and after the first one they share, at places i and j, at most min(s - i, t - j) units are common to both.
    """
    units = stored(_units(members), "units")
    shared = units.groupBy("unit").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("unit", "n")
    sets = units.join(shared, "unit").groupBy("id").agg(F.min("label").alias("label"), F.min("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "unit"))).alias("units"))
    placed = sets.select("id", "label", "size", F.size("units").alias("some"), F.posexplode("units").alias("at", "u")).select("id", "label", "size", F.col("u.unit").alias("unit"), (F.col("size") - F.col("some") + F.col("at")).alias("place"))
    slack = 1e-9  # for the products' rounding
    heads = stored(placed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - slack)), "heads")
    one = heads.select("unit", F.col("id").alias("a"), F.col("label").alias("la"), F.col("size").alias("sa"), F.col("place").alias("pa"))
    two = heads.select("unit", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("place").alias("pb"))
    most = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    alike = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (most >= (F.col("sa") + F.col("sb")) * (threshold / (1 + threshold)) - slack)
    return one.join(two, (one["unit"] == two["unit"]) & alike).select("a", "b", "la", "lb").distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, class_id) for each distinct id: the smallest id among its near duplicates.

    A pair at similarity s meets in some band with probability 1 - (1 - s^rows)^bands: 0.9996 at 0.8.
    Each pair that meets is settled: in one class by links, or shown to be less alike than ``threshold``.
    """
    signed = stored(signatures(docs, bands, rows, id_col, text_col), "signatures")
    same = signed.groupBy("digest").agg(F.min("id").alias("rep"))
    members = stored(signed.select("id", "digest").distinct().join(same, "digest").select("id", "rep"), "copies")
    singles = signed.join(same.select(F.col("rep").alias("id"), F.col("digest").alias("d")), "id").filter("digest = d")
    banded = singles.select("id", F.explode(F.array_distinct("bands")).alias("band")).distinct()
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")  # only whole bands leave later, so n stays right
    crowded = crowded.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    buckets = banded.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS))).join(crowded, ["band", "deal"]).drop("deal")
    buckets = stored(buckets, "buckets").withColumn("label", F.col("id"))
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), plain_text(text_col).alias("text"))
    # Whole texts move once; the rounds read those of documents that share a bucket.
    held = stored(base.join(buckets.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
    labels, turn, settling = None, 0, False
    while True:
        # Two kinds of turns, and a last one that leaves no pair open.  In one, a bucket's leader is its member that shares
        # most bucket places with others: the centre of a group of copies.  In the other, a bucket is dealt at random to
        # groups of about four with a leader each.
        pairs = stored(_unsettled(held.join(buckets.select("id", "label").distinct(), "id"), threshold) if settling else _led(buckets, turn), "pairs")
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        found = stored(_verified(pairs.select("a", "b"), held.join(wanted, "id", "left_semi"), threshold), "verified")
        turn += 1
        if not found.isEmpty():
            merged = components(found.join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
            new = merged.select(F.col("id").alias("old"), F.col("label").alias("new"))
            if labels is None:
                labels = merged
            else:
                kept = labels.join(new, labels["label"] == new["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
                labels = stored(kept.unionByName(merged.join(labels.select("id"), "id", "left_anti")), "classes")
            marked = buckets.join(new, buckets["label"] == new["old"], "left").select("id", "band", "n", F.coalesce("new", "label").alias("label"))
            open_bands = marked.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("n").alias("size")).filter("x <> y").select("band", "size")
            buckets = stored(_with_buckets(marked, open_bands, ["band"]).select("id", "band", "n", "label"), "buckets")
        if settling or buckets.isEmpty():
            break
        settling = found.count() * 10 <= pairs.count()
    if labels is not None:
        members = members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", F.coalesce("label", "rep").alias("rep"))
    return members.groupBy("id").agg(F.min("rep").alias("class_id")).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id."""
    classes = near_duplicate_classes(docs, id_col=id_col, **options)
    gone = classes.filter(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
