"""Language-model scoring with Elias-Fano n-gram tries.

Documents are tokenised once into *blocks*: the distinct words of a few megabytes of text and the
documents as indices into them, written to the shared folder.  Each block sends its distinct words
with their training counts to the shards that the words' hashes name; a shard sums them, numbers the
words by falling count and answers.  Then each block sends its distinct n-grams of known words, as
numbers, to the shard that the hash of the whole n-gram names, so that no frequent word or context
makes a large shard.  A shard sums the counts and stores its n-grams as a trie for each length (the
successors of all nodes as one monotone Elias-Fano sequence, delimited by monotone pointers, beside
quantised log probabilities, in memory-mapped files), and finds all n-grams that it was asked for, in
order, by searching successors relative to their context.  A message holds all that a block asks of a
shard: there is at most one for each distinct n-gram of a block, so that messages, like n-grams, grow
no faster than the text.

The model interpolates all orders (Jelinek and Mercer) over add-one word probabilities:

    p(w | h) = (1 - b) c(hw) / c(h) + b p(w | h'),    p(w | h) = p(w | h') if c(h) = 0

b depends on the order and on the power of two below c(h): it is the share of training tokens after
such contexts whose n-gram occurs once, which is the share that would be new if its token were left
out.  The sum of p over all words, one unknown word included, is 1 up to quantisation.

Nothing is pruned or capped: the tries grow with the corpus and are spread over the shards, whose
number follows that of the tokens.

Nulls and edge cases: a null text is an empty one (one end token); a null id is held out; equal rows
are scored alike; a very long text is a block by itself; equal counts are numbered in the order of
their words; an empty table gives an empty result; with no training document every word is unknown
(N = V = 0).
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm._common import byte_texts, discard, fold, plain_text, slices, stored

END = b""  # no word is empty
START = 0  # the number of the mark before a document; words are numbered from 1
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 3 << 18  # tokens of the corpus for each shard
CODES = 1 << 16  # levels of the quantised log probabilities
LOWEST = -16.0
BUCKETS = 64  # powers of two


class EliasFano:
    """A sorted sequence of non-negative 64-bit integers below ``universe``, in about 2 + log2(u/n) bits each.

    For each SEGMENT of values the place of its first one in the upper bits and its first value are sampled.
    """

    SEGMENT = 4096
    _PARTS = ("low", "high", "places", "firsts")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray, firsts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places, self.firsts = n, low_bits, low, high, places, firsts

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values).astype("<u8")
        n = len(values)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        lows = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, count=low_bits, bitorder="little") if low_bits else np.zeros(0, np.uint8)
        return cls(n, low_bits, np.packbits(lows.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), places[:: cls.SEGMENT], values[:: cls.SEGMENT])

    def write(self, path: str) -> None:
        for part in self._PARTS:
            np.save(f"{path}.{part}.npy", getattr(self, part))
        np.save(f"{path}.size.npy", np.asarray([self.n, self.low_bits]))

    @classmethod
    def mapped(cls, path: str) -> EliasFano:
        n, low_bits = np.load(f"{path}.size.npy").tolist()
        return cls(n, low_bits, *(np.load(f"{path}.{part}.npy", mmap_mode="r") for part in cls._PARTS))

    def segment(self, k: int) -> np.ndarray:
        """The values of segment ``k``: the ones of its upper bits, then the lower bits."""
        first = k * self.SEGMENT
        count = min(self.SEGMENT, self.n - first)
        begin = int(self.places[k])
        end = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin >> 3 : (end >> 3) + 1], bitorder="little")) + (begin >> 3) * 8
        ones = ones[np.searchsorted(ones, begin) :][:count]
        values = (ones - first - np.arange(count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = first * self.low_bits // 8  # SEGMENT is a multiple of 8
            bits = np.unpackbits(self.low[at : at + (count * self.low_bits + 7) // 8], count=count * self.low_bits, bitorder="little")
            wide = np.zeros((count, 64), np.uint8)
            wide[:, : self.low_bits] = bits.reshape(count, self.low_bits)
            values |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
        return values

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at the given ascending positions."""
        out = np.zeros(len(at), np.uint64)
        for k, some in _runs(at // self.SEGMENT):
            out[some] = self.segment(k)[at[some] - k * self.SEGMENT]
        return out

    def successor(self, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Position of the first value >= wanted in [begin, end); ``wanted`` ascends."""
        out = np.zeros(len(wanted), np.int64)
        for k, some in _runs(np.maximum(np.searchsorted(self.firsts, wanted) - 1, 0)):
            out[some] = np.searchsorted(self.segment(k), wanted[some]) + k * self.SEGMENT
        return np.clip(out, begin, end)


def _runs(which: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of an ascending array and its place."""
    cuts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
    for lo, hi in itertools.pairwise([*cuts, len(which)]):
        yield int(which[lo]), slice(lo, hi)


def encode_weight(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities: 0 for zero, else steps of the base-10 logarithm from LOWEST to 0."""
    with np.errstate(divide="ignore"):
        steps = np.rint((np.log10(p) - LOWEST) / -LOWEST * (CODES - 2)) + 1
    return np.where(p > 0, np.clip(steps, 1, CODES - 1), 0).astype(np.uint16)


def decode_weight(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (LOWEST - LOWEST * (code.astype(np.float64) - 1) / (CODES - 2)), 0.0)


class Trie:
    """n-grams of one length with a quantised probability each, in memory-mapped files.

    The first level has the first words.  A node's successors lie between two pointers; a successor is
    its word plus ``radix`` times its context's node, so that a level is monotone.
    """

    def __init__(self, first: EliasFano, levels: list[tuple[EliasFano, EliasFano]], radix: int, codes: np.ndarray):
        self.first, self.levels, self.radix, self.codes = first, levels, radix, codes

    @classmethod
    def build(cls, grams: list[np.ndarray], codes: np.ndarray, radix: int, folder: str) -> Trie:
        """``grams``: a column of word numbers below ``radix`` for each place; rows are distinct and sorted, and there is one at least."""

        def mapped(name: str, values: np.ndarray, universe: int) -> EliasFano:
            EliasFano.build(values, universe).write(os.path.join(folder, name))
            return EliasFano.mapped(os.path.join(folder, name))

        new = np.diff(grams[0], prepend=-1) != 0
        parent, levels = np.cumsum(new) - 1, []
        first = mapped("0", grams[0][new], radix)
        for k, column in enumerate(grams[1:], 1):
            new = new | (np.diff(column, prepend=-1) != 0)
            owner, nodes = parent[new], int(parent[-1]) + 1
            pointers = np.searchsorted(owner, np.arange(nodes + 1))
            ids = owner.astype(np.uint64) * np.uint64(radix) + column[new].astype(np.uint64)
            levels.append((mapped(f"{k}.ids", ids, nodes * radix), mapped(f"{k}.pointers", pointers, len(ids) + 1)))
            parent = np.cumsum(new) - 1
        np.save(os.path.join(folder, "codes.npy"), codes)
        return cls(first, levels, radix, np.load(os.path.join(folder, "codes.npy"), mmap_mode="r"))

    @staticmethod
    def _find(sequence: EliasFano, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = sequence.successor(begin, end, wanted)
        found = at < end
        found[found] = sequence.access(at[found]) == wanted[found]
        return at, found

    def lookup(self, grams: list[np.ndarray]) -> np.ndarray:
        """Codes of sorted n-grams, 0 for those that are not there."""
        live = np.arange(len(grams[0]))
        node, found = self._find(self.first, np.zeros(len(live), np.int64), np.full(len(live), self.first.n), grams[0].astype(np.uint64))
        live, node = live[found], node[found]
        for (ids, pointers), column in zip(self.levels, grams[1:], strict=True):
            begin, end = (pointers.access(node + d).astype(np.int64) for d in (0, 1))
            wanted = node.astype(np.uint64) * np.uint64(self.radix) + column[live].astype(np.uint64)
            node, found = self._find(ids, begin, end, wanted)
            live, node = live[found], node[found]
        out = np.zeros(len(grams[0]), np.uint16)
        out[live] = self.codes[node]
        return out


# ---- packed columns of numbers ------------------------------------------------------------------


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(*columns: np.ndarray) -> bytes:
    """Non-negative numbers, a plane for each byte that any of a column's needs."""
    parts = [np.asarray([len(columns[0])], "<u8").tobytes()]
    for column in columns:
        width = (int(column.max(initial=0)).bit_length() + 7) // 8
        planes = np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        parts += [bytes([width]), planes.tobytes()]
    return _squeeze(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = _expand(data)
    n, at, out = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    while at < len(data):
        width = data[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(wide.view("<i8").ravel())
        at += 1 + n * width
    return out


def _keys(columns: list[np.ndarray], radix: int) -> np.ndarray:
    """A number for each row of numbers below ``radix``, equal for equal rows and in their order."""
    key, size = columns[0], radix
    for column in columns[1:]:
        if size * radix >= 1 << 63:
            held, key = np.unique(key, return_inverse=True)
            size = len(held)
        key, size = key * radix + column, size * radix
    return key


# ---- blocks -----------------------------------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str, text_col: str, train: str) -> DataFrame:
    """Documents as blocks of at most about BLOCK_BYTES of text."""
    kind, binary = docs.schema[id_col].dataType, T.BinaryType()
    schema = T.StructType(
        [T.StructField(x, T.LongType()) for x in ("block", "n_tokens", "n_train", "n_train_docs")]
        + [T.StructField(x, binary) for x in ("words", "counts", "stream", "ends")]
        + [T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("ids", T.ArrayType(kind))]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 40, [], 0
        for part in slices(batches):
            for doc_id, text, mark in zip(part.column(0).to_pylist(), byte_texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                if held and size + len(text) > BLOCK_BYTES:
                    yield _encode(number, held, schema)
                    number, held, size = number + 1, [], 0
                held.append((doc_id, text, bool(mark)))
                size += len(text)
        if held:
            yield _encode(number, held, schema)

    chosen = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    return chosen.mapInArrow(make, schema)


def _encode(number: int, held: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """One block.  Its words are in the order of their hashes, so that each shard's are together."""
    index: dict[bytes, int] = {END: 0}
    stream = [np.asarray([*[index.setdefault(w, len(index)) for w in text.lower().split()], 0], np.int64) for _, text, _ in held]
    sizes, marks = np.asarray([len(s) for s in stream]), np.asarray([h[2] for h in held], bool)
    words, tokens = list(index), np.concatenate(stream)
    order = np.argsort(_hashes(words))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    tokens, trained = place[tokens], np.repeat(marks, sizes)
    counts = np.bincount(tokens[trained], minlength=len(words))
    numbers = (number, len(tokens), int(trained.sum()), int(marks.sum()))
    binaries = (_squeeze(b"\n".join([words[i] for i in order.tolist()])), _pack(counts), _pack(tokens), _pack(sizes))
    columns = [pa.array([x], pa.int64()) for x in numbers] + [pa.array([x], pa.binary()) for x in binaries]
    columns += [pa.array([marks.tolist()], pa.list_(pa.bool_())), pa.array([[h[0] for h in held]], pa.list_(to_arrow_type(schema["ids"].dataType.elementType)))]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


_WORDS = {"shard": pa.int32(), "block": pa.int64(), "words": pa.binary(), "counts": pa.binary()}
_NUMBERS = {"shard": pa.int32(), "block": pa.int64(), "n": pa.int64(), "data": pa.binary()}
_WORDS_DDL, _NUMBERS_DDL = "shard int, block long, words binary, counts binary", "shard int, block long, n long, data binary"


def _word_sender(shards: int):
    """Each block's words and training counts, for the shards that their hashes name."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            words, (counts,) = _expand(row["words"]).split(b"\n"), _unpack(row["counts"])
            shard = (_hashes(words) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            out = [(s, row["block"], _squeeze(b"\n".join(words[some])), _pack(counts[some])) for s, some in _runs(shard.astype(np.int64))]
            yield from _rows(out, _WORDS).to_batches()

    return send


def _word_counter(shards: int):
    """Number a shard's words: the k-th commonest gets 1 + shard + k * shards.  Rows: (numbers, counts) for each block, words in ``n`` for none."""

    def number(key: tuple, table: pa.Table) -> pa.Table:
        shard, rows = key[0].as_py(), table.to_pylist()
        lists = [_expand(r["words"]).split(b"\n") for r in rows]
        encoded = pa.array(itertools.chain.from_iterable(lists), pa.binary()).dictionary_encode()
        at, words = encoded.indices.to_numpy(), encoded.dictionary
        counts = np.bincount(at, np.concatenate([_unpack(r["counts"])[0] for r in rows]), len(words)).astype(np.int64)
        order = pc.sort_indices(pa.table({"n": -counts, "word": words}), [("n", "ascending"), ("word", "ascending")]).to_numpy()
        ids = np.zeros(len(words), np.int64)
        ids[order] = np.arange(len(words)) * shards + shard + 1
        ids[counts == 0] = 0
        ends = np.cumsum([len(x) for x in lists])
        out = [(shard, r["block"], 0, _pack(ids[some], counts[some])) for r, some in zip(rows, np.split(at, ends[:-1]), strict=True)]
        return _rows([*out, (shard, None, int((counts > 0).sum()), None)], _NUMBERS)

    return number


# ---- n-grams ----------------------------------------------------------------------------------


class _Block:
    """A block's tokens and its words' numbers and counts."""

    def __init__(self, row: dict, replies: list[dict]):
        (self.stream,), (self.sizes,) = _unpack(row["stream"]), _unpack(row["ends"])
        self.marks = np.asarray(row["train"], bool)
        self.trained = np.repeat(self.marks, self.sizes)
        self.first = np.zeros(len(self.stream), bool)  # of a document
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        numbered = [_unpack(r["data"]) for r in sorted((r for r in replies if r["n"] == 0), key=lambda r: r["shard"])]
        ids, self.counts = (np.concatenate([x[i] for x in numbered]) for i in (0, 1))
        self.ids, self.known = np.append(ids, START), np.append(ids > 0, True)  # the last is the start mark

    def grams(self, n: int, shards: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of known words (a column for each place), by shard and first word; their training counts and shards, and each token's place among them, -1 for others."""
        start, columns = len(self.ids) - 1, [self.stream]
        for _ in range(n - 1):
            columns.insert(0, np.where(self.first, start, np.concatenate([[start], columns[0][:-1]])))
        _, first, inverse = np.unique(_keys(columns, start + 1), return_index=True, return_inverse=True)
        counts = np.bincount(inverse[self.trained], minlength=len(first))
        kept = np.flatnonzero(np.logical_and.reduce([self.known[c[first]] for c in columns]))
        named = [self.ids[c[first[kept]]] for c in columns]
        shard = _shard_of(named, shards)
        order = np.lexsort((named[0], shard))
        place = np.full(len(first), -1)
        place[kept[order]] = np.arange(len(kept))
        return [c[order] for c in named], counts[kept[order]], shard[order], place[inverse]


def _shard_of(grams: list[np.ndarray], shards: int) -> np.ndarray:
    """Shard of each n-gram, by a hash of all its words."""
    h = np.zeros(len(grams[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in grams:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def _asker(order: int, shards: int):
    """The n-grams of each length that a block asks of each shard, with their training counts."""

    def ask(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        held, out = _Block(block.to_pylist()[0], replies.to_pylist()), []
        for n in range(2, order + 1):
            columns, counts, shard, _ = held.grams(n, shards)
            for s, some in _runs(shard):
                out.append((s, key[0].as_py(), n, _pack(np.diff(columns[0][some], prepend=0), *(c[some] for c in columns[1:]), counts[some])))
        return _rows(out, _NUMBERS)

    return ask


def _answerer(n_all: int):
    """Build a shard's tries and look up all that was asked."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for n in sorted({r["n"] for r in rows}):
            asked = [r for r in rows if r["n"] == n]
            parts = [_unpack(r["data"]) for r in asked]
            columns = [np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(n)]
            radix = max(int(c.max()) for c in columns) + 1
            _, first, inverse = np.unique(_keys(columns, radix), return_index=True, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[n] for p in parts]), len(first))
            grams, held = [c[first] for c in columns], counts > 0
            codes = np.zeros(len(first), np.uint16)
            if held.any():
                with tempfile.TemporaryDirectory() as folder:  # this task's own; a task that runs again builds it again
                    trie = Trie.build([g[held] for g in grams], encode_weight(counts[held] / n_all), radix, folder)
                    codes = trie.lookup(grams)
            ends = np.cumsum([len(p[n]) for p in parts])
            out += [(key[0].as_py(), r["block"], n, _pack(codes[some])) for r, some in zip(asked, np.split(inverse, ends[:-1]), strict=True)]
        return _rows(out, _NUMBERS)

    return answer


_RESOLVED = ("block", "train", "ids", "ends", "tokens", "stats")


def _resolver(order: int, shards: int, n_all: int, n_docs: int):
    """Each token's counts of all orders, and for each order and bucket of contexts the training tokens and those whose n-gram occurs once."""

    def resolve(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        answers = replies.to_pylist()
        held = _Block(block.to_pylist()[0], answers)
        counts, stats = [held.counts[held.stream]], []
        for n in range(2, order + 1):
            _, _, shard, place = held.grams(n, shards)
            got = {r["shard"]: r["data"] for r in answers if r["n"] == n}
            codes = np.concatenate([*(_unpack(got[s])[0] for s, _ in _runs(shard)), [0]])
            counts.append(np.rint(decode_weight(codes) * n_all).astype(np.int64)[place])
            b = _bucket(_context(counts[-2], held.first, n_docs))[held.trained]
            stats += [np.bincount(b, minlength=BUCKETS), np.bincount(b, counts[-1][held.trained] == 1, BUCKETS)]
        columns = [block.column("block"), block.column("train"), block.column("ids"), block.column("ends")]
        columns += [pa.array([_pack(*counts)], pa.binary()), pa.array([np.concatenate(stats).tolist()], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=list(_RESOLVED))

    return resolve


def _context(counts: np.ndarray, first: np.ndarray, n_docs: int) -> np.ndarray:
    """Count of each token's context: of what ends at the token before, and at first of the start marks."""
    return np.where(first, n_docs, np.concatenate([[0], counts[:-1]]))


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


def token_probabilities(counts: list[np.ndarray], first: np.ndarray, backoff: np.ndarray, n_all: int, n_words: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Add-one and interpolated probability of each token; ``backoff`` has a row of buckets for each order from 2."""
    p = base = (counts[0] + 1) / (n_all + n_words + 1)
    for n in range(1, len(counts)):
        context = _context(counts[n - 1], first, n_docs)
        b = backoff[n - 1][_bucket(context)]
        seen = np.minimum(counts[n] / np.maximum(context, 1), 1.0)
        p = np.where(context > 0, (1 - b) * seen + b * p, p)
    return base, p


def _scorer(backoff: np.ndarray, n_all: int, n_words: int, n_docs: int, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            counts, (sizes,) = _unpack(row["tokens"]), _unpack(row["ends"])
            first = np.zeros(len(counts[0]), bool)
            first[np.cumsum(sizes) - sizes] = True
            base, p = token_probabilities(counts, first, backoff, n_all, n_words, n_docs)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            known, base, p = (np.bincount(owner, x, len(sizes)) for x in (counts[0] > 0, np.log10(base), np.log10(p)))
            ids = part.column("ids").flatten()
            numbers = (sizes, known.astype(np.int64), np.full(len(sizes), n_all), base, p)
            yield pa.RecordBatch.from_arrays([ids, part.column("train").flatten(), *map(pa.array, numbers)], names=names)

    return score


class NGramModel:
    """Fits an n-gram model on the marked rows of a table and scores all its rows."""

    def __init__(self, order: int = 3):
        if order < 2:
            raise ValueError("order must be at least 2")
        self.order = order

    def score(self, docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

        ``train`` is a SQL condition: the rows to learn from.
        """
        order, kind = self.order, docs.schema[id_col].dataType
        blocks = stored(_blocks(docs, id_col, text_col, train), "lm-blocks")
        sums = blocks.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_train", "n_train_docs")]).first()
        n_tokens, n_all, n_docs = (int(x or 0) for x in sums)
        shards = max(1, -(-n_tokens // SHARD_TOKENS))
        sent = blocks.select("block", "words", "counts").mapInArrow(_word_sender(shards), _WORDS_DDL)
        words = stored(sent.groupBy("shard").applyInArrow(_word_counter(shards), _NUMBERS_DDL), "lm-words")
        n_words = int(words.filter("block is null").agg(F.sum("n")).first()[0] or 0)
        numbered, texts = words.filter("block is not null"), blocks.select("block", "stream", "ends", "train", "ids")
        asked = texts.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(_asker(order, shards), _NUMBERS_DDL)
        counts = stored(asked.groupBy("shard").applyInArrow(_answerer(n_all), _NUMBERS_DDL), "lm-counts")
        kinds = {"block": T.LongType(), "train": T.ArrayType(T.BooleanType()), "ids": T.ArrayType(kind)}
        kinds |= {"ends": T.BinaryType(), "tokens": T.BinaryType(), "stats": T.ArrayType(T.DoubleType())}
        replies = numbered.unionByName(counts).groupBy("block")
        resolved = texts.groupBy("block").cogroup(replies).applyInArrow(_resolver(order, shards, n_all, n_docs), T.StructType([T.StructField(x, kinds[x]) for x in _RESOLVED]))
        resolved = stored(resolved, "lm-tokens")
        discard(blocks, words, counts)
        stats = np.zeros((order - 1) * 2 * BUCKETS)
        for r in resolved.select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each order and bucket
            stats[r["at"]] = r["n"]
        seen, once = np.moveaxis(stats.reshape(order - 1, 2, BUCKETS), 1, 0)
        fields = {"doc_id": kind, "trained": T.BooleanType(), **dict.fromkeys(("n_tokens", "n_known", "train_tokens"), T.LongType()), **dict.fromkeys(("base_score", "score"), T.DoubleType())}
        schema = T.StructType([T.StructField(name, field) for name, field in fields.items()])
        return resolved.select("train", "ids", "ends", "tokens").mapInArrow(_scorer((once + 0.5) / (seen + 1), n_all, n_words, n_docs, schema.names), schema)


def score_corpus(docs: DataFrame, modulus: int = 7, held_out: int = 2, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model of those whose id's crc32 is not ``held_out`` modulo ``modulus``."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return NGramModel(order).score(chosen.withColumn("learn", fold("doc_id", modulus) != held_out), "learn")
