"""First-fit-decreasing sequence packing with a tournament tree of bin capacities.

Each document's token ids, closed by ``end_id``, are cut into pieces of at most ``length``.  Documents
are dealt at random to groups of about ``group_pieces`` pieces; each group is packed on its own by first-fit
decreasing, the first bin with room being found by descending a tournament tree of the room left.

Nulls and edge cases: a null text is an empty one, which gives the end id alone; a null id is carried
along; equal rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import by_batches, plain_text, slices, stored

#: Characters whose handling could differ between Python's and the tokenizer's own Unicode tables.
_UNUSUAL = re.compile("[^\t\n\r -\x7e\xa1-\u02ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|[\u0130\xaa\xba]")


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as 256, 257, ... in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


#: Steps of the vocabularies whose chunks between white space can be encoded one by one.
_BY_CHUNK = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class ChunkTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A vocabulary that lower-cases, splits at white space and then by a pattern, and merges bytes, lets
    each chunk between white space be encoded by itself: its ids are looked up in a bounded cache,
    and made by the vocabulary's own merges where they are not held.  A text with a character outside
    the plainly mapped ranges or with the name of an added token, and any text of another kind of
    vocabulary, goes to the tokenizer whole.  When a cache is full it becomes the old one, from which
    chunks that come again are taken over.
    """

    def __init__(self, path: str, held: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.held, self.cache, self.old, self.words = self.tokenizer.model, held, {}, {}, {}
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.names = sorted({x for t in made.get("added_tokens") or () for x in (t["content"], t["content"].lower())})
        normal = (made.get("normalizer") or {}).get("normalizers", [])
        first, *others = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "Regex" in first["pattern"]
        plain = not made.get("post_processor") and not made["model"].get("dropout") and made["model"]["type"] == "BPE"
        self.by_chunk = bool(splits and plain and normal + others == _BY_CHUNK)
        if self.by_chunk:
            self.pattern, self.alphabet = regex.compile(first["pattern"]["Regex"]), _byte_alphabet()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = self.words[word] = np.asarray([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """A letter run is one word; the pattern cuts the others."""
        return self._word(chunk) if chunk.isascii() and chunk.isalpha() else b"".join(map(self._word, self.pattern.findall(chunk)))

    def _chunks(self, text: str) -> list[str] | None:
        """The chunks of a text that can be encoded one by one."""
        if not self.by_chunk or _UNUSUAL.search(text):
            return None
        lower = text.lower()
        return None if any(x in text or x in lower for x in self.names) else lower.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.held:
            self.cache, self.old = {}, self.cache
        if len(self.words) > self.held:
            self.words = {}
        split = [self._chunks(x) for x in texts]
        for chunk in set(itertools.chain.from_iterable(x for x in split if x)):
            if chunk not in self.cache:
                ids = self.old.get(chunk)
                self.cache[chunk] = self._chunk(chunk) if ids is None else ids
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) if x is not None else self._whole(t) for t, x in zip(texts, split, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, so that its cache serves all tasks that run there."""
    return ChunkTokenizer(path)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size.  The tree's leaves are the bins' room, its nodes the larger child."""
    n = max(1, len(sizes))
    leaves = 1 << (n - 1).bit_length()
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens and a salt, the document's number in its task."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "salt")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, salt = chunk_tokenizer(tokenizer_path), np.asarray([end_id], "<u4").tobytes(), 0
        for part in slices(batches):
            owner, rows = [], []
            for row, ids in enumerate(encode(part.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, length):
                    piece = ids[4 * at : 4 * (at + length)]
                    owner.append(row)
                    rows.append((at, len(piece) // 4, zlib.crc32(piece), total, salt + row))
            salt += part.num_rows
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns], names=schema.names)

    return by_batches(docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text")), cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece with its ``sequence_id`` and its ``offset`` there.

    A document's pieces go to one group, ``group_pieces`` at a time.  Sequence ids are unique in the result: the group's
    number in the upper, the bin in the lower half.
    """
    cut = stored(pieces(docs, tokenizer_path, length, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    part = F.floor(F.col("start") / F.lit(length * group_pieces))
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "salt", part), F.lit(groups)))
    schema = T.StructType([f for f in cut.schema.fields if f.name not in ("salt", "group")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), length)
        out = rows.select(schema.names[:-2])
        return out.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    return cut.groupBy("group").applyInArrow(fit, schema)
