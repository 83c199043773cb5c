"""Toxicity scores: gradient-boosted trees over dense lexical features, calibrated isotonically.

Fitting takes a bounded sample of labelled rows (``max_labelled``, by a hash of the id): a lexicon of
words and word beginnings that toxic documents use far more often than others, then trees on the
sample's features, then an isotonic fit on rows that the trees have not seen.  The lexicon that makes
a sample row's features is learned from the other half of the sample.  Scoring covers whole texts of
all rows, in the tasks that read them; labels, language, source and id are no inputs of a score.

Nulls and edge cases: a null or empty text gets the score of an empty text; a null label is not
learned from; without rows of both labels the score is 0 for all; equal texts have equal scores; where
labels of one id differ it is toxic; of equally good splits the first feature and the lowest bin win; an
empty table gives an empty result; all columns of the input are kept, but for one that has the score's name.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import by_batches, byte_texts, fold, fresh, plain_text, slices, with_column

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?"
SYMBOLS = b"#*$%&@|<>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
#: Digits and signs that stand for letters in disguised words.
_UNMASK = bytes.maketrans(b"013457@$!", b"oieastasi")
_MASKED = re.compile(rb"[a-z]+[013457@$!*]+[a-z]+")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti te tus usted ustedes vosotros".encode().split())
NEAR = 5
BEGINNINGS = (5, 6, 7, 8)  # bytes

FEATURES = ("log_words", "hits", "density", "weight", "strongest", "kinds", "near_you", "you", "capitals", "marks", "symbols", "masked", "masked_hits", "word_length")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


def units(word: bytes) -> list[bytes]:
    """What a lexicon can hold of a word: the word itself, and its longer beginnings with a mark."""
    return [word, *(word[:n] + b"~" for n in BEGINNINGS if len(word) > n)]


class _Weights(dict):
    """Weight of a word by the heaviest of its units, kept for the words met so far."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        return value


def features(text: bytes, weights: _Weights) -> list[float]:
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(w)
    you = np.flatnonzero(np.fromiter(map(SECOND_PERSON.__contains__, words), bool, len(words)))
    before, after = np.concatenate([[-np.inf], at, [np.inf]])[np.searchsorted(at, you) + np.array([[0], [1]])]
    near = int((np.minimum(you - before, after - you) <= NEAR).sum())
    masked = [m.translate(_UNMASK).replace(b"*", b"") for m in _MASKED.findall(text.lower())]
    count = lambda some: size - len(text.translate(None, some)) - (size - len(text))
    return [
        np.log1p(len(words)), np.log1p(len(at)), len(at) / n, w.sum() / n, w.max(initial=0), len({words[i] for i in at}), near, len(you) / n,
        count(UPPER) / size, count(MARKS) / size, count(SYMBOLS) / size, len(masked) / n, sum(weights[m] > 0 for m in masked), len(text) / n if len(words) else 0.0,
    ]


# ---- trees --------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Depth-limited regression trees on binned features: for each, split feature and bin by node, and leaf values."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                node = 2 * node + 1 + (bins[rows, f[node]] > c[node])
            total += v[node - len(f)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, leaf_weight: float = 2.0, n_bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, out = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, n_bins + 1, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                inside = node == k
                best = 1e-3
                gs, hs = g[inside], h[inside]
                whole = gs.sum() ** 2 / (hs.sum() + leaf_weight)
                for j, e in enumerate(edges):
                    gc = np.bincount(bins[inside, j], gs, len(e) + 1).cumsum()[:-1]
                    hc = np.bincount(bins[inside, j], hs, len(e) + 1).cumsum()[:-1]
                    if len(gc):
                        gain = gc**2 / (hc + leaf_weight) + (gs.sum() - gc) ** 2 / (hs.sum() - hc + leaf_weight) - whole
                        if gain.max() > best:
                            best, feature[k], cut[k] = gain.max(), j, int(gain.argmax())
            node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - len(feature)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + leaf_weight)
        margin += value[leaf]
        out.append((feature, cut, value))
    return Trees(edges, *(np.stack([o[i] for o in out]) for i in range(3)), start)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values, drawn in from 0 and 1 by one pseudo-row."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    share = float(y.mean())
    knots = np.array([b[i] for b in blocks for i in (2, 3)])
    values = np.maximum.accumulate(np.array([(b[0] + share) / (b[1] + 1) for b in blocks for _ in (2, 3)]))
    return knots, values


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[bytes], weights: _Weights) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        margin = self.trees.margins(np.array([features(t, weights) for t in texts]))
        # The margin itself breaks the ties inside a calibrated step, without leaving it.
        return np.clip(np.interp(margin, self.knots, self.values) * 0.999 + 0.001 / (1 + np.exp(-margin)), 0, 1)

    def apply(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with the score of each row's text appended."""
        model = self
        schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = _Weights(model.lexicon)
            for part in slices(batches):
                out = with_column(part, name, pa.array(model.scores(byte_texts(part.column(text_col)), weights)))
                yield out.select(schema.names)

        return by_batches(docs, score, schema)


def _lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, at_least: int = 3, lift: float = 8.0, most: int = 5000) -> dict[bytes, float]:
    """Units in ``at_least`` toxic documents and ``lift`` times likelier there; the weight is the smoothed log ratio."""
    out = {}
    for unit, n in toxic.items():
        if n >= at_least:
            ratio = ((n + 0.5) / (n_toxic + 1)) / ((clean[unit] + 0.5) / (n_clean + 1))
            if ratio >= lift:
                out[unit] = float(np.log(ratio))
    return dict(sorted(out.items(), key=lambda x: (-x[1] * np.log1p(toxic[x[0]]), x[0]))[:most])


def fit(docs: DataFrame, labels: DataFrame, train: str | None = None, max_labelled: int = 8000, max_units: int = 50_000, max_lexicon: int = 5000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled rows for which the SQL condition ``train`` (over the id) holds.

    What comes back to the driver is bounded: the counts of the ``max_units`` units that most toxic rows
    of the sample have (ties by the unit), and a row of features for each document of the sample.  The
    lexicon takes the ``max_lexicon`` strongest of those units.
    """
    known = labels.filter(f"{label_col} is not null and {id_col} is not null")
    known = (known.filter(train) if train else known).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    part = lambda name, n: F.crc32(F.concat(F.lit(name), F.col("id").cast("string")).cast("binary")) % n
    joined = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = joined.select("text", "label", part("half", 2).cast("int").alias("half"), (part("fit", 4) == 0).alias("calibrates"))

    sizes = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = (sum(n for (_, label), n in sizes.items() if bool(label) == side) for side in (True, False))
    if not n_toxic or not n_clean:
        return ToxicityModel({}, None, np.zeros(1), np.zeros(1))

    def counts(only: frozenset | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for part in slices(batches):
                for text, half in zip(byte_texts(part.column("text")), part.column("half").to_pylist(), strict=True):
                    own = set(itertools.chain.from_iterable(map(units, set(words_of(text)))))
                    seen[half].update(own if only is None else own & only)
            for half, counter in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([half] * len(counter), pa.int32()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["half", "unit", "n"])

        return count

    def gathered(label: bool, only: frozenset | None) -> dict[int, Counter]:
        found = by_batches(rows.filter(F.col("label").cast("boolean") == label), counts(only), "half int, unit binary, n long").groupBy("half", "unit").agg(F.sum("n").alias("n"))
        by_unit = found.groupBy("unit").agg(F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("half") == 1, F.col("n")).otherwise(0)).alias("n1"))
        out = {0: Counter(), 1: Counter()}
        for r in (by_unit.filter("n0 >= 2 or n1 >= 2").orderBy(F.desc(F.col("n0") + F.col("n1")), "unit").limit(max_units) if only is None else by_unit).collect():
            out[0][bytes(r["unit"])], out[1][bytes(r["unit"])] = r["n0"], r["n1"]
        return out

    toxic = gathered(True, None)
    clean = gathered(False, frozenset(toxic[0]) | frozenset(toxic[1]))
    other = [_lexicon(toxic[1 - h], clean[1 - h], sizes.get((1 - h, 1), 0), sizes.get((1 - h, 0), 0), at_least=2, most=max_lexicon) for h in (0, 1)]
    full = _lexicon(toxic[0] + toxic[1], clean[0] + clean[1], n_toxic, n_clean, most=max_lexicon)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [_Weights(x) for x in other]
        for part in slices(batches):
            found = [features(t, weights[h]) for t, h in zip(byte_texts(part.column("text")), part.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("calibrates"), pa.array(found, pa.list_(pa.float64()))], names=["label", "calibrates", "x"])

    table = by_batches(rows, describe, "label int, calibrates boolean, x array<double>").toPandas()
    table = table.iloc[np.lexsort(np.stack(table["x"].to_numpy()).T)]  # the order of rows does not depend on the run
    x, y, calibrates = np.stack(table["x"].to_numpy()), (table["label"].to_numpy() > 0).astype(float), table["calibrates"].to_numpy(bool)
    if not 0 < y[~calibrates].mean() < 1 or not calibrates.any():
        calibrates = np.zeros(len(y), bool)
    trees = fit_trees(x[~calibrates], y[~calibrates])
    on = calibrates if calibrates.any() else ~calibrates
    return ToxicityModel(full, trees, *fit_isotonic(trees.margins(x[on]), y[on]))


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows that score ``at`` or more; labels of all rows may be learned from."""
    name = fresh("toxicity", docs.columns)
    return fit(docs, labels, **options).apply(docs, name=name).filter(F.col(name) < at).drop(name)


def held_out(id_col: str = "doc_id"):
    """Whether labels of the row are never learned from; true for a null id."""
    return F.coalesce(fold(id_col, 5) == 0, F.lit(True))
