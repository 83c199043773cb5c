"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

Every line of a text becomes a few numbers (length, shares of letters, capitals, digits and symbols,
repetition).  Viterbi decoding finds the best labelling of all lines; a document stays if no base
rule rejects it and at least ``least_share`` of its characters are in content lines.

The weights are fitted on at most ``max_labelled`` documents whose quality label is known (by a hash of
the id).  A label of a document says nothing of a single line, so the lines' labels are latent: those of
good documents are content; of a bad document each line is boilerplate that the present model calls so,
and the likeliest one in any case.  Labelling and fitting alternate, the chain's likelihood being raised by
gradient ascent over all lines, in successive runs of ``RUN`` lines.  The least content share that keeps
a document is the one that parts good and bad documents of the sample best.

Nulls and edge cases: a null or empty text has no words, fails the base rules and is not kept; ids
are carried along, nulls too; without labels of both kinds the model calls every line content; equal
texts have equal results, and of two lines or labellings that are equally likely the content one wins; an
empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import byte_texts, plain_text, slices

SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_CONTINUATION = bytes(range(128, 192))
RUN = 64


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUATION)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else ()
    repeated = 0
    if len(words) > 3:
        numbers: dict[bytes, int] = defaultdict(counter().__next__)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        _, place, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[place] > 1
        covered = np.zeros(len(words), bool)
        for d in range(3):
            covered[d : d + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of numbers for each line."""
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        words = line.split()
        n, w = max(1, len(line)), max(1, len(words))
        letters = n - len(line.translate(None, _LETTERS))
        upper = len(re.findall(rb"[A-Z]", line)) if letters else 0
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        distinct = len(set(words)) / w
        shares = (letters / n, upper / n, symbols / w, line.count(b"!") / w, 1 - distinct)
        marks = (distinct < 0.3 and w > 10, line in seen and w > 2, w < 3, symbols > 0.3 * w, upper > 0.5 * letters)
        rows.append((1.0, np.log1p(len(words)) / 5, *shares, *map(float, marks)))
        seen.add(line)
    return np.array(rows)


@dataclass
class LineModel:
    """Weights of the boilerplate label by feature, and transitions between (content, boilerplate)."""

    weights: np.ndarray
    transitions: np.ndarray
    least_share: float = 0.5

    def boilerplate(self, lines: list[bytes]) -> list[bool]:
        """The Viterbi labelling."""
        return self.decode(line_features(lines))

    def decode(self, features: np.ndarray) -> list[bool]:
        scores = (features @ self.weights).tolist()
        (a, b), (c, d) = self.transitions.tolist()
        content, boiler, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_c, from_b = content + a >= boiler + c, content + b >= boiler + d
            back.append((from_c, from_b))
            content, boiler = (content + a if from_c else boiler + c), (content + b if from_b else boiler + d) + s
        label = boiler > content
        out = [label]
        for from_c, from_b in reversed(back):
            label = not (from_b if label else from_c)
            out.append(label)
        return out[::-1]

    def content_share(self, text: bytes) -> float:
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        if not lines:
            return 0.0
        marks = self.boilerplate(lines)
        return sum(len(x) for x, m in zip(lines, marks, strict=True) if not m) / sum(map(len, lines))


def _padded(runs: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray) -> list[tuple]:
    """Runs of like lengths as arrays: features, mask, labels and weights."""
    out = []
    sizes = np.array([1 << (len(r) - 1).bit_length() for r in runs])
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        x, mask, y = np.zeros((len(some), size, runs[0].shape[1])), np.zeros((len(some), size), bool), np.zeros((len(some), size), np.int64)
        for i, k in enumerate(some):
            x[i, : len(runs[k])], mask[i, : len(runs[k])], y[i, : len(runs[k])] = runs[k], True, labels[k]
        out.append((x, mask, y, weights[some]))
    return out


def _gradient(theta: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted log likelihood of labelled runs."""
    (n, size), width = mask.shape, x.shape[2]
    t = theta[width:].reshape(2, 2)
    e = np.zeros((n, size, 2))
    e[:, :, 1] = x @ theta[:width]
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for s in range(1, size):
        a[:, s] = np.where(mask[:, s, None], e[:, s] + np.logaddexp(a[:, s - 1, :1] + t[0], a[:, s - 1, 1:] + t[1]), a[:, s - 1])
    for s in range(size - 2, -1, -1):
        inner = e[:, s + 1] + b[:, s + 1]
        b[:, s] = np.where(mask[:, s + 1, None], np.logaddexp(t[:, 0] + inner[:, :1], t[:, 1] + inner[:, 1:]), 0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    share = mask * weight[:, None]
    p = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])
    gx = (((y - p) * share)[:, :, None] * x).sum(axis=(0, 1))
    pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * share[:, 1:, None, None]
    gt = -pair.sum(axis=(0, 1))
    np.add.at(gt, (y[:, :-1], y[:, 1:]), share[:, 1:])
    return np.concatenate([gx, gt.ravel()])


def fit_lines(runs: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray | None = None, start: LineModel | None = None, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineModel:
    """Maximum likelihood of runs of lines with a label (1: boilerplate) for each line; Adam on exact gradients."""
    width = runs[0].shape[1]
    theta = np.concatenate([start.weights, start.transitions.ravel()]) if start else np.zeros(width + 4)
    groups = _padded(runs, labels, np.full(len(runs), 1 / len(runs)) if weights is None else weights)
    m, v = np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, rounds + 1):
        g = sum(_gradient(theta, *group) for group in groups) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineModel(theta[:width], theta[width:].reshape(2, 2))


def fit_latent(documents: list[np.ndarray], bad: np.ndarray, sizes: list[np.ndarray], turns: int = 4) -> LineModel:
    """Fit on documents (a row of features for each line, of ``sizes`` characters) of which only the whole is labelled."""
    cut = lambda many: [part for one in many for part in np.split(one, range(RUN, len(one), RUN))]
    runs, per_doc = cut(documents), [-(-len(d) // RUN) for d in documents]
    weight = np.repeat(np.where(bad, 0.5 / max(1, bad.sum()), 0.5 / max(1, (~bad).sum())), per_doc)
    labels = [np.full(len(d), int(b)) for d, b in zip(documents, bad, strict=True)]
    # The first model sees lines by themselves: chains whose labels never change would tell it that they cannot.
    lines, flat = np.concatenate(documents), np.concatenate(labels)
    each = 0.5 / np.where(flat == 1, max(1, (flat == 1).sum()), max(1, (flat == 0).sum()))
    model = fit_lines(list(lines[:, None, :]), list(flat[:, None]), each)
    model.transitions[:] = 0
    for turn in range(turns):
        labels = []
        for x, b in zip(documents, bad, strict=True):
            y = np.zeros(len(x), np.int64)
            if b:
                y[:] = model.decode(x)
                y[np.argmax(x @ model.weights)] = 1
            labels.append(y)
        model = fit_lines(runs, cut(labels), weight, model if turn else None, 150 if turn == 0 else 60)
    shares = np.array([s[~np.array(model.decode(x))].sum() / max(1, s.sum()) for x, s in zip(documents, sizes, strict=True)])
    cuts = np.linspace(0.05, 0.95, 19)
    right = [((shares[bad] < c).mean() + (shares[~bad] >= c).mean()) for c in cuts]
    best = cuts[np.isclose(right, max(right))]
    return LineModel(model.weights, model.transitions, float(best[np.argmin(np.abs(best - 0.5))]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineModel:
    """Fit on at most ``max_labelled`` labelled documents; what comes back is all their lines' features."""
    known = labels.filter(f"{label_col} is not null and {id_col} is not null").groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "text", "label")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in byte_texts(part.column("text"))]
            x = [line_features(some).ravel().tolist() if some else [] for some in lines]
            sizes = [[len(line) for line in some] for some in lines]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(sizes, pa.list_(pa.int64())), pa.array(x, pa.list_(pa.float64()))], names=["label", "sizes", "x"])

    table = rows.mapInArrow(describe, "label int, sizes array<long>, x array<double>").filter("size(sizes) > 0").toPandas()
    if table["label"].nunique() < 2:
        width = line_features([b"a"]).shape[1]
        return LineModel(np.concatenate([[-1.0], np.zeros(width - 1)]), np.zeros((2, 2)))
    table = table.iloc[sorted(range(len(table)), key=lambda i: (len(table["sizes"].iloc[i]), tuple(table["x"].iloc[i])))]
    sizes = [np.asarray(s) for s in table["sizes"]]
    return fit_latent([np.array(x).reshape(len(s), -1) for s, x in zip(sizes, table["x"], strict=True)], table["label"].to_numpy() == 0, sizes)


def judge(docs: DataFrame, model: LineModel, least_share: float | None = None, least_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    ``least_share`` is the model's unless it is given.
    """
    least_share = model.least_share if least_share is None else least_share
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    verdicts = [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names), *verdicts])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = byte_texts(part.column(1))
            counts = [base_counts(t) for t in texts]
            failed = [c[0] < least_words or 100 * c[4] > most_repeated * c[0] for c in counts]
            shares = [model.content_share(t) for t in texts]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            kept = [not f and s >= least_share for f, s in zip(failed, shares, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text")).mapInArrow(look, schema)
