"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

The patterns' spans always stay.  The model reads windows of ``WINDOW`` characters at every ``STRIDE``.
A window without a digit and without "@" whose neighbours have none either is taken to hold no span: a
span has one or the other, and no character of it farther from one than that is looked for.  Where
windows overlap, each character takes the label of the window in whose middle it lies best; runs of a
label across all windows of the text are its spans.  A span is added if its kind's plain conditions hold
and it touches no pattern's span.

The network is trained in numpy from labelled spans: windows of the corpus around the patterns' spans, of
which a bounded number is taken by a hash, the same windows with the span written otherwise (dots and
signs in words or brackets, other separators, no plus sign), and generated windows of numbers, dates and
hexadecimal strings.

Nulls and edge cases: a null text is empty and has no spans; ids are carried along, nulls too; equal rows
give equal results; of two labels that are equally likely the first wins; a corpus without spans, an
empty one too, gives a network of generated windows, and an empty table gives an empty result; columns
besides the id and the text are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import plain_text, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    spans = [(s, e, 0) for s, e in _emails(text)]
    if _TRIGGER.search(text):
        spans += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-3:]) < 256 for x in m[0].split("."))]
        spans += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
        spans += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


# ---- the network ----------------------------------------------------------------------------------

_SIGNS = "@.+-_%()[]:,/\n #=\"'"
_CLASSES = 5 + len(_SIGNS)
_CODE = np.full(256, 3, np.int64)
_CODE[48:58], _CODE[97:123], _CODE[65:91] = 0, 1, 2
for _i, _c in enumerate(_SIGNS):
    _CODE[ord(_c)] = 5 + _i


def encode(text: str, size: int) -> np.ndarray:
    """Character classes, padded to ``size`` with the padding class 4."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.full(size, 4, np.int64)
    out[: len(points)] = np.where(points < 256, _CODE[np.minimum(points, 255)], 3)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiLstmCrf:
    """Two LSTMs over characters, a linear layer, and CRF transitions between labels."""

    def __init__(self, hidden: int = 16, labels: int = 5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, labels
        draw = lambda *s: rng.normal(0, 0.3, s)
        self.p = {}
        for d in "fb":
            self.p |= {f"e{d}": draw(_CLASSES, 4 * hidden), f"u{d}": draw(hidden, 4 * hidden)}
            self.p[f"e{d}"][:, hidden : 2 * hidden] += 1.0
        self.p |= {"w": draw(2 * hidden, labels), "c": np.zeros(labels), "t": np.eye(labels) * 1.0}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, h = len(x), x.shape[1], self.h
        state, cell, out, tape = np.zeros((n, h)), np.zeros((n, h)), np.zeros((n, steps, h)), []
        inputs = self.p[f"e{d}"][x]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + state @ self.p[f"u{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, held = cell, state
            cell = f * cell + i * g
            shown = np.tanh(cell)
            state = o * shown
            out[:, t] = state
            tape.append((t, i, f, o, g, before, held, shown))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, d)[0] for d in "fb"], axis=2) @ self.p["w"] + self.p["c"]

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the negative log likelihood by emissions and transitions."""
        n, steps, k = e.shape
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        a, b, t = np.zeros_like(e), np.zeros_like(e), self.p["t"]
        a[:, 0] = e[:, 0]
        for s in range(1, steps):
            a[:, s] = e[:, s] + lse(a[:, s - 1, :, None] + t, 1)
        for s in range(steps - 2, -1, -1):
            b[:, s] = lse(t + (e[:, s + 1] + b[:, s + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)[:, None]
        de = np.exp(a + b - z[:, :, None])
        pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, None, None]).sum(axis=(0, 1))
        rows = np.arange(n)[:, None]
        de[rows, np.arange(steps), y] -= 1
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        return de, pair

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, d) for d in "fb"}
        both, h = np.concatenate([runs[d][0] for d in "fb"], axis=2), self.h
        de, dt = self._crf(both @ self.p["w"] + self.p["c"], y)
        grads = {"w": np.einsum("nth,ntk->hk", both, de), "c": de.sum(axis=(0, 1)), "t": dt}
        dout = de @ self.p["w"].T
        for d, part in zip("fb", (slice(0, h), slice(h, None)), strict=True):
            du, dx = np.zeros_like(self.p[f"u{d}"]), np.zeros_like(self.p[f"e{d}"])
            ds, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
            for t, i, f, o, g, before, held, shown in reversed(runs[d][1]):
                ds = ds + dout[:, t, part]
                dc = dc + ds * o * (1 - shown**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * shown * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                du += held.T @ dz
                np.add.at(dx, x[:, t], dz)
                ds, dc = dz @ self.p[f"u{d}"].T, dc * f
            grads |= {f"u{d}": du, f"e{d}": dx}
        return {k: v / len(x) for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 5) -> BiLstmCrf:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                step += 1
                for k, g in self.gradients(x[order[at : at + batch]], y[order[at : at + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequences, by Viterbi."""
        e, t = self.emissions(x), self.p["t"]
        best, back = e[:, 0], np.zeros(e.shape, np.int64)
        for s in range(1, e.shape[1]):
            scores = best[:, :, None] + t
            back[:, s] = scores.argmax(axis=1)
            best = scores.max(axis=1) + e[:, s]
        out = np.zeros(x.shape, np.int64)
        out[:, -1] = best.argmax(axis=1)
        for s in range(e.shape[1] - 1, 0, -1):
            out[:, s - 1] = back[np.arange(len(x)), s, out[:, s]]
        return out


def _example(rng: random.Random) -> tuple[str, list[int]]:
    """One generated window and its labels (0: none, else 1 + kind)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    dot, sep = rng.choice([".", ".", " dot ", "[.]"]), rng.choice(["", " ", "-", "."])
    card = digits(15)
    card += next(d for d in "0123456789" if luhn(card + d))
    made = [
        lambda: (1, f"{word()}{rng.choice(['.', '_', ''])}{digits(2)}{rng.choice(['@', '@', ' @ ', '(@)'])}{word()}{dot}{word()}{dot}{rng.choice(['com', 'org', 'net'])}"),
        lambda: (2, rng.choice([".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))),
        lambda: (3, sep.join(card[i : i + 4] for i in range(0, 16, 4))),
        lambda: (4, rng.choice(["+1 (%s) %s-%s", "(%s) %s-%s", "%s-%s-%s", "+44 %s %s %s"]) % (digits(3), digits(3), digits(4))),
        lambda: (0, rng.choice([digits(4), digits(16), "".join(rng.choice("0123456789abcdef") for _ in range(24)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"@{word()}"])),
    ]
    text, labels = "", []
    while len(text) < WINDOW + 40:
        label, piece = (0, word()) if rng.random() < 0.7 else rng.choice(made)()
        piece = piece.capitalize() if rng.random() < 0.1 else piece
        end = rng.choice([" ", " ", " ", ", ", ". ", "\n"])
        text += piece + end
        labels += [label] * len(piece) + [0] * len(end)
    at = rng.randint(0, 30)
    return text[at : at + WINDOW], labels[at : at + WINDOW]


def disguised(rng: random.Random, kind: int, span: str) -> str:
    """A span of the patterns written in a way that they do not find."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        name, domain = span.split("@", 1)
        return name + rng.choice([" @ ", "(@)", "[@]", "@"]) + domain.replace(".", rng.choice([" dot ", "[.]", "(dot)", "[dot]"]))
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", " . ", "(.)"]))
    if kind == 2:
        return rng.choice([".", "  ", "/", "_", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c, d = digits[:-10] or "1", digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"00{a} {b} {c} {d}", f"{b}.{c}.{d}", f"({b}) {c} {d}"])


def _corpus_windows(docs: DataFrame, text_col: str, max_windows: int) -> list[tuple[str, str]]:
    """(text, labels) of at most ``max_windows`` windows around spans of the patterns, those of the smallest hashes; labels are digits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, labels = [], []
            for text in part.column(0).to_pylist():
                spans = pattern_spans(text) if _TRIGGER.search(text) else []
                for start, end, _ in spans:
                    at = max(0, start - zlib.crc32(text[start:end].encode("utf-8", "replace")) % max(1, WINDOW - (end - start)))
                    marks = ["0"] * min(WINDOW, len(text) - at)
                    for s, e, k in spans:
                        for i in range(max(s, at), min(e, at + len(marks))):
                            if marks[i - at] == "0":
                                marks[i - at] = str(1 + k)
                    texts.append(text[at : at + WINDOW])
                    labels.append("".join(marks))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(labels, pa.string())], names=["text", "labels"])

    found = docs.select(plain_text(text_col).alias("text")).mapInArrow(cut, "text string, labels string").distinct()
    return [tuple(r) for r in found.orderBy(F.xxhash64("text", "labels"), "text", "labels").limit(max_windows).collect()]


def fit(docs: DataFrame, max_windows: int = 1200, generated: int = 1200, seed: int = 11, text_col: str = "text") -> BiLstmCrf:
    """Train on at most ``max_windows`` windows of ``docs`` (the rows brought to the driver), each also with its spans disguised, and on generated ones."""
    rng, made = random.Random(seed), []
    for text, labels in _corpus_windows(docs, text_col, max_windows):
        made.append((text, [int(y) for y in labels]))
        other, marks, at = "", [], 0
        for m in re.finditer(r"([1-4])\1*", labels):
            kind = int(m[1]) - 1
            span = text[m.start() : m.end()]
            whole = any((s, e, k) == (0, len(span), kind) for s, e, k in pattern_spans(span))
            shown = disguised(rng, kind, span) if whole and rng.random() < 0.8 else span
            other += text[at : m.start()] + shown
            marks += [0] * (m.start() - at) + [1 + kind] * len(shown)
            at = m.end()
        other, marks = other + text[at:], marks + [0] * (len(text) - at)
        first = next((i for i, y in enumerate(marks) if y), 0)
        at = max(0, min(first - rng.randint(0, 15), len(other) - WINDOW))
        made.append((other[at : at + WINDOW], marks[at : at + WINDOW]))
    made += [_example(rng) for _ in range(generated)]
    y = np.zeros((len(made), WINDOW), np.int64)
    for i, (_, labels) in enumerate(made):
        y[i, : len(labels)] = labels
    return BiLstmCrf().fit(np.stack([encode(t, WINDOW) for t, _ in made]), y)


def _plausible(kind: int, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return "@" in text.strip("@") and ("." in text or "dot" in text) and 6 <= len(text) <= 254
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x) < 4 and int(x) < 256 for x in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15 and len(digits) < len(text) <= 2 * len(digits)


def _read_windows(text: str, gate: bool) -> list[int]:
    """Numbers of the windows to decode: with ``gate``, those with a digit or "@" and their neighbours."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    if not gate:
        return list(range(last + 1))
    own = {min(last, w) for m in _TRIGGER.finditer(text) for w in range(max(0, (m.start() - WINDOW) // STRIDE + 1), m.start() // STRIDE + 1)}
    return sorted({v for w in own for v in (w - 1, w, w + 1) if 0 <= v <= last})


def model_spans(texts: list[str], model: BiLstmCrf, batch: int = 256, gate: bool = True) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text, from windows decoded together and reconciled per text."""
    windows = [(n, w) for n, text in enumerate(texts) for w in _read_windows(text, gate)]
    labels: list[dict[int, int]] = [{} for _ in texts]
    for at in range(0, len(windows), batch):
        part = windows[at : at + batch]
        decoded = model.decode(np.stack([encode(texts[n][w * STRIDE : w * STRIDE + WINDOW], WINDOW) for n, w in part]))
        for (n, w), row in zip(part, decoded, strict=True):
            # Each character belongs to the window in whose middle it lies; the outer ones to the first and the last window.
            begin = 0 if w == 0 else (WINDOW - STRIDE) // 2
            end = WINDOW if (w + 1) * STRIDE + (WINDOW - STRIDE) >= len(texts[n]) + STRIDE else (WINDOW + STRIDE) // 2
            for i in (np.flatnonzero(row[begin:end]) + begin).tolist():
                if w * STRIDE + i < len(texts[n]):
                    labels[n][w * STRIDE + i] = int(row[i])
    out = []
    for text, held in zip(texts, labels, strict=True):
        spans, start, last, kind = [], None, None, 0
        for i in [*sorted(held), None]:
            y = held[i] if i is not None else 0
            if start is not None and (i is None or i != last + 1 or y != kind):
                while start <= last and text[last].isspace():
                    last -= 1
                while start <= last and text[start].isspace():
                    start += 1
                if start <= last and _plausible(kind - 1, text[start : last + 1]):
                    spans.append((start, last + 1, kind - 1))
                start = None
            if i is not None:
                start, last, kind = (i if start is None else start), i, y
        out.append(spans)
    return out


def find_spans(texts: list[str], model: BiLstmCrf) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text; all are by start and then kind."""
    out = []
    hot = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
    more = dict(zip(hot, model_spans([texts[i] for i in hot], model), strict=True)) if hot else {}
    for i, text in enumerate(texts):
        base = pattern_spans(text) if i in more else []
        added = [s for s in more.get(i, ()) if all(s[1] <= b[0] or s[0] >= b[1] for b in base)]
        out.append((base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1]))))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def detect(docs: DataFrame, model: BiLstmCrf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of pattern spans of each kind, ``base_spans`` and ``spans`` as kind:start:end lists; without a model, one is fitted on ``docs``."""
    fitted = model or fit(docs, text_col=text_col)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = find_spans(part.column(1).to_pylist(), fitted)
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([written(b) for b, _ in got], pa.string()), pa.array([written(a) for _, a in got], pa.string())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text")).mapInArrow(find, schema)
