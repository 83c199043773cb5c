"""The corpus operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rows import agree, duck
from weftline.llm import catalog, fingerprint, license, line_dedup, lm, minhash, mixing, packing, pii, quality, toxicity

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def got(frame) -> dict:
    rows = frame.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1_learns_from_its_folds_only_and_holds_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = got(catalog.op1_toxicity(spark, folder))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["score"], labels[i]) for i, r in rows.items() if r["held_out"] and labels.get(i) is not None]
    toxic, clean = (np.array([s for s, y in held if y == side]) for side in (1, 0))
    assert len(toxic) > 50 and len(clean) > 400
    assert (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.03  # recall, false alarms
    assert (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2 > 0.93  # area under the curve


def test_features_equal_plain_ones():
    lexicon = {b"rotten": 2.0, b"stink~": 1.0, b"foul": 1.5}
    weight = {"rotten": 2.0, "foul": 1.5, "stinker": 1.0, "stinking": 1.0}
    rng = np.random.default_rng(12)
    vocabulary = ["you", "Your", "plain", "rotten", "FOUL", "stinker", "stinking", "r0tten!", "f0ul", "word", "and,", "why?!", "#tag"]
    for size in (0, 1, 5, 40, 900):
        text = " ".join(rng.choice(vocabulary, size))
        words = re.sub("[" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]", " ", text.lower()).split()
        hits = [i for i, w in enumerate(words) if w in weight]
        you = [i for i, w in enumerate(words) if w in ("you", "your")]
        n, chars = max(1, len(words)), max(1, len(text))
        w = [weight.get(x, 0.0) for x in words]
        near = sum(any(abs(i - k) <= 5 for k in hits) for i in you)
        masked = [m.translate(str.maketrans("013457@$!", "oieastasi")).replace("*", "") for m in re.findall(r"[a-z]+[013457@$!*]+[a-z]+", text.lower())]
        wanted = [np.log1p(len(words)), np.log1p(len(hits)), len(hits) / n, sum(w) / n, max(w, default=0), len({words[i] for i in hits}), near, len(you) / n, sum(c.isupper() for c in text) / chars, sum(c in "!?" for c in text) / chars, sum(c in "#*$%&@|<>" for c in text) / chars, len(masked) / n, sum(m in weight for m in masked), len(text) / n if words else 0.0]
        assert np.allclose(toxicity.features(text.encode(), toxicity._Weights(lexicon)), wanted)


def test_first_split_is_the_best_and_trees_answer_by_their_splits():
    rng = np.random.default_rng(13)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    trees = toxicity.fit_trees(x, y, rounds=5, depth=2)
    g, h = y.mean() - y, np.full(300, y.mean() * (1 - y.mean()))
    gain = lambda m: sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (m, ~m)) - g.sum() ** 2 / (h.sum() + 2)
    best = max(gain(x[:, j] <= e) for j, edges in enumerate(trees.edges) for e in edges)
    assert gain(x[:, trees.feature[0, 0]] <= trees.edges[trees.feature[0, 0]][trees.cut[0, 0]]) == pytest.approx(best)
    for row, margin in zip(x, trees.margins(x), strict=True):
        total = trees.start
        for f, c, v in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                edges = trees.edges[f[node]]
                node = 2 * node + 1 + (c[node] < len(edges) and row[f[node]] > edges[c[node]])
            total += v[node - len(f)]
        assert margin == pytest.approx(total)


def test_isotonic_values_never_fall():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=200)
    _, values = toxicity.fit_isotonic(margin, (rng.random(200) < 1 / (1 + np.exp(-margin))).astype(float))
    assert (np.diff(values) >= 0).all() and 0 < values[0] and values[-1] < 1


def test_op2_pieces_round_trip_and_sequences_have_no_gaps(spark, small, texts):
    from tokenizers import Tokenizer

    rows = catalog.op2_packing(spark, small).collect()
    tokenizer = Tokenizer.from_file(catalog.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.asarray(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in rows) / (2048 * len(by_sequence)) > 0.95


def test_chunks_are_encoded_as_whole_texts_are():
    import random

    from tokenizers import Tokenizer

    whole, by_chunk = Tokenizer.from_file(catalog.tokenizer_path()), packing.ChunkTokenizer(catalog.tokenizer_path(), held=50)
    assert by_chunk.by_chunk
    rng = random.Random(3)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "a", "B", "é", "ß", "\u0130", "'s", "'S", "12", "!!", "\n", " ", "\t", "ab", "_", "'ll", "Don't", "\x1c", "ς", "\u0301", "日本"]
    for _ in range(20):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(100)]
        for text, ids in zip(texts, by_chunk(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_first_fit_decreasing_equals_the_plain_loop():
    sizes, rooms, wanted = np.random.default_rng(2).integers(1, 60, 300), [], {}
    for item in np.argsort(-sizes, kind="stable").tolist():
        k = next((k for k, room in enumerate(rooms) if room >= sizes[item]), len(rooms))
        if k == len(rooms):
            rooms.append(100)
        wanted[item] = (k, 100 - rooms[k])
        rooms[k] -= int(sizes[item])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert {i: (b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist(), strict=True))} == wanted


def plain_spans(text: str) -> list:
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0])]
    return [(name, start, end) for start, _, end, name in sorted(found)]


def test_op3_keeps_the_patterns_spans_and_adds_apart_from_them(spark, small, texts):
    for i, r in got(catalog.op3_pii(spark, small)).items():
        base = plain_spans(texts[i])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


@pytest.mark.parametrize("text", ["a@b@c.d", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "1.2.3.4.256.1.1.1.1", "4111 1111 1111 1111-4111", "+1 (234) 567-8901x", "@@a@b.c", "é@a.b 9" * 3])
def test_patterns_on_hard_texts(text):
    assert [(pii.KINDS[k], s, e) for s, e, k in pii.pattern_spans(text)] == plain_spans(text)


def test_network_finds_held_out_spans_of_the_corpus_and_disguised_ones(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs.filter("doc_id % 2 = 0"))
    held = [t for (t,) in docs.filter("doc_id % 2 = 1 and text rlike '[0-9@]'").select("text").collect()]
    base, found = [pii.pattern_spans(t) for t in held], pii.model_spans(held, model)
    assert np.mean([s in f for b, f in zip(base, found, strict=True) for s in b]) > 0.95
    assert found[:200] == pii.model_spans(held[:200], model, gate=False)  # the windows left out hold none
    rng, right = random.Random(5), []
    for text, spans in zip(held, base, strict=True):
        for start, end, kind in spans:
            shown = pii.disguised(rng, kind, text[start:end])
            other = text[:start] + shown + text[end:]
            if (start, start + len(shown), kind) not in pii.pattern_spans(other):
                right.append((start, start + len(shown), kind) in pii.find_spans([other], model)[0][1])
    assert len(right) > 200 and np.mean(right) > 0.85


def test_op4_counts_equal_plain_ones(spark, small, texts):
    for i, r in got(catalog.op4_quality(spark, small)).items():
        words = [w for w in re.split("[\x20\x09-\x0d]+", texts[i]) if w]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(windows)
        repeated = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(3)}
        lines = [x for x in texts[i].split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        wanted = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in texts[i]), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted
        assert r["base_failed"] == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0]) and not (r["base_failed"] and r["kept"])


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(3)
    lines = [b"short", b"a longer line of plain words here", b"### $$$ %%%", b"BUY NOW!!!", b"and once more a line of words"]
    model = quality.LineModel(rng.normal(size=quality.line_features([b"a"]).shape[1]), rng.normal(size=(2, 2)))
    scores = quality.line_features(lines) @ model.weights
    value = lambda y: sum(s for s, b in zip(scores, y, strict=True) if b) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False))
    best = max(np.ndindex(*(2,) * len(lines)), key=value)
    assert model.boilerplate(lines) == [bool(b) for b in best]


def planted_lines(rng, n: int) -> list[tuple[str, list[bool]]]:
    """Documents of prose, some of them with runs of menus, symbols or stuttered words, and which lines those are."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(8, 30))).capitalize() + "."
    junk = [lambda: " | ".join(word() for _ in range(rng.integers(5, 20))), lambda: " ".join(f"{word()}###" for _ in range(rng.integers(5, 20))), lambda: " ".join([word()] * int(rng.integers(12, 30)))]
    out = []
    for k in range(n):
        marks = [False] * int(rng.integers(2, 5))
        if k % 3 == 0:
            at = int(rng.integers(0, len(marks) + 1))
            marks[at:at] = [True] * int(rng.integers(4, 9))
        kind = junk[int(rng.integers(0, 3))]
        out.append(("\n".join(kind() if m else prose() for m in marks), marks))
    return out


def test_op4_labels_lines_of_one_document_apart_from_labels_of_documents(spark):
    rng = np.random.default_rng(14)
    learn, held = planted_lines(rng, 240), planted_lines(rng, 90)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(learn)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not any(m))) for i, (_, m) in enumerate(learn)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = [(model.boilerplate(t.encode().split(b"\n")), m) for t, m in held]
    right = [a == b for y, m in found for a, b in zip(y, m, strict=True)]
    assert np.mean(right) > 0.97
    assert sum(0 < sum(y) < len(y) for y, _ in found) >= 25  # documents with lines of both kinds
    assert (model.transitions != 0).all() and 0 < model.least_share < 1


def test_line_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(15)
    runs, labels = [rng.normal(size=(n, 3)) for n in (1, 3, 4)], [rng.integers(0, 2, n) for n in (1, 3, 4)]
    weights, theta = np.array([0.2, 0.5, 0.3]), rng.normal(size=7)

    def value(th: np.ndarray) -> float:
        total, t = 0.0, th[3:].reshape(2, 2)
        for x, y, w in zip(runs, labels, weights, strict=True):
            score = lambda z, x=x: sum(x[i] @ th[:3] for i in range(len(x)) if z[i]) + sum(t[a, b] for a, b in zip(z, z[1:], strict=False))
            total += w * (score(list(y)) - np.log(sum(np.exp(score(z)) for z in np.ndindex(*(2,) * len(x)))))
        return total

    found = sum(quality._gradient(theta, *g) for g in quality._padded(runs, labels, weights))
    wanted = [(value(theta + d) - value(theta - d)) / 2e-5 for d in np.eye(7) * 1e-5]
    assert np.allclose(found, wanted, atol=1e-6)


def test_op5_edits_and_equal_texts(spark, small, texts):
    rows, order = got(catalog.op5_fingerprint(spark, small)), sorted(texts)
    prints = {}
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        assert (rows[i]["edited_fingerprint"] == rows[i]["fingerprint"]) == (rows[i]["near_edited"] == 1.0)


def test_op5_every_row_has_its_own_whatever_ids_repeat(spark):
    texts = ["one two three four", "One  two three FOUR", "ß straße", "SS STRASSE", "ὈΔΥΣΣΕΎΣ", "ὀδυσσεύς", "", None, "a longer text that is cut in four parts", "x"]
    made = [(i, t) for i, t in enumerate(texts)] + [(3, "three is here again"), (3, "three is here again"), (3, "and 3"), (None, "no id"), (None, "no id at all")]
    out = fingerprint.edited_digests(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(made)
    by_id = defaultdict(list)
    for i, t in made:
        by_id[i].append(t or "")
    order = [*sorted(i for i in by_id if i is not None), None]
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    prints = {}
    for r in out:  # the heads of an id with several rows are of any one of its texts, and of the same for all
        after = by_id[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        made_of = [(t, t[: len(t) - len(t) // 4] + a[: len(t) // 4]) for t in by_id[r["doc_id"]] for a in after if len(t) == r["n_chars"]]
        t, edited = next((t, e) for t, e in made_of if hashlib.sha256(e.encode()).hexdigest() == r["edited_sha256"])
        assert (r["edited_fingerprint"] == r["fingerprint"]) == (canon(t) == canon(edited))
        assert (r["next_fingerprint"] == r["fingerprint"]) == any(canon(a) == canon(t) for a in after) or len(after) > 1
        assert prints.setdefault(canon(t), r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    groups = fingerprint.exact_groups(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(r["fingerprint"] for r in groups) == sorted(r["fingerprint"] for r in out)


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: fingerprint.F.substring(c, 1, 1))
    made = [(1, "a b"), (2, "A  b"), (3, "a c"), (4, "d"), (5, "a c")]
    rows = got(fingerprint.exact_groups(spark.createDataFrame(made, "doc_id long, text string")))
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"] == rows[5]["fingerprint"]
    out = got(fingerprint.edited_digests(spark.createDataFrame(made, "doc_id long, text string")))
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: r["fingerprint"] for i, r in rows.items()}


def test_canonical_forms_meet(spark):
    made = spark.createDataFrame([(1, "A  b\tC"), (2, " a b c"), (3, "Ａ b c"), (4, "a b d")], "doc_id long, text string")
    rows = got(fingerprint.exact_groups(made))
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] == rows[3]["fingerprint"] != rows[4]["fingerprint"]


def test_op6_meets_its_targets(spark, docs):
    mixed = mixing.mix(docs)
    rows = mixed.select("source", "lang", "_topic", "_tokens", "_weight", "_kept").distinct().collect()
    cells = {(r["source"], r["lang"], r["_topic"]): r["_weight"] for r in rows}
    tokens = Counter()
    for r in mixed.select("source", "_tokens").collect():
        tokens[r["source"]] += r["_tokens"]
    targets = plain_targets(tokens)
    for source in tokens:
        share = sum(w for c, w in cells.items() if c[0] == source) / sum(cells.values())
        assert share == pytest.approx(targets[source], rel=0.05)
    assert sum(r["_tokens"] for r in mixed.filter("_kept").collect()) > 0.75 * sum(tokens.values())
    assert mixing.sample(docs).columns == docs.columns


def test_op6_kept_rows_meet_the_targets_on_a_hot_source(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["words"] * int(rng.integers(20, 60))), ["en", "de"][i % 7 == 0], f"s{0 if i % 3 == 0 else 1 + i % 19}", int(rng.integers(0, 3))) for i in range(8000)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject int")
    sizes, shares = {d: Counter() for d in ("source", "lang", "subject")}, {}
    for r in rows:
        for d, v in zip(("lang", "source", "subject"), r[2:], strict=True):
            sizes[d][v] += len(r[1].split())
    for d, kind in (("source", "string"), ("lang", "string"), ("subject", "int")):
        total = sum(n**0.7 for n in sizes[d].values())
        shares[{"subject": "topic"}.get(d, d)] = spark.createDataFrame([(v, n**0.7 / total) for v, n in sizes[d].items()], f"{ {'subject': 'topic'}.get(d, d)} {kind}, share double")
    mixed = mixing.mix(made, shares, keep=0.95, topic_col="subject").collect()
    tokens = Counter()
    for r in mixed:
        tokens[r["source"]] += r["_tokens"]
    expected = sum(r["_tokens"] * r["_probability"] for r in mixed)
    kept = sum(r["_tokens"] for r in mixed if r["_kept"])
    feasible = []
    for d in ("source", "lang", "subject"):
        sums = Counter()
        for r in mixed:
            sums[r[d]] += r["_tokens"]
        feasible += [n / (n**0.7 / sum(m**0.7 for m in sums.values())) for n in sums.values()]
    assert 0.9 * min(feasible) < expected <= 1.01 * min(feasible)
    for source, n in tokens.items():
        target = n**0.7 / sum(m**0.7 for m in tokens.values())
        assert sum(r["_tokens"] * r["_probability"] for r in mixed if r["source"] == source) / expected == pytest.approx(target, rel=0.02)
        assert sum(r["_tokens"] for r in mixed if r["source"] == source and r["_kept"]) / kept == pytest.approx(target, rel=0.1)
    some = spark.createDataFrame([("s0", 0.5), ("s1", 0.5)], "source string, share double")
    mixed = mixing.mix(made, {"source": some}, topic_col="subject")
    assert {r["source"] for r in mixed.filter("_kept").select("source").distinct().collect()} == {"s0", "s1"}
    reached = {r["value"]: r for r in mixing.marginals(mixed, topic_col="subject").filter("dimension = 'source'").collect()}
    assert reached["s0"]["target"] == pytest.approx(0.5) and reached["s0"]["expected"] == pytest.approx(0.5) and reached["s2"]["kept"] == 0


def plain_targets(sums: dict, keep: float = 0.9, power: float = 0.7) -> dict:
    """Powers of shares, those beyond share / keep cut to that until none is."""
    own, cut = {v: n / sum(sums.values()) for v, n in sums.items()}, {}
    while True:
        rest = sum(x**power for v, x in own.items() if v not in cut)
        out = {v: cut[v] if v in cut else x**power * (1 - sum(cut.values())) / rest for v, x in own.items()}
        more = {v: own[v] / keep for v in own if v not in cut and out[v] > own[v] / keep}
        if not more:
            return out
        cut |= more


def plain_raking(cells: dict[tuple, int], keep: float = 0.9) -> tuple[dict, dict]:
    """Weights and probabilities of cells by loops over dictionaries."""
    targets = []
    for d in range(3):
        sums = Counter()
        for c, n in cells.items():
            sums[c[d]] += n
        targets.append(plain_targets(sums, keep))

    def fit(weight: dict, rounds: int) -> dict:
        whole, weight = sum(weight.values()), dict(weight)
        for _ in range(rounds):
            off = 0.0
            for d in range(3):
                sums = Counter()
                for c, w in weight.items():
                    sums[c[d]] += w
                for c in weight:
                    factor = targets[d][c[d]] * whole / sums[c[d]] if sums[c[d]] else 1
                    off = max(off, abs(factor - 1))
                    weight[c] *= factor
            if off <= 1e-3:
                break
        return weight

    weight = fit(cells, 500)
    expected = {c: w * keep * sum(cells.values()) / sum(weight.values()) for c, w in weight.items()}
    ratio = lambda: {c: expected[c] / n if n else 1 for c, n in cells.items()}
    for _ in range(100):
        if max(ratio().values()) <= 1.001:
            break
        expected = fit({c: min(w, cells[c]) for c, w in expected.items()}, 20)
    peak = max(1.0, *ratio().values())
    return weight, {c: min(1, r / peak) if cells[c] else 1 for c, r in ratio().items()}


def test_op6_equals_plain_raking(spark, small, texts):
    rows = got(catalog.op6_mixing(spark, small))
    cells = Counter()
    for i, r in rows.items():
        assert r["n_tokens"] == len([w for w in re.split("[\x20\x09-\x0d]+", texts[i]) if w])
        assert (r["topic"] == -1) == (not any(len(w.encode()) >= 6 for w in texts[i].split()))
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    weight, probability = plain_raking(cells)
    for r in rows.values():
        c = r["source"], r["lang"], r["topic"]
        assert r["cell_weight"] == pytest.approx(weight[c], rel=1e-6) and r["probability"] == pytest.approx(probability[c], rel=1e-6)
    assert len({r["topic"] for r in rows.values()}) > 3


def test_spark_jobs_rake_as_numpy_does(spark, docs):
    few, many = (mixing.mix(docs, driver_cells=n, keep_text=False).select("doc_id", "_weight", "_probability") for n in (100_000, 0))
    few, many = got(few), got(many)
    assert all(many[i]["_weight"] == pytest.approx(r["_weight"], rel=0.01) for i, r in few.items())
    assert all(0 < r["_probability"] <= 1 for r in many.values())


def test_topics_follow_the_words(spark):
    rng = np.random.default_rng(17)
    subjects = [[f"{a}{'abcdefghij'[k]}subject" for k in range(10)] for a in ("alpha", "beta", "gamma")]
    made = [(i, " ".join(rng.choice(subjects[i % 3], 30))) for i in range(90)] + [(90, "no long one"), (91, None)]
    mixed = mixing.mix(spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang", "1 as _tokens"), topics=3)
    rows = got(mixed)
    assert len({(i % 3, rows[i]["_topic"]) for i in range(90)}) == 3 and rows[90]["_topic"] == rows[91]["_topic"] == -1
    assert rows[0]["_tokens"] == 1 and rows[0]["__tokens"] == 30 and rows[91]["__tokens"] == 0


def test_op7_equals_its_sql(spark, small):
    agree(catalog.op7_line_dedup(spark, small), duck(small), catalog.OP7_SQL)


def plain_dedup(docs: dict[int, str], min_docs: int = 3, min_chars: int = 20) -> dict[int, tuple[str, int]]:
    key = lambda x: (k if len(k := x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) >= min_chars else None)
    held = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        kept = [x for x in t.split("\n") if key(x) is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out[i] = "\n".join(kept), t.count("\n") + 1 - len(kept)
    return out


def test_line_index_is_reversible(spark, monkeypatch):
    """Insertions and deletions, with filters so small that shards fill up, grow in number and empty again."""
    monkeypatch.setattr(line_dedup, "SEGMENTS", 3)
    rng = np.random.default_rng(16)
    texts = {i: "\n".join(f"Line number {int(x)} of the common ones" for x in rng.zipf(1.3, 12) % 400) for i in range(150)}
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, filter_bytes=4 * 64, buckets=8)
    state = lambda: (sorted(map(tuple, index.references.collect())), sorted(map(tuple, index.repeating.collect())))
    now, states = [], []
    for step in (range(40), range(40, 150), range(30, 60)):
        index.insert(frame(step))
        now = sorted({*now, *step})
        states.append(state())
        out = {r["doc_id"]: (r["text"], r["_n_dropped"]) for r in index.apply(frame(now)).collect()}
        assert out == plain_dedup({i: texts[i] for i in now})
    assert states[1] == states[2] != states[0]  # the last documents were there already
    assert len(index.filters) == 4 and any(f.full for f in index.filters)
    index.delete(frame(range(40, 150)).select("doc_id"))
    assert state() == states[0] and not any(f.full for f in index.filters)
    keys = [bytes(r["key"]) for r in index.repeating.collect()]
    assert all(k in index.filters[line_dedup._shard(k, len(index.filters))] for k in keys)
    assert sum(int((f.table > 0).sum()) for f in index.filters) == len(keys)
    assert {r["doc_id"]: (r["text"], r["_n_dropped"]) for r in index.apply(frame(range(40))).collect()} == plain_dedup({i: texts[i] for i in range(40)})


def test_cuckoo_filter():
    held, keys = line_dedup.CuckooFilter(), [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(20_000)]
    for k in keys:
        held.insert(k)
    assert all(k in held for k in keys) and not held.full
    for k in keys:
        held.delete(k)
    assert not held.table.any()


def test_op8_classes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    made = []
    for b in base:
        made += [b, b, b.replace(b.split()[60], "other"), b + " end", b[: len(b) // 3]]
    made += ["", "  ", "one two"]
    sets = [Counter(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) or Counter([tuple(t.lower().split())] if t.split() else []) for t in made]
    parent = list(range(len(made)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            most = sum((sets[i] | sets[j]).values())
            if not most or sum((sets[i] & sets[j]).values()) / most >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = got(minhash.near_duplicate_classes(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
    assert {i: r["class_id"] for i, r in rows.items()} == {i: root(i) for i in range(len(made))}


def test_op8_finds_twins_in_a_crowd_of_similar_forms(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    form, made, twins = words(170).split(), [], []
    for _ in range(100):  # any two are about 0.7 alike
        made.append(" ".join([*form, words(30)]))
    for k in range(6):  # twins lack the same part of the form and have 0.83 of each other, all of it in the form
        twins.append(len(made))
        made += [" ".join([*form[: 20 * k], *form[20 * k + 20 :], words(14)]) for _ in range(2)]
    sets = [Counter(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in made]
    for i in range(len(made)):
        for j in range(i):
            alike = sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values())
            assert (alike >= 0.8) == (i == j + 1 and j in twins)
    rows = got(minhash.near_duplicate_classes(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), bands=8, rows=1))
    assert {i: r["class_id"] for i, r in rows.items()} == {i: i - (i - 1 in twins) for i in range(len(made))}


def test_dart_signatures_estimate_weighted_similarity():
    a = (np.arange(100, dtype=np.uint64) * np.uint64(7919), np.ones(100, np.int64))
    b = (a[0], np.where(np.arange(100) < 50, 1, 3))
    one, two = minhash.dart_signatures([a, b], 2000)
    assert (one == two).mean() == pytest.approx(minhash.jaccard(a, b), abs=0.05)


def test_op9_finds_licences_and_leaves_prose(spark):
    made = [(1, "text\nThis work is licensed under CC BY-SA 4.0.\nmore"), (2, "Released under the MIT License."), (3, "the version of the work is free and open to all"), (4, None), (5, "Licensed under the Apache License, Version 2.0")]
    rows = got(license.scan(spark.createDataFrame(made, "doc_id long, text string")))
    assert [rows[i]["licences"] for i in range(1, 6)] == ["1:cc", "0:mit", "", "", "0:apache"]


def test_op9_finds_wrapped_notices_and_headings(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "x\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    made = [(1, mit), (2, bsd), (3, gpl), (4, "// SPDX-License-Identifier: Apache-2.0\nint x;"), (5, "a b\nLicensed under CC BY 4.0.\nc d"), (6, "Public domain forms\nwith general software")]
    rows = got(license.scan(spark.createDataFrame(made, "doc_id long, text string")))
    assert [rows[i]["licences"] for i in range(1, 7)] == ["0:mit,2:mit", "2:bsd", "0:gpl", "0:apache", "1:cc", ""]
    assert rows[1]["n_paragraphs"] == 4 and rows[6]["least_probability"] is None


def plain_paragraphs(text: str) -> list[tuple[int, int, str]]:
    lines = text.split("\n")
    out, at = [(i, i, x) for i, x in enumerate(lines)], 0
    blank = lambda x: not x.strip(" \t\n\x0b\x0c\r")
    while at < len(lines):
        last = at
        while last + 1 < len(lines) and 1 <= len(lines[last]) <= 100 and not blank(lines[last + 1]):
            last += 1
        if last > at:
            out.append((at, last, "\x01".join(lines[at : last + 1])))
        at = last + 1
    return out


def test_op9_equals_a_plain_version(spark, small, texts):
    model, found = license.trained_weights(), {}
    for i, text in texts.items():
        for at, last, paragraph in plain_paragraphs(text):
            words = license.words_of(paragraph)
            grams = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)} & set(model)
            if not grams:
                continue
            z = np.array(model[""]) + sum(np.array(model[g]) for g in grams)
            k = int(z.argmax())
            p, family = 1 / np.exp(z - z[k]).sum(), license.FAMILIES[k]
            overlap = max((len(set(words) & set(t)) / len(set(t)) for t in map(license.words_of, license.TEMPLATES.get(family, ()))), default=0.0)
            sure = family != license.UNKNOWN and p >= 0.5
            found[i, at, last] = (family if sure else license.UNKNOWN, p, overlap, sure and overlap >= 0.8)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {(r["doc_id"], r["at"], r["last"]): r for r in license.classify(docs).collect()}
    assert set(rows) == set(found) and len(found) > 10
    for key, (family, p, overlap, confirmed) in found.items():
        r = rows[key]
        assert (r["family"], r["confirmed"]) == (family, confirmed) and r["probability"] == pytest.approx(p, rel=1e-6) and r["overlap"] == pytest.approx(overlap)
    for i, r in got(license.scan(docs)).items():
        shown = sorted((at, last, f[0]) for (j, at, last), f in found.items() if j == i and f[3])
        kept = [(at, fam) for at, last, fam in shown if last == at or not any(b == a and f == fam and at <= a <= last for a, b, f in shown)]
        assert r["licences"] == ",".join(f"{at}:{fam}" for at, fam in sorted(kept))


def test_op10_base_scores(spark, small, texts):
    rows = got(catalog.op10_lm(spark, small))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*[w for w in re.split("[\x20\x09-\x0d]+", t.translate(lower)) if w], "\n"] for i, t in texts.items()}
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in learn for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        assert r["n_tokens"] == len(tokens[i]) and r["n_known"] == sum(counts[w] > 0 for w in tokens[i]) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]), rel=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_model(tokens: dict[int, list[str]], learn: set[int], order: int):
    """Probability functions of an interpolated n-gram model, counted with dictionaries."""
    pad = lambda t: ["<s>"] * (order - 1) + t
    counts, contexts = Counter(), Counter()
    for i in learn:
        t = pad(tokens[i])
        for at in range(order - 1, len(t)):
            for n in range(1, order + 1):
                counts[tuple(t[at - n + 1 : at + 1])] += 1
                contexts[tuple(t[at - n + 1 : at])] += 1
    total, words = contexts[()], {g for g in counts if len(g) == 1}
    seen, once = Counter(), Counter()
    for g, c in counts.items():
        if len(g) > 1:
            b = len(g), int(math.log2(contexts[g[:-1]]))
            seen[b] += c
            once[b] += c == 1

    def p(history: tuple, word: str) -> float:
        out = (counts[(word,)] + 1) / (total + len(words) + 1)
        for n in range(2, order + 1):
            h = history[len(history) - n + 1 :]
            if contexts[h]:
                b = n, int(math.log2(contexts[h]))
                share = (once[b] + 0.5) / (seen[b] + 1)
                out = (1 - share) * counts[(*h, word)] / contexts[h] + share * out
        return out

    return p, pad, [w for (w,) in words]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_op10_scores_equal_a_plain_model_that_sums_to_one(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)  # several blocks and shards
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    rng = np.random.default_rng(10)
    made = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 80)) % 200)) for i in range(120)]
    made += [(120, None), (121, "Only HERE once here"), (None, "w1 w2 no id")]
    rows = lm.score_corpus(spark.createDataFrame(made, "doc_id long, text string").repartition(3), order=order).collect()
    tokens = {i: [*(t or "").lower().split(), "</s>"] for i, t in made}
    p, pad, words = plain_model(tokens, {i for i in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2}, order)
    assert len(rows) == len(made)
    for r in rows:
        t = pad(tokens[r["doc_id"]])
        wanted = sum(math.log10(p(tuple(t[at - order + 1 : at]), t[at])) for at in range(order - 1, len(t)))
        assert r["score"] == pytest.approx(wanted, rel=1e-3)
    for history in (("<s>",) * (order - 1), tuple(pad(tokens[5])[3 : order + 2])):
        assert sum(p(history, w) for w in [*words, "never seen"]) == pytest.approx(1, rel=1e-9)


def test_trie_finds_what_it_holds_and_nothing_else(tmp_path):
    rng = np.random.default_rng(11)
    grams = np.unique(rng.zipf(1.3, (30_000, 3)) % 3000, axis=0)
    held = rng.random(len(grams)) < 0.6
    codes = rng.integers(1, 1000, len(grams)).astype(np.uint16)
    trie = lm.Trie.build([c[held] for c in grams.T], codes[held], 3000, str(tmp_path))
    assert trie.lookup(list(grams.T)).tolist() == np.where(held, codes, 0).tolist()


def test_elias_fano_is_exact():
    values = np.sort(np.random.default_rng(6).integers(0, 1 << 40, 500).astype(np.uint64))
    held = lm.EliasFano.build(values, 1 << 40)
    assert (held.access(np.arange(500)) == values).all()
    wanted = np.array([0, int(values[10]), int(values[10]) + 1, int(values[-1])], np.uint64)
    assert held.successor(np.zeros(4, np.int64), np.full(4, 500), wanted).tolist() == np.searchsorted(values, wanted).tolist()
