"""The pipeline's run, stage by stage, against plain versions on what the stage before kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from test_operators import plain_dedup
from weftline.llm import minhash, mixing, toxicity


def shingles(text: str) -> Counter:
    words = text.lower().split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def alike_pairs(texts: dict[int, str], least: float = 0.8) -> dict[tuple[int, int], float]:
    """All pairs that share a shingle and are alike enough, by their whole sets."""
    sets, holders = {i: shingles(t) for i, t in texts.items()}, defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    pairs = {(a, b) for some in holders.values() for k, b in enumerate(some) for a in some[:k]}
    found = {}
    for a, b in pairs:
        share = sum((sets[a] & sets[b]).values()) / sum((sets[a] | sets[b]).values())
        if share >= least:
            found[a, b] = share
    return found


def plain_classes(texts: dict[int, str]) -> dict[int, int]:
    parent = {i: i for i in texts}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    empty = sorted(i for i, t in texts.items() if not t.split())
    for a, b in [*alike_pairs(texts), *zip(empty, empty[1:], strict=False)]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in texts}


def test_near_duplicates_of_a_corpus_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    pairs = alike_pairs(texts)
    linked = {p: classes[p[0]] == classes[p[1]] for p in pairs}
    assert len(pairs) > 80 and np.mean(list(linked.values())) > 0.99
    assert np.mean([linked[p] for p, s in pairs.items() if s < 0.9] or [1]) >= 0.9
    assert sum(classes[i] != c for i, c in plain_classes(texts).items()) <= 2


def test_run_equals_plain_stages(spark, small, monkeypatch):
    import corpus_pipeline

    seen = []
    keep = corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    monkeypatch.setattr(corpus_pipeline, "discard", lambda *frames: None)
    packed = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [{r["doc_id"]: r for r in frame.collect()} for frame in (docs, *seen)]
    assert all(frame.columns == docs.columns for frame in seen)
    first, calm, lines, single, mixed = rows

    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    weights = toxicity._Weights(model.lexicon)
    scores = model.scores([(r["text"] or "").encode() for r in first.values()], weights)
    assert set(calm) == {i for i, s in zip(first, scores, strict=True) if s < 0.5}
    assert all(r == first[i] for i, r in calm.items())

    wanted = plain_dedup({i: r["text"] or "" for i, r in calm.items()})
    assert {i: (r["text"], r["n_chars"]) for i, r in lines.items()} == {i: (t, len(t)) for i, (t, _) in wanted.items()}

    classes = plain_classes({i: r["text"] for i, r in lines.items()})
    assert set(single) == {i for i, c in classes.items() if i == c} and all(r == lines[i] for i, r in single.items())

    whole = mixing.mix(seen[2]).select("doc_id", "_probability", "_kept").collect()
    assert set(mixed) == {r["doc_id"] for r in whole if r["_kept"]} and all(r == single[i] for i, r in mixed.items())
    assert sum(r["_probability"] for r in whole) == pytest.approx(len(mixed), rel=0.2) and len(mixed) > 0.75 * len(whole)

    assert {r["doc_id"] for r in packed} == set(mixed)
    held = defaultdict(int)
    for r in packed:
        held[r["doc_id"]] += r["length"]
    assert all(held[r["doc_id"]] == r["doc_tokens"] for r in packed)
