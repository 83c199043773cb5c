"""Nulls, empty texts and tables, repeated rows, and columns with clashing names."""

from __future__ import annotations

import pytest

from weftline.llm import catalog, fingerprint, license, line_dedup, lm, minhash, mixing, packing, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, _tokens long, label string, band long"
LONG = "word " * 50_000
EXTRA = "`_drop` string, `_gone` string, `_weight` double, `_topic` long, `_kept` boolean, `a b` int, `_toxicity` double, `toxicity` int, `vec` string, `cell_source` string"
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same line of more than twenty", "en", "a", 9), (3, "same line of more than twenty", "en", "a", 9), (4, "same line of more than twenty", "de", None, 9), (5, "é\n" + LONG, "fr", "b", 8)]


def model(spark) -> toxicity.ToxicityModel:
    return toxicity.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))


OPERATORS = {
    "toxicity": lambda spark, d: model(spark).apply(d),
    "packing": lambda spark, d: packing.pack(d, catalog.tokenizer_path()),
    "pii": lambda spark, d: pii.detect(d, pii.BiLstmCrf()),
    "quality": lambda spark, d: quality.judge(d, quality.fit(d, spark.createDataFrame([], "doc_id long, quality int"))),
    "fingerprint": lambda spark, d: fingerprint.exact_groups(d),
    "edited": lambda spark, d: fingerprint.edited_digests(d),
    "mixing": lambda spark, d: mixing.mix(d),
    "line_dedup": lambda spark, d: line_dedup.dedup_lines(d),
    "minhash": lambda spark, d: minhash.near_duplicate_classes(d),
    "license": lambda spark, d: license.scan(d),
    "lm": lambda spark, d: lm.score_corpus(d),
}
BY_ROW = ("toxicity", "pii", "quality", "fingerprint", "edited", "mixing", "line_dedup", "lm")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_names(spark, name):
    rows = [(*r, 1, 0.5, 7, "x", 3, "d", "g", 0.1, 5, True, 9, 0.2, 1, "v", "c") for r in [*ROWS, (None, "no id", "en", "a", 5)]]
    out = OPERATORS[name](spark, spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}")).collect()
    ids = [r["doc_id"] for r in out]
    assert {1, 2, 3, 4, 5} <= set(ids)
    if name in BY_ROW:
        assert len(out) == len(rows)
    if name in ("mixing", "line_dedup"):  # the columns that were there are as they were
        assert all((r["_drop"], r["_weight"], r["_topic"], r["a b"], r["_tokens"]) == ("d", 0.1, 5, 9, 7) for r in out)


def test_pipeline_stages_take_any_rows(spark, small):
    import corpus_pipeline

    rows = [(*r, 1, 0.5, 7, "x", 3, "d", "g", 0.1, 5, True, 9, 0.2, 1, "v", "c") for r in [*ROWS, (None, "no id", "en", "a", 5)]]
    for made in (rows, []):
        docs = spark.createDataFrame(made, f"{SCHEMA}, {EXTRA}")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "packing":
                assert out.columns == docs.columns
                assert (out.count() == docs.count()) if name in ("toxicity", "line_dedup") else out.count() <= docs.count()
            else:
                assert out.filter("start = 0").count() == len(made)
