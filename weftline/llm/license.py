"""Licence scans with DataFrame and SQL functions only.

A paragraph is a line with a word, or lines that were one before they were wrapped: each but the last
has at most 100 characters, and none is blank.  It becomes its words of ``[a-z0-9.+-]``, lower-cased.  A sparse
logistic regression over word n-grams (one to three words) gives each licence family, and an *unknown* class,
a probability; a family counts if it is the likeliest, beats ``least_probability`` and a template of it
confirms: a share ``least_overlap`` of the template's words occurs in the paragraph.  A family that a wrapped
paragraph shows is left out where one of its lines shows it.

Every n-gram of the model holds one of its anchor words, so that a paragraph without any anchor has no
feature and is certainly unknown; such paragraphs are set aside by one regular expression inside the
scan.  The rest are exploded to n-grams, which meet the weights (a fixed table made from the
templates) in a broadcast join and are summed for each paragraph.

The weights are trained in numpy from the templates with words dropped and surrounded by filler, and
from unknown paragraphs that use the same words loosely.  On held-out paragraphs the unknown class's offset
is then raised until at most one in a hundred unknown ones would be reported, and all weights are divided by
the temperature at which the probabilities' log loss is least.

Nulls and edge cases: a null or empty text has no paragraph; rows with a null id are scanned as one
document with a null id, and so are rows with equal ids; of equally likely families the last by name counts;
an empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import plain_text, quoted

#: Short public notices by family (fixed values).
TEMPLATES = {
    "apache": ("licensed under the apache license, version 2.0", "released under the apache license 2.0", "you may not use this file except in compliance with the apache license version 2.0", "spdx-license-identifier: apache-2.0"),
    "mit": ("released under the mit license", "licensed under the mit license", "mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "spdx-license-identifier: mit"),
    "bsd": ("licensed under the bsd 3-clause license", "released under the bsd license", "redistribution and use in source and binary forms, with or without modification, are permitted", "spdx-license-identifier: bsd-3-clause", "spdx-license-identifier: bsd-2-clause"),
    "gpl": ("this work is licensed under the gnu general public license, version 3", "licensed under the gnu gpl v2 or later", "free software: you can redistribute it and/or modify it under the terms of the gnu general public license", "spdx-license-identifier: gpl-3.0-or-later", "spdx-license-identifier: gpl-2.0-only"),
    "lgpl": ("licensed under the gnu lesser general public license", "released under the lgpl version 2.1", "spdx-license-identifier: lgpl-2.1-or-later"),
    "agpl": ("licensed under the gnu affero general public license version 3", "released under the agpl v3", "spdx-license-identifier: agpl-3.0-or-later"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license mpl 2.0", "spdx-license-identifier: mpl-2.0"),
    "cc": ("licensed under cc by-nc 4.0", "licensed under cc by-sa 4.0", "licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier: cc-by-4.0"),
    "proprietary": ("all rights reserved", "copyright all rights reserved do not distribute", "no part of this publication may be reproduced without permission"),
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Words too common to stand for a licence by themselves.
COMMON = frozenset("a an and any are be by can cc code do except file for form forms free in is it later may modify no not of or part person software source subject terms the this to under use v v. version with without work you 2 2.0 2.1 3 4.0 international compliance".split())
_WORD = re.compile(r"[a-z0-9.+-]+")


def words_of(text: str) -> list[str]:
    return [w.rstrip(".") or "." for w in _WORD.findall(text.lower())]


@functools.cache
def anchors() -> tuple[str, ...]:
    return tuple(sorted({w for family in TEMPLATES.values() for t in family for w in words_of(t) if w not in COMMON} | {"by-nc", "by-sa"}))


def grams(words: list[str]) -> set[str]:
    held = set(anchors())
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if not held.isdisjoint(words[i : i + n])}


@functools.cache
def trained_weights(copies: int = 60, seed: int = 7, rounds: int = 300) -> dict[str, tuple[float, ...]]:
    """Weight of each n-gram for each family, and the offsets under the empty string."""
    rng = random.Random(seed)
    filler = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    pad = lambda n: [rng.choice(filler) for _ in range(rng.randint(0, n))]
    examples = [(pad(6) + [w for w in words_of(t) if rng.random() > 0.08] + pad(6), k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f] for _ in range(copies)]
    loose = [*anchors(), *COMMON]
    examples += [(sum(([rng.choice(loose), *pad(4)] for _ in range(rng.randint(1, 5))), []), len(FAMILIES) - 1) for _ in range(12 * copies)]
    rng.shuffle(examples)
    names = sorted(set().union(*(grams(w) for w, _ in examples)))
    kept = {g for family in TEMPLATES.values() for t in family for g in grams(words_of(t))} | set(anchors())
    index = {g: i for i, g in enumerate(n for n in names if n in kept)}
    x = np.zeros((len(examples), len(index) + 1))
    x[:, -1] = 1
    for r, (w, _) in enumerate(examples):
        x[r, [index[g] for g in grams(w) if g in index]] = 1
    y = np.eye(len(FAMILIES))[[k for _, k in examples]]
    cut, theta, speed = len(x) * 3 // 4, np.zeros((x.shape[1], len(FAMILIES))), np.zeros((x.shape[1], len(FAMILIES)))
    for _ in range(rounds):
        p = _softmax(x[:cut] @ theta)
        speed = 0.9 * speed + x[:cut].T @ (y[:cut] - p) / cut - 1e-4 * theta
        theta += 2.0 * speed
    held = x[cut:][y[cut:, -1] == 1]
    while len(held) and (np.argmax(held @ theta, axis=1) != len(FAMILIES) - 1).mean() > 0.01:
        theta[-1, -1] += 0.1
    loss = lambda t: -np.log(np.maximum(_softmax(x[cut:] @ theta / t)[y[cut:] == 1], 1e-12)).mean()
    theta = theta / min(np.geomspace(0.25, 4, 33), key=loss)
    return {g: tuple(float(round(v, 4)) for v in theta[i]) for g, i in [*index.items(), ("", len(index))]}


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _weights(spark) -> DataFrame:
    rows = [f"('{g}', array({', '.join(f'{v}D' for v in w)}))" for g, w in trained_weights().items() if g]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(gram, w)")


#: A line break inside a wrapped paragraph: behind a line of at most 100 characters with a word, before another with a word.
_WRAP = r"\n(?<=(?:^|\n)[^\n]{1,100}\n)(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, last, words) of the paragraphs with an anchor word; ``at`` and ``last`` are line numbers from 0.

    Each line is one, and so are wrapped lines together, which share their first and differ in their last line.
    """
    pattern = "(?i)(?<![a-z0-9.+-])(" + "|".join(re.escape(a).replace("'", "") for a in anchors()) + r")(?![a-z0-9+-]|\.[a-z0-9.+-])"
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), plain_text(text_col).alias("text"))
    lines = texts.withColumn("lines", F.split("text", "\n", -1)).filter(F.exists("lines", lambda p: F.rlike(p, F.lit(pattern))))
    single = F.transform("lines", lambda line, at: F.struct(at.alias("at"), at.alias("last"), line.alias("text")))
    # Wrapped lines stay together by another sign than a line break; the breaks before a paragraph count its place.
    joined = F.split(F.regexp_replace("text", _WRAP, "\x01"), "\n", -1)
    breaks = lambda x: F.char_length(x) - F.char_length(F.translate(x, "\x01", ""))
    placed = F.aggregate(
        joined, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,last:int,text:string>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + breaks(x) + 1).alias("at"), F.when(breaks(x) > 0, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), (acc["at"] + breaks(x)).alias("last"), x.alias("text"))))).otherwise(acc["out"]).alias("out")),
    )["out"]
    each = lines.select("doc_id", F.explode(F.concat(single, placed)).alias("p")).filter(F.rlike("p.text", F.lit(pattern)))
    words = F.expr(r"transform(regexp_extract_all(lower(p.text), '[a-z0-9.+-]+', 0), w -> coalesce(nullif(rtrim('.', w), ''), '.'))")
    return each.select("doc_id", "p.at", "p.last", words.alias("words"))


def classify(docs: DataFrame, least_probability: float = 0.5, least_overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, last, family, probability, overlap, confirmed) of each paragraph with an anchor word."""
    spark, model = docs.sparkSession, trained_weights()
    found = paragraphs(docs, id_col, text_col).withColumn("row", F.struct("doc_id", "at", "last", "words"))
    every = "array_distinct(flatten(transform(array(1, 2, 3), n -> transform(filter(sequence(0, greatest(size(words) - n, 0)), i -> i + n <= size(words)), i -> array_join(slice(words, i + 1, n), ' ')))))"
    scored = found.select("row", F.explode(F.expr(every)).alias("gram")).join(F.broadcast(_weights(spark)), "gram")  # a fixed table
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))]
    totals = scored.groupBy("row").agg(*sums)
    z = [F.col(f"s{k}") + F.lit(model[""][k]) for k in range(len(FAMILIES))]
    best = F.greatest(*[F.struct(v.alias("z"), F.lit(f).alias("family")) for v, f in zip(z, FAMILIES, strict=True)])
    out = totals.withColumn("best", best).withColumn("probability", 1 / functools.reduce(lambda a, b: a + b, [F.exp(v - F.col("best.z")) for v in z]))
    overlap = F.lit(0.0)
    for family, texts in TEMPLATES.items():
        shares = [F.size(F.array_intersect("row.words", F.array(*[F.lit(w) for w in sorted(set(words_of(t)))]))) / F.lit(float(len(set(words_of(t))))) for t in texts]
        overlap = F.when(F.col("best.family") == family, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(overlap)
    out = out.withColumn("overlap", overlap)
    sure = (F.col("best.family") != UNKNOWN) & (F.col("probability") >= least_probability)
    return out.select("row.doc_id", "row.at", "row.last", F.when(sure, F.col("best.family")).otherwise(UNKNOWN).alias("family"), "probability", "overlap", (sure & (F.col("overlap") >= least_overlap)).alias("confirmed"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, licences (line:family, by line) and the least probability of the confirmed ones."""
    confirmed = classify(docs, id_col=id_col, text_col=text_col, **options).filter("confirmed")
    per_doc = confirmed.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("at", "family", "last", "probability"))).alias("shown"))
    # A wrapped paragraph counts only for families that none of its lines shows.
    of_line = "exists(shown, l -> l.last = l.at and l.family = w.family and l.at between w.at and w.last)"
    per_doc = per_doc.select("id", F.expr(f"filter(shown, w -> w.last = w.at or not {of_line})").alias("found"))
    counts = F.expr(f"size(filter(split(coalesce({quoted(text_col)}, ''), '\n', -1), p -> p rlike '[^\\\\x20\\\\x09-\\\\x0D]'))").cast("long")
    own = docs.select(F.col(quoted(id_col)).alias("doc_id"), counts.alias("n_paragraphs")).groupBy("doc_id").agg(F.sum("n_paragraphs").alias("n_paragraphs"))
    joined = own.join(per_doc, own["doc_id"].eqNullSafe(per_doc["id"]), "left")
    written = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["at"].cast("string"), x["family"])), ",")
    return joined.select("doc_id", "n_paragraphs", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licences"), F.coalesce(written, F.lit("")).alias("licences"), F.array_min(F.transform("found", lambda x: x["probability"])).alias("least_probability"))
