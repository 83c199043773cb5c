"""From raw documents to packed training sequences, stage by stage.

Each stage gets all rows that the one before kept, and leaves out no other columns than its own: all but the last
return the columns of documents, whatever their names.  An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_dedup, minhash, mixing, packing, toxicity
from weftline.llm._common import discard, quoted, stored, table
from weftline.llm.catalog import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of the documents given.

    Null and empty texts score as the empty text; equal texts stay or go together; without labels of both kinds all stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the one with the largest id; n_chars, if there, follows the text.

    All rows stay, with a null text as an empty one; rows without an id keep their lines and are not counted.
    """
    kept = line_dedup.dedup_lines(docs)
    size = F.char_length("text")
    return kept.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id, with all rows that have it.

    Texts without words are one class; rows without an id stay.
    """
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked towards even sources, languages and topics.

    Null sources and languages are values of their own; documents without words stay with their cell's probability; rows
    with equal ids stay or go together.
    """
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; a null or empty text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but line dedup can be expressed in SQL; the tests hold each stage of a run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next, which then lets it go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
