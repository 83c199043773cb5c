"""Lines, records and words of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: str) -> Column:
    """The words between ASCII white space; none for an empty text."""
    return F.filter(F.split(F.col(text), "[\\x09-\\x0D\\x20]+"), lambda w: w != "")


def word_counts(objects: DataFrame, text: str, *by: str) -> DataFrame:
    return objects.select(*by, F.explode(words(text)).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def records(objects: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, pos, record) of all records between separators, empty ones included."""
    return objects.select(key, F.posexplode(F.split(F.col(text), re.escape(separator), -1)).alias("pos", "record")).select(key, F.col("pos").cast("long").alias("pos"), "record")
