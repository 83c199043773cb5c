"""Chunk plans, lines, words and listings of text objects.  A document is an object, its id the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.functions.globs import glob_to_regex
from weftline.operators import opaque
from weftline.operators.external import piped
from weftline.operators.ordered import running_before
from weftline.plans import chunks
from weftline.plans.text import records, word_counts, words
from weftline.queries.registry import query, table
from weftline.session import shared_folder
from weftline.sources import objects


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("key"))


@query("""SELECT doc_id, k + 1 AS part, n AS total_parts, k * 1000 AS range_start, least((k + 1) * 1000, size) AS range_end FROM (
  SELECT doc_id, size, n, unnest(range(n)) AS k FROM (SELECT doc_id, strlen(text) AS size, (strlen(text) + 999) // 1000 AS n FROM documents))""")
def chunk_plan_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_plan(_listing(spark, sf_dir), "doc_id", "size", chunk_size=1000)


@query("""SELECT doc_id, k + 1 AS part, n AS total_parts, k * c AS range_start, least((k + 1) * c, size) AS range_end FROM (
  SELECT *, unnest(range(n)) AS k FROM (SELECT *, (size + c - 1) // c AS n FROM (SELECT doc_id, strlen(text) AS size, (strlen(text) + 4) // 5 AS c FROM documents WHERE strlen(text) > 0)))""")
def chunk_plan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_plan(_listing(spark, sf_dir), "doc_id", "size", number=5, chunk_size=1000)


_OWNED = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
placed AS (SELECT doc_id, strlen(line) AS n, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
owned AS (SELECT doc_id, CAST(start // {c} + 1 AS BIGINT) AS part, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_bytes FROM placed GROUP BY 1, 2)"""


def _owned(spark: SparkSession, sf_dir: str, chunk: int) -> DataFrame:
    lines = chunks.owned_lines(table(spark, sf_dir, "documents"), "doc_id", "text", chunk)
    return lines.groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"))


@query("WITH " + _OWNED.format(c=1000) + " SELECT * FROM owned")
def chunk_row_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes of the lines that begin in each chunk."""
    return _owned(spark, sf_dir, 1000)


@query("WITH " + _OWNED.format(c=200) + """, plan AS (SELECT doc_id, unnest(range((strlen(text) + 199) // 200)) + 1 AS part FROM documents)
SELECT doc_id, part, coalesce(n_lines, 0) AS n_lines FROM plan LEFT JOIN owned USING (doc_id, part)""")
def chunk_empty_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk in which no line begins is a call all the same."""
    plan = chunks.chunk_plan(_listing(spark, sf_dir), "doc_id", "size", chunk_size=200).select("doc_id", "part")
    return plan.join(_owned(spark, sf_dir, 200), ["doc_id", "part"], "left").select("doc_id", "part", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("""SELECT doc_id, k + 1 AS part, md5(encode(text)[k * 1000 + 1 : (k + 1) * 1000]) AS chunk_md5 FROM (
  SELECT doc_id, text, unnest(range((strlen(text) + 999) // 1000)) AS k FROM documents)""")
def chunk_fixed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of bytes that may cut lines and characters."""
    return chunks.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000).select("doc_id", "part", F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, hex(encode(text)[11:50]) AS body FROM documents")
def range_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 10 to 49, counted from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(chunks.byte_range("text", 10, 49)).alias("body"))


_WORDS = "(SELECT source, doc_id, unnest(string_split(regexp_replace(text, '[\\x09-\\x0D ]+', ' ', 'g'), ' ')) AS word FROM documents) WHERE word <> ''"


@query(f"SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word")
def wordcount_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(table(spark, sf_dir, "documents"), "text")


@query(f"SELECT source, word, count(*) AS n FROM {_WORDS} GROUP BY source, word")
def wordcount_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(table(spark, sf_dir, "documents"), "text", "source")


@query(f"SELECT count(*) AS n FROM {_WORDS}")
def wordcount_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.sum(F.size(words("text"))).alias("n"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy(F.col("record").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, pos - 1 AS pos, strlen(record) AS n_bytes FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS record, generate_subscripts(string_split(text, '. '), 1) AS pos FROM documents)")
def custom_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(table(spark, sf_dir, "documents"), "doc_id", "text", ". ").select("doc_id", "pos", F.octet_length("record").cast("long").alias("n_bytes"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z0-9]+)://', 1) AS scheme, regexp_extract(url, '^[a-z0-9]+://([^/]*)', 1) AS bucket,
  regexp_extract(url, '^[a-z0-9]+://[^/]*/(.*/)?[^/]*$', 1) AS prefix, regexp_extract(url, '^[a-z0-9]+://[^/]*/(?:.*/)?([^/]*)$', 1) AS object FROM pages""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *paths.url_parts("url"))


@query("SELECT page_id, key FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS key FROM pages) WHERE regexp_matches(key, '^[^/]*/en/[^/]*$')")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).filter(F.col("key").rlike(glob_to_regex("*/en/*")))


@query("SELECT page_id, key FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS key FROM pages) WHERE starts_with(key, 'm.')")
def list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).filter(F.col("key").startswith("m."))


@query("SELECT split_part(key, '/', 1) AS child, bool_or(contains(key, '/')) AS is_dir FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS key FROM pages) GROUP BY 1")
def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.children(_keys(spark, sf_dir), "key")


@query("""SELECT folder, count(*) AS n_keys FROM (SELECT unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS folder
  FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages)) GROUP BY folder""")
def walk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder with the number of keys below it."""
    return paths.folders(_keys(spark, sf_dir), "key")


@query("SELECT doc_id, strlen(text) AS size FROM documents")
def head_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing holds after some keys were deleted."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_anti")


@query("SELECT doc_id, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def payload_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each payload begins when all are laid end to end."""
    return running_before(_listing(spark, sf_dir), "doc_id", F.col("size"), "start").select("doc_id", "start")


# ---- the same over files ------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> str:
    """The documents' texts as text files by source, in a new folder; its name with "/" behind stands for all of them."""
    folder = shared_folder(spark, "objects")
    table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(folder)
    return folder + "/"


def _source(uri: str) -> Column:
    return F.regexp_extract(uri, "/source=([^/]*)/", 1)


@query("SELECT source, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source")
def object_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes of stored objects by the folder that they are in."""
    return objects.lines(spark, [_files(spark, sf_dir)]).groupBy(_source("uri").alias("source")).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"))


_OBJECT_TOTALS = "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM documents GROUP BY source"


@query(_OBJECT_TOTALS)
def object_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of stored objects with the lines that begin in each, which together are all of an object's."""
    folder = _files(spark, sf_dir)
    plan = objects.plan(objects.listing(spark, [folder]), None, 4096)
    owned = objects.lines(spark, [folder]).groupBy("uri", (F.floor(F.col("start") / 4096) + 1).cast("long").alias("part")).agg(F.count("*").alias("n"))
    joined = plan.join(owned, ["uri", "part"], "left")
    return joined.groupBy(_source("uri").alias("source")).agg(F.sum(F.col("range_end") - F.col("range_start")).alias("n_bytes"), F.sum(F.coalesce("n", F.lit(0))).alias("n_lines"))


def _counted(obj: objects.ObjectChunk) -> int:
    return sum(len(line.split()) for line in obj.data_stream)


@query(f"SELECT source, count(*) AS n_words FROM {_WORDS} GROUP BY source")
def object_words_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function's call for each chunk of the stored objects, and the sum for each folder."""
    calls = objects.object_calls(spark, [_files(spark, sf_dir)], None, 1 << 20, "\n", {})
    counts = opaque.typed(opaque.apply(calls, _counted, keep=["uri"]), "long")
    return counts.groupBy(_source("uri").alias("source")).agg(F.sum("result").alias("n_words"))


@query("SELECT c_custkey, translate(c_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS answer FROM customer")
def external_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that is not Python's gets a line for each row and answers with one."""
    return piped(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", ["tr", "a-z", "A-Z"], "answer").select("c_custkey", "answer")
