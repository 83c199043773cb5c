"""Canonical exact digests of documents, with DataFrame and SQL functions only.

A text's canonical form is its NFKC normalisation under Unicode case folding, with each run of white
space made one space and none at the ends.  Its fingerprint is two 64-bit xxhash values under
different seeds.  The canonical texts of fingerprint buckets with several documents are told apart by
their bytes; where a bucket holds different ones, all but one of them get the SHA-256 of the canonical
form appended, so that equal fingerprints always mean equal canonical texts.

Nulls and edge cases: a null text is an empty one; a null id is an id like others and the last in the
order; equal rows have equal fingerprints, and each row has its own row in a result; rows with equal
ids have the same next document, the row of the next id whose text has the smallest hash; the next one
of an only id is itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._common import plain_text, stored

#: White space besides the plain space.
_OTHER = r"\t\n\x0B\f\r\u0085\u00a0\u2028\u2029"
SALTS = 16


def canonical(text: Column) -> Column:
    """NFKC, folded case, single spaces.  ASCII texts need lower case only.

    A lone plain space is left as it is, so that most words need no replacement.
    """
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.btrim(F.regexp_replace(plain, f" *[{_OTHER}][ {_OTHER}]*|  +", " "))


def wide_hash(canon: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), canon)), 16, "0")))


def shared(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (id, wide and others) whose bucket has several; a large bucket is dealt by its ids to ``SALTS`` parts."""
    crowded = rows.groupBy("wide").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = crowded.select("wide", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(crowded, ["wide", "salt"], "left_semi").drop("salt")


def collisions(texts: DataFrame) -> DataFrame:
    """(wide, lead) of the buckets of ``texts`` (wide, canon) that hold different texts; ``lead`` is the smallest SHA-256.

    Copies are compared by their bytes and counted once in the tasks that read them, so that a large group moves
    a row for each task.
    """
    kinds = texts.select("wide", "canon").distinct().select("wide", F.sha2("canon", 256).alias("sha"))
    return kinds.groupBy("wide").agg(F.count("*").alias("n"), F.min("sha").alias("lead")).filter("n > 1").select("wide", "lead")


def with_print(rows: DataFrame, collided: DataFrame, wide: str, sha: str, name: str, broadcast_rows: int = 100_000) -> DataFrame:
    """``rows`` with the fingerprint of the text of hash ``wide`` and SHA-256 ``sha``; the few buckets with different texts are broadcast up to ``broadcast_rows``."""
    few = collided.limit(broadcast_rows + 1).count()
    if not few:
        return rows.withColumn(name, F.col(wide))
    side = collided.select(F.col("wide").alias("_bucket"), F.col("lead").alias("_lead"))
    joined = rows.join(F.broadcast(side) if few <= broadcast_rows else side, F.col(wide) == F.col("_bucket"), "left")
    return joined.withColumn(name, F.concat_ws("-", wide, F.when(F.col(sha) != F.col("_lead"), F.col(sha)))).drop("_bucket", "_lead")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column and ``fingerprint`` of each row; equal fingerprints are proven by comparing bytes.

    Only the texts of buckets with several documents are compared.
    """
    canon = docs.select(F.col(id_col).alias("id"), canonical(plain_text(text_col)).alias("canon")).withColumn("wide", wide_hash(F.col("canon")))
    light = stored(canon.select("id", "wide", F.sha2("canon", 256).alias("sha")), "digests")
    several = shared(light).select("id").distinct()
    collided = stored(collisions(canon.join(several, canon["id"].eqNullSafe(several["id"]), "left_semi")), "collisions")
    return with_print(light, collided, "wide", "sha", "fingerprint").select(F.col("id").alias(id_col), "fingerprint")


def next_document(ids: DataFrame) -> DataFrame:
    """The columns of ``ids`` (id, ``most`` and more short ones; distinct ids), next_id, prev_id and prev_most in ascending order; the last one's next is the first.

    Ids are dealt to ordered ranges; within a range a window finds the neighbour, and between ranges a table with one
    row for each range does.
    """
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = ids.withColumn("key", F.struct(F.col("id").isNull().alias("absent"), "id", "most"))
    # Both uses of the ranges read one table: bounds are sampled, and need not be the same in another run.
    dealt = stored(keyed.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("part").orderBy("key")
    near = dealt.withColumn("next_in", F.lead("key").over(w)).withColumn("prev_in", F.lag("key").over(w))
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    whole = Window.orderBy("part")  # one row for each range, at most spark.sql.shuffle.partitions
    unbounded = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "part",
        F.coalesce(F.lead("low").over(whole), F.first("low").over(unbounded)).alias("next_out"),
        F.coalesce(F.lag("high").over(whole), F.last("high").over(unbounded)).alias("prev_out"),
    )
    after, before = F.coalesce("next_in", "next_out"), F.coalesce("prev_in", "prev_out")
    joined = near.join(F.broadcast(edges), "part")
    return joined.select(*ids.columns, after["id"].alias("next_id"), before["id"].alias("prev_id"), before["most"].alias("prev_most"))


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all rows and of their edited texts, whose last quarter is the next document's head.

    Returns the id column, n_chars, edited_sha256, fingerprint, edited_fingerprint and next_fingerprint, a row for each row.
    Texts move twice: each to the neighbours of its id, and the heads (a quarter at most) to the document before.
    """
    same = lambda left, right: left.eqNullSafe(right)
    base = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text"))
    canon = base.select("id", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("hash"), canonical(F.col("text")).alias("canon"))
    light = stored(canon.select("id", "n_chars", "hash", wide_hash(F.col("canon")).alias("wide")), "digests")
    order = next_document(light.groupBy("id").agg(F.max("n_chars").alias("most"), F.min("hash").alias("lead")))
    several = shared(light.select("id", "wide")).select("id").distinct()
    several = several.select(F.col("id").alias("crowd_id"), F.lit(True).alias("crowd"))
    order = order.join(several, same(F.col("id"), F.col("crowd_id")), "left").withColumn("several", F.coalesce("crowd", F.lit(False))).drop("crowd_id", "crowd")
    order = stored(order, "order").withColumnRenamed("id", "own_id")
    full = base.join(order, same(F.col("id"), F.col("own_id"))).drop("own_id")
    # No filter, which would become a key of the join and keep its shuffle of texts from being used twice.
    head = F.when(F.xxhash64("text") == F.col("lead"), F.expr("substring(text, 1, cast(floor(prev_most / 4) as int))"))
    heads = full.select(F.col("prev_id").alias("head_id"), head.alias("head")).groupBy("head_id").agg(F.min("head").alias("head"))
    edited = full.join(heads, same(F.col("id"), F.col("head_id"))).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = "cast(floor(n_chars / 4) as int)"
    edited = edited.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {quarter}), substring(head, 1, {quarter}))"))
    edited = edited.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    equal = F.col("canon") == F.col("edited_canon")
    digests = stored(
        edited.select(
            "id", "n_chars", "next_id", (F.xxhash64("text") == F.col("lead")).alias("leads"), F.sha2("edited", 256).alias("edited_sha256"), equal.alias("equal"),
            wide_hash(F.col("canon")).alias("wide"), F.sha2("canon", 256).alias("sha"), wide_hash(F.col("edited_canon")).alias("edited_wide"),
            F.sha2("edited_canon", 256).alias("edited_sha"), F.when(F.col("several"), F.col("canon")).alias("canon"),
        ),
        "edited",
    )
    collided = stored(collisions(digests.filter("canon is not null")), "collisions")
    out = with_print(digests.drop("canon"), collided, "wide", "sha", "fingerprint")
    out = with_print(out, collided, "edited_wide", "edited_sha", "edited_print")
    # An edited text of another canonical form than its document has another fingerprint, whatever their hashes.
    other = F.when(F.col("edited_print") == F.col("fingerprint"), F.concat_ws("-", "edited_wide", "edited_sha")).otherwise(F.col("edited_print"))
    out = out.withColumn("edited_fingerprint", F.when(F.col("equal"), F.col("fingerprint")).otherwise(other))
    after = out.filter("leads").groupBy(F.col("id").alias("after_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    joined = out.join(after, same(F.col("next_id"), F.col("after_id")))
    return joined.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
