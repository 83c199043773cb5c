"""URLs, and a folder view of flat keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of storage schemes (fixed values).
ALIASES = {"cos": "ibm_cos", "s3": "aws_s3"}


def split_url(url: str) -> tuple[str, str, str, str]:
    """(scheme, bucket, prefix, object) of ``scheme://bucket/prefix/object``; a trailing "/" ends a prefix."""
    scheme, found, rest = url.partition("://")
    if not found or not rest:
        raise ValueError(f"not a storage URL: {url}")
    bucket, _, key = rest.partition("/")
    prefix, _, name = key.rpartition("/")
    return ALIASES.get(scheme, scheme), bucket, prefix, name


def url_parts(url: str) -> list[Column]:
    at = lambda pattern, name: F.regexp_extract(url, pattern, 1).alias(name)
    return [at("^([a-z0-9]+)://", "scheme"), at("^[a-z0-9]+://([^/]*)", "bucket"), at("^[a-z0-9]+://[^/]*/(.*/)?[^/]*$", "prefix"), at("^[a-z0-9]+://[^/]*/(?:.*/)?([^/]*)$", "object")]


def children(listing: DataFrame, key: str, folder: str = "") -> DataFrame:
    """(child, is_dir): the names right below ``folder``."""
    inside = listing.filter(F.col(key).startswith(folder)).select(F.substring(key, len(folder) + 1, 1 << 30).alias("rest"))
    return inside.groupBy(F.split_part("rest", F.lit("/"), F.lit(1)).alias("child")).agg(F.bool_or(F.contains("rest", F.lit("/"))).alias("is_dir"))


def folders(listing: DataFrame, key: str) -> DataFrame:
    """(folder, n_keys): every folder above a key, with the number of keys below it."""
    parts = listing.select(F.split(key, "/").alias("p")).filter("size(p) > 1")
    each = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("folder"))
    return each.groupBy("folder").agg(F.count("*").alias("n_keys"))
