"""Reproducible pseudo-random choices: the same key gives the same draw on any
executor, after any retry, under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hash_text(seed: str, *parts: Column) -> Column:
    """md5 over the parts and a seed, joined by ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed)))


def hash_uniform(seed: str, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the md5."""
    head = F.conv(F.substring(hash_text(seed, *parts), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def sorted_digest(column: str) -> Column:
    """md5 of the strings of a group in order."""
    return F.md5(F.concat_ws(",", F.sort_array(F.collect_list(column))))


def content_keys(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, ``key``): an md5 over the distinct strings of each group, whatever
    their order.

    Strings are sorted inside 65536 even hash parts; the digest of a group is
    taken over its parts' digests, so no task gathers all strings of a group.
    """
    names = df.select(*by, column).distinct().withColumn("_part", F.substring(F.md5(column), 1, 4))
    parts = names.groupBy(*by, "_part").agg(sorted_digest(column).alias("_digest"))
    return parts.groupBy(*by).agg(sorted_digest("_digest").alias("key"))
