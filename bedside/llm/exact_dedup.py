"""Exact duplicates by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bedside.llm.common import BLANKS
from bedside.session import cut


def normal_text(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct (digest, text) with its smallest id and row count.

    The first aggregate removes copies inside each task before anything is
    shuffled and merges the rest per (digest, text, salt), so that a text held
    by a third of all rows is spread over ``salts`` groups. The second combines
    the winners of the salts. Whole texts are keys of both: equal digests alone
    never make two texts one.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    salted = rows.groupBy("digest", "text", salt.alias("salt")).agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 8,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Class of equal texts of every row.

    Texts are equal when identical after ``normal_text``; the row with the
    smallest id stays. Returns one row per input row, dropped ones too:
    ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of the
    normalised text.

    A null text counts as empty. A null id loses against any other; a class of
    null ids only has a null ``keep_id`` and keeps its rows. Rows repeated with
    the same id and text are alike: each is counted, and all are kept or none.
    An empty table gives an empty result. Other columns are never read.

    Rows find their class by digest. Should two texts ever share a digest, the
    rows of that digest are matched by whole text instead.
    """
    text = normal_text(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"))
    classes = cut(_combine(rows, salts).select("digest", "keep_id", "group_size"), "classes")
    shared = classes.groupBy("digest").count().filter("count > 1").select("digest")
    ids = rows.select("id", "digest")
    if shared.isEmpty():
        found = ids.join(classes, "digest")
    else:
        shared = cut(shared, "shared")
        mixed = rows.join(shared, "digest", "left_semi")
        told_apart = _combine(mixed, salts)
        found = ids.join(shared, "digest", "left_anti").join(classes, "digest").select(
            "id", "digest", "keep_id", "group_size"
        ).unionByName(
            mixed.join(told_apart, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        )
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    stay = exact_dedup(docs, id_col, text_col).filter("kept").select("doc_id", "digest")
    same = docs[id_col].eqNullSafe(stay["doc_id"]) & (sha256(normal_text(docs[text_col])) == stay["digest"])
    return docs.join(stay, same, "left_semi")
