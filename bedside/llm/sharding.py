"""Shards along a Hilbert curve over metadata, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bedside.llm.common import one_row, prefix_sums
from bedside.session import cut


def hilbert_steps(cells: DataFrame, dims: list[str], bits: int, name: str) -> DataFrame:
    """Add column ``name``: the position on the Hilbert curve of the point ``dims``,
    each an integer of ``bits`` bits. Every step is a projection of its own, so that
    expressions stay small."""
    n = len(dims)
    x = [f"_x{i}" for i in range(n)]
    at = cells.select("*", *[F.col(d).cast("long").alias(c) for d, c in zip(dims, x, strict=True)])
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i, c in enumerate(x):
            is_set = F.col(c).bitwiseAND(F.lit(1 << bit)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(F.lit(low))
            at = at.withColumn("_t", F.when(is_set, F.lit(0)).otherwise(swap))
            first = F.when(is_set, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(F.col("_t")))
            at = at.withColumn(x[0], first)
            if i:
                at = at.withColumn(c, F.col(c).bitwiseXOR(F.col("_t")))
    for i in range(1, n):
        at = at.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for bit in range(bits - 1, 0, -1):
        is_set = F.col(x[-1]).bitwiseAND(F.lit(1 << bit)) != 0
        turn = turn.bitwiseXOR(F.when(is_set, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    at = at.withColumn("_t", turn)
    index = F.lit(0).cast("long")
    for bit in range(bits):
        for i, c in enumerate(x):
            one = F.shiftright(F.col(c).bitwiseXOR(F.col("_t")), bit).bitwiseAND(F.lit(1))
            index = index + F.shiftleft(one, bit * n + (n - 1 - i))
    return at.withColumn(name, index).drop("_t", *x)


def level_of_size(size: Column, bits: int) -> Column:
    """Logarithmic size level: half a doubling per step from 16 on."""
    level = F.floor(2 * F.log2(F.greatest(size, F.lit(16)) / 16))
    return F.least(level, F.lit((1 << bits) - 1)).cast("int")


def level_of_values(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, level): values in order, cut so that levels hold about as many rows
    each; null has level 0. One row per distinct value is sorted, never the rows."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    placed = prefix_sums(counts, [F.col(column)], "_c", "values")
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(1)).alias("n"))
    level = F.floor(F.col("before") * (1 << bits) / F.lit(one_row(total)["n"]))
    return placed.select(column, level.cast("int").alias(f"{column}_level"))


def hilbert_shards(
    rows: DataFrame, id_col: str, size_col: str, value_cols: list[str], shards: int, bits: int = 5, parts: int = 256
) -> DataFrame:
    """Add ``rank``, ``shard`` and ``slot`` to every row: shards are runs of the
    Hilbert curve over the size level and the levels of ``value_cols``, so that a
    shard spans a narrow range of each and a reader can skip files by any of them.

    Shards differ by one row at most; ``slot`` counts from 0 inside a shard.
    Ranks are counts of earlier cells plus the place inside a part of a cell:
    only rows of one of the ``parts`` of one cell are sorted together, so a cell
    with a third of all rows is spread. The order inside a cell is that of a
    hash of the id, then the id and the remaining columns; rows alike in all of
    them may swap places.

    Null sizes count as 0, null values have level 0, null ids are allowed. With
    fewer rows than shards some shards stay empty; an empty table gives none.
    """
    dims = [f"{c}_level" for c in value_cols]
    at = rows.withColumn("size_level", level_of_size(F.coalesce(F.col(size_col), F.lit(0)), bits))
    for c in value_cols:
        at = at.join(level_of_values(rows, c, bits), c, "left").fillna(0, [f"{c}_level"])
    at = cut(
        at.withColumn("_h", F.xxhash64(id_col)).withColumn("_sub", F.pmod("_h", F.lit(parts)).cast("int")),
        "levels",
    )
    cell = ["size_level", *dims, "_sub"]
    counts = at.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    curve = hilbert_steps(counts, ["size_level", *dims], bits, "_curve")
    starts = prefix_sums(curve, [F.col("_curve"), F.col("_sub")], "_c", "cells").select(
        *cell, F.col("before").alias("_start")
    )
    total = one_row(at.agg(F.count(F.lit(1)).alias("n")))["n"]
    rest = [c for c in rows.columns if c not in (id_col,)]
    inside = Window.partitionBy(*cell).orderBy("_h", id_col, *rest)
    # Starts are as many as occupied parts of cells: small files, large once unpacked,
    # so they are merged with the rows that the window has sorted the same way.
    ranked = at.join(starts.hint("merge"), cell).withColumn("rank", F.col("_start") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"int((rank * {shards}) div {max(total, 1)})"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("rank") - first).drop("_h", "_sub", "_start")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard of every document under the law ``rows``: counts at most one apart.

    ``size`` is the UTF-8 length of the text plus 16 (null: 16), ``text_crc32``
    the checksum of its bytes (null: of none). Extra columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        "source",
        "lang",
    )
    return hilbert_shards(rows, "doc_id", "size", ["source", "lang"], shards)


def write_shards(docs: DataFrame, path: str, shards: int = 40, file_rows: int = 1 << 20) -> None:
    """Write all documents with their columns under ``path/_shard=<n>`` in curve
    order, and under ``path.bounds`` the least and greatest size, source and language
    of each shard, so that :func:`read_shards` opens only shards a filter can meet.

    A shard is written in runs of about ``file_rows`` rows, so no task holds a whole
    shard. Bounds are taken from the files and written last. Columns of ``docs`` keep
    their names; an empty table writes no shard.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), "source", "lang",
    )
    placed = hilbert_shards(rows, "_id", "size", ["source", "lang"], shards)
    run = F.floor(F.col("slot") / file_rows)
    dealt = placed.select("_row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), run.alias("_run"))
    dealt = dealt.repartition("_shard", "_run").sortWithinPartitions("_shard", "_slot").drop("_slot", "_run")
    dealt.write.partitionBy("_shard").parquet(path)
    if placed.isEmpty():
        return
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    bounds = docs.sparkSession.read.parquet(path).groupBy("_shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min(size).alias("lo_size"), F.max(size).alias("hi_size"),
        *[f(c).alias(f"{side}_{c}") for c in ("source", "lang") for side, f in (("lo", F.min), ("hi", F.max))],
    )
    bounds.write.parquet(f"{path}.bounds")


def read_shards(
    spark: SparkSession, path: str, size: tuple[int, int] | None = None, source: str | None = None, lang: str | None = None
) -> DataFrame:
    """Documents of the given size (both ends included), source and language, read from
    the shards whose bounds can hold such; the bounds have one row per shard."""
    bounds = spark.read.parquet(f"{path}.bounds")
    for column, low, high in (("size", *(size or (None, None))), ("source", source, source), ("lang", lang, lang)):
        if low is not None:
            bounds = bounds.filter((F.col(f"lo_{column}") <= F.lit(high)) & (F.col(f"hi_{column}") >= F.lit(low)))
    chosen = sorted(r["_shard"] for r in bounds.select("_shard").collect())
    paths = [f"{path}/_shard={n}" for n in chosen]
    found = spark.read.option("basePath", path).parquet(*paths) if paths else spark.read.parquet(path).limit(0)
    if size is not None:
        found = found.filter((F.coalesce(F.octet_length("text"), F.lit(0)) + 16).between(*size))
    for column, value in (("source", source), ("lang", lang)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    return found.drop("_shard")
