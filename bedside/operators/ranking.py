"""Exact ranks, quantiles and hash-ordered quotas without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.operators.blocks import prefix_sums
from bedside.session import cut


def one_row(df: DataFrame) -> Column:
    """A one-row result as a struct column: a scalar subquery, not a join."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


# Values one range holds, about, and how many ranges there are at most.
RANGE_ROWS, RANGES = 4096, 20000


def in_ranges(counts: DataFrame, key: list[str], value: str) -> DataFrame:
    """Add ``_part``, the number of a range of (key, value) in order.

    ``counts`` has one row per (key, value). It is written once, and Spark's
    range shuffle takes the borders from the values themselves, so any
    distribution gives even ranges; the result is written, so the ranges stay as
    they are.
    """
    counts = cut(counts, "counts")
    ranges = min(max(1, -(-counts.count() // RANGE_ROWS)), RANGES)
    dealt = counts.repartitionByRange(ranges, *key, value)
    return cut(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def ranked_ranges(placed: DataFrame, key: list[str], value: str, weights: list[str]) -> DataFrame:
    """Add ``before_<w>`` to rows from :func:`in_ranges`: sums per range, then the
    place inside a range."""
    sums = placed.groupBy(*key, "_part").agg(*[F.sum(w).alias(w) for w in weights])
    starts = prefix_sums(sums, key, ["_part"], weights).select(
        *key, "_part", *[F.col(f"before_{w}").alias(f"_start_{w}") for w in weights]
    )
    inside = prefix_sums(placed, [*key, "_part"], [value], weights)
    return (
        inside.join(starts, [*key, "_part"])
        .withColumns({f"before_{w}": F.col(f"before_{w}") + F.col(f"_start_{w}") for w in weights})
        .drop("_part", *[f"_start_{w}" for w in weights])
    )


def ranked_counts(counts: DataFrame, key: list[str], value: str, weights: list[str]) -> DataFrame:
    """Add ``before_<w>``: the sum of each weight over smaller values of the key.

    ``counts`` has one row per (key, value), so repeated values are already
    collapsed; only the values of one range are sorted together.
    """
    return ranked_ranges(in_ranges(counts, key, value), key, value, weights)


def exact_quantiles(
    counts: DataFrame, key: list[str], value: str, probs: list[Column]
) -> DataFrame:
    """Linear-interpolated quantiles per key as an array, one entry per element
    of ``probs``; these may use the key's ``total`` and ``distinct`` counts.

    ``counts`` holds each (key, value) once with its row count ``n``. Keys are few
    (features, or none), so their totals are broadcast.
    """
    placed = in_ranges(counts, key, value)
    totals = placed.groupBy(*key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    ranked = ranked_ranges(placed, key, value, ["n"])
    if key:
        near = ranked.join(F.broadcast(totals), key)
    else:
        near = ranked.withColumn("_t", one_row(totals)).withColumns(
            {c: F.col(f"_t.{c}") for c in ("total", "distinct")}
        ).drop("_t")
    wanted = [p * (F.col("total") - 1) for p in probs]
    first = F.col("before_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < first + F.col("n")), F.col(value)))

    picks = []
    for i, w in enumerate(wanted):
        picks += [
            at(F.floor(w)).alias(f"lo{i}"), at(F.ceil(w)).alias(f"hi{i}"),
            F.max(w - F.floor(w)).alias(f"frac{i}"),
        ]
    return near.groupBy(*key).agg(*picks).select(
        *key,
        F.array(
            *[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"frac{i}")
              for i in range(len(probs))]
        ).alias("quantiles"),
    )


def quota_cut(df: DataFrame, group: str, order: Column, quota: Column) -> DataFrame:
    """Per group, the hash text up to which rows belong to the first ``quota``
    rows by hash order. ``quota`` is an expression over ``total``, the group's size.

    ``order`` is a hexadecimal md5, so its first four digits cut the rows into
    65536 even parts. Only the part that holds the border is looked at row by
    row, and the result has one row per group.
    """
    keyed = df.select(F.col(group), order.alias("_h")).withColumn("_p", F.substring("_h", 1, 4))
    parts = keyed.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("n"))
    running = prefix_sums(parts, [group], ["_p"], ["n"]).withColumn(
        "total", F.sum("n").over(Window.partitionBy(group))
    )
    border = (
        running.withColumn("_need", quota.cast("long") - F.col("before_n"))
        .filter((F.col("_need") > 0) & (F.col("_need") <= F.col("n")))
        .select(group, "_p", "_need")
    )
    by_hash = Window.partitionBy(group, "_p").orderBy("_h")
    return (
        keyed.join(F.broadcast(border), [group, "_p"])
        .withColumn("_rank", F.row_number().over(by_hash))
        .filter("_rank = _need")
        .select(group, F.col("_h").alias("cut"))
    )


def take_quota(df: DataFrame, group: str, order: Column, quota: Column, out: str) -> DataFrame:
    """Flag the first ``quota`` rows of each group by hash order. Groups are few
    (classes), so the border table is broadcast and ``df`` is not shuffled."""
    cuts = quota_cut(df, group, order, quota)
    return (
        df.join(F.broadcast(cuts), group, "left")
        .withColumn(out, F.coalesce(order <= F.col("cut"), F.lit(False)))
        .drop("cut")
    )
