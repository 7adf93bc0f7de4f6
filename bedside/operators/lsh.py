"""Approximate nearest neighbours by random-projection buckets, and their recall."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.mixture import squared_distance
from bedside.operators.neighbours import SMALL, nearest
from bedside.session import cut

LEVELS = 128  # projections after which a crowded bucket is given up
WRITTEN = 4  # levels after which buckets are written


def _cell(features: list[str], tables: int, level: int, width: float, seed: int) -> Column:
    """Cell of a row's projection number ``level`` in its table ``_t``."""
    draw = np.random.default_rng([seed, level])
    slopes = draw.normal(size=(len(features), tables))
    shift = F.element_at(F.array(*[F.lit(float(x)) for x in draw.uniform(0, width, tables)]), F.col("_t") + 1)
    parts = [F.col(f) * F.element_at(F.array(*[F.lit(float(x)) for x in row]), F.col("_t") + 1) for f, row in zip(features, slopes)]
    return F.floor((reduce(add, parts) + shift) / width)


def buckets(rows: DataFrame, features: list[str], tables: int, bucket: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows by ``_t`` and ``_key``, keys still crowded). ``rows`` holds points
    (``_point``) and queries together.

    A bucket of more than ``bucket`` points is split by one more projection at a time,
    with cells that become narrower, so dense regions have narrow buckets and sparse
    ones wide ones; no bucket is capped. Points should be distinct.
    """
    spans = rows.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features]).first()
    spread = max([s for s in spans if s is not None] + [0.0]) or 1.0
    placed = rows.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    placed = cut(placed.withColumn("_key", F.xxhash64("_t")), "buckets")
    for level in range(LEVELS + 1):
        crowded = placed.filter("_point").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket)
        crowded = cut(crowded.select("_key", F.lit(True).alias("_split")), "crowded")
        number = crowded.count()
        if not number or level == LEVELS:
            return placed, crowded.select("_key")
        width = spread / 2.0 ** (level // len(features) + 1)
        met = placed.join(F.broadcast(crowded) if number <= SMALL else crowded, "_key", "left")
        split = F.xxhash64("_key", _cell(features, tables, level, width, seed))
        placed = met.withColumn("_key", F.when(F.col("_split"), split).otherwise(F.col("_key"))).drop("_split")
        if number > SMALL or level % WRITTEN == WRITTEN - 1:
            placed = cut(placed, "buckets")


def approximate_nearest(
    queries: DataFrame, points: DataFrame, features: list[str], k: int, tables: int = 16, bucket: int = 64,
    payload: str = "y", seed: int = 42,
) -> DataFrame:
    """(features, ``neighbours``) per distinct query vector as in :func:`nearest`, but
    from the points that share a bucket with the query in any of ``tables`` tables.

    A query meets at most ``tables * bucket`` distinct points, whatever the size of the
    data. A query that finds fewer than ``k`` is answered exactly instead, so every
    query has its ``k`` neighbours. Of equal points the first ``k`` ids are kept.
    """
    first = Window.partitionBy(*features).orderBy("id")
    usable = points.select("id", payload, *features).withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") <= k)
    copies = usable.groupBy(*features).agg(F.array_sort(F.collect_list(F.struct("id", payload))).alias("_ids"))
    copies = cut(copies, "points")
    asked = cut(queries.select(*features).distinct().withColumn("_query", F.monotonically_increasing_id()), "queries")
    none = F.lit(None)
    both = copies.select(*features, none.cast("long").alias("_query"), "_ids", F.lit(True).alias("_point")).unionByName(
        asked.select(*features, "_query", none.cast(copies.schema["_ids"].dataType).alias("_ids"), F.lit(False).alias("_point"))
    )
    placed, crowded = buckets(both, features, tables, bucket, seed)
    placed = placed.join(crowded, "_key", "left_anti")
    left = placed.filter("NOT _point").select("_key", "_query", *features)
    right = placed.filter("_point").select("_key", "_ids", *[F.col(f).alias(f"p_{f}") for f in features])
    d2 = squared_distance([(F.col(f), F.col(f"p_{f}")) for f in features])
    met = left.join(right, "_key").withColumn("d2", d2)
    vector = F.array(*[F.col(f"p_{f}") for f in features])
    # A point met in several tables counts once; its copies share its distance.
    met = met.select("_query", "d2", vector.alias("v"), F.explode("_ids").alias("p")).select(
        "_query", "d2", F.col("p.id").alias("id"), F.col(f"p.{payload}").alias(payload), "v"
    ).dropDuplicates(["_query", "id"])
    best = Window.partitionBy("_query").orderBy("d2", "id")
    near = met.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    found = near.groupBy("_query").agg(F.array_sort(F.collect_list(F.struct("d2", "id", payload, "v"))).alias("neighbours"))
    found = cut(asked.join(found, "_query", "left"), "found")
    short = F.coalesce(F.size("neighbours") < k, F.lit(True))
    rest = found.filter(short).select(*features)
    answered = found.filter(~short).drop("_query")
    return answered if rest.isEmpty() else answered.unionByName(nearest(rest, points, features, k, payload))


def recall(found: DataFrame, exact: DataFrame, features: list[str]) -> DataFrame:
    """One row: queries, neighbours asked for, and the share of them that ``found`` has.
    A neighbour of equal distance counts, whichever of the ties it is."""
    far = exact.select(*features, F.element_at("neighbours", -1)["d2"].alias("_far"), F.size("neighbours").alias("_asked"))
    hit = F.size(F.filter("neighbours", lambda n: n["d2"] <= F.col("_far")))
    both = far.join(found, features, "left").withColumn("_hit", F.coalesce(F.least(hit, "_asked"), F.lit(0)))
    return both.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("_asked").alias("asked"), (F.sum("_hit") / F.sum("_asked")).alias("recall")
    )
