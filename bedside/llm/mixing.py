"""Mixing sources to target weights by a curriculum that varies in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.llm.common import one_row, prefix_sums
from bedside.session import cut

#: Weight of a source over training time, as (time, factor) knots joined by
#: straight lines; taken in turn by the sources in order.
SCHEDULES = (
    ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.7, 1.2), (1.0, 1.6)),
)


def invert_demand(share: Column, knots: tuple) -> Column:
    """Time at which the integral of the schedule reaches ``share`` of its total."""
    pieces, whole = [], 0.0
    for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
        pieces.append((whole, t0, f0, t1, f1))
        whole += (t1 - t0) * (f0 + f1) / 2
    out = F.lit(knots[-1][0])
    for start, t0, f0, t1, f1 in reversed(pieces):
        want = F.greatest(share * whole - start, F.lit(0.0))
        slope = (f1 - f0) / (t1 - t0)
        root = F.sqrt(F.greatest(want * (2 * slope) + f0 * f0, F.lit(0.0)))
        time = F.lit(t0) + F.least(2 * want / (root + f0 + 1e-300), F.lit(t1 - t0))
        end = start + (t1 - t0) * (f0 + f1) / 2
        out = F.when(share * whole <= end, time).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: float = 1.5, passes: int = 2
) -> DataFrame:
    """One row per source: ``key``, ``rank``, ``source_size``, ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last,
    have the weights in turn and share ``epochs`` times all sizes. A target
    stops at ``passes`` times the size of its source; the excess is shared again
    by weight until no target is above.
    """
    totals = cut(
        sizes.groupBy("source").agg(
            F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")
        ),
        "sources",
    )
    ranked = prefix_sums(totals, [F.col("source").asc_nulls_last()], "source_size", "ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", passes * F.col("source_size")), "weights")
    whole = one_row(totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")))["n"] * epochs
    level, capped = None, -1
    while True:  # each round caps one source more at least
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        now = one_row(ranked.agg(
            F.sum(full.cast("long")).alias("capped"),
            F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ))
        if not now["weight"] or now["capped"] == capped:
            break
        capped, level = now["capped"], max(whole - now["taken"], 0) / now["weight"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(0.0 if level is None else level))
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    epochs: float = 1.5,
    passes: int = 2,
    schedules: tuple = SCHEDULES,
    buckets: int = 1024,
) -> DataFrame:
    """Every document with the training positions the curriculum gives it.

    Returns ``row`` (the input row), ``size``, ``source_size``, ``target`` and
    ``positions``: one training time in [0, 1] per copy taken, none if the
    document is left out. The words of a source lie one after the other in the
    order of a hash of the id, and again for each further pass; a copy is taken
    if its middle lies below the target of the source, so the words taken miss
    the target by half a document at most. The position of a copy is the time at
    which the integral of the source's weight schedule has demanded its middle.

    Running totals are sums per (source, hash bucket) plus the place inside a
    bucket, so a source with a third of all rows is split ``buckets`` ways.
    Null sources form one source, a null size counts as 0 and sizeless documents
    are kept once as long as the target of their source is above 0 or the source is empty, those behind the target at the end. Null and
    repeated ids are allowed. Equal ids get equal hashes; reruns agree, except
    that rows alike in id and size may swap. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("row")[source_col]), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    )
    rows = rows.withColumn("key", key).withColumn("hash", F.xxhash64(F.col("row")[id_col]))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    parts = cut(
        rows.groupBy("key", F.col("row")[source_col].alias("source"), "bucket").agg(F.sum("size").alias("size")),
        "buckets",
    )
    targets = source_targets(parts, weights, epochs, passes).withColumn(
        "key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    )
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(
        parts.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(targets.drop("source"), "key")
        .select("key", "bucket", "start", "rank", "source_size", "target"),
        "starts",
    )
    inside = Window.partitionBy("key", "bucket").orderBy("hash", F.col("row")[id_col], "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # Sorted alike by the window, so merging costs no further shuffle of the rows.
    placed = placed.join(starts.hint("merge"), ["key", "bucket"])
    middle = F.col("start") + F.col("inside") + F.col("size") / 2
    times = F.lit(None).cast("array<double>")
    for i, knots in enumerate(schedules):
        own = F.transform("laps", _time_of_lap(knots))
        times = F.when(F.col("rank") % len(schedules) == i, own).otherwise(times)
    sizeless = (F.col("target") > 0) | (F.col("source_size") == 0)
    laps = F.filter(
        F.sequence(F.lit(0), F.lit(passes - 1)),
        lambda lap: F.when(F.col("size") == 0, (lap == 0) & sizeless)
        .otherwise(lap * F.col("source_size") + F.col("middle") <= F.col("target")),
    )
    return (
        placed.withColumn("middle", middle).withColumn("laps", laps)
        .select("row", "size", "source_size", "target", times.alias("positions"))
    )


def _time_of_lap(knots: tuple):
    def time(lap: Column) -> Column:
        demanded = F.try_divide(lap * F.col("source_size") + F.col("middle"), F.col("target"))
        return invert_demand(F.coalesce(demanded, F.lit(0.0)), knots)

    return time


def _training_order() -> list[Column]:
    """Copies by position; the hash of the row and the lap settle ties."""
    return [F.col("position"), F.xxhash64("row"), F.col("copy")]


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy with the columns of the input, range-sorted by position."""
    copies = mixed.select("row", F.posexplode("positions").alias("copy", "position"))
    order = _training_order()
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def mix_in_order(docs: DataFrame, size: Column, **options) -> DataFrame:
    """Every document with what the curriculum takes of it, read from the training order.

    :func:`mix` gives copies their positions, a range sort by position lays all copies
    in training order, and running totals over it say where each begins. Returns
    ``row``, ``size``, ``source_size``, ``target``, ``taken`` (words of its copies there),
    ``positions`` and ``starts``: words trained on before each of its copies. ``docs``
    should hold narrow columns, since copies are sorted with them.
    """
    mixed = cut(mix(docs, size, **options).withColumn("_at", F.monotonically_increasing_id()), "mixed")
    copies = mixed.select(
        "row", "size", "source_size", "target", "_at", F.posexplode_outer("positions").alias("copy", "position")
    ).withColumn("words", F.when(F.col("copy").isNotNull(), F.col("size")).otherwise(F.lit(0)))
    places = prefix_sums(copies, _training_order(), "words", "training-order")
    place = F.when(F.col("copy").isNotNull(), F.struct("copy", "position", "before"))
    found = places.groupBy("_at").agg(
        *[F.first(c).alias(c) for c in ("row", "size", "source_size", "target")],
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(place)).alias("places"),
    )
    return found.select(
        "row", "size", "source_size", "target", "taken",
        F.col("places.position").alias("positions"), F.col("places.before").alias("starts"),
    )
