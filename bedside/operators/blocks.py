"""Ordered work inside a patient without putting a whole patient in one task.

Rows of a patient are cut into blocks of at most ``size`` consecutive rows.
Window functions run per (patient, block); what must cross a block border is
either carried as one summary row per block or copied as a few border rows.
Patients shorter than one block, nearly all of them, take one shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16


def prefix_sums(sizes: DataFrame, key: list[str], blocks: list[str], weights: list[str]) -> DataFrame:
    """Add ``before_<w>``: the sum of ``w`` over all earlier entries of a key.

    ``sizes`` has one row per (key, blocks); ``blocks`` go from coarse to fine.
    Each level only orders the children of one parent, so no window holds
    more rows than one level branches.
    """
    parents = blocks[:-1]
    earlier = (
        Window.partitionBy(*key, *parents)
        .orderBy(blocks[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = sizes.withColumns(
        {f"before_{w}": F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w in weights}
    )
    if not parents:
        return inside
    sums = sizes.groupBy(*key, *parents).agg(*[F.sum(w).alias(w) for w in weights])
    outer = prefix_sums(sums, key, parents, weights).select(
        *key, *parents, *[F.col(f"before_{w}").alias(f"outer_{w}") for w in weights]
    )
    return (
        inside.join(outer, [*key, *parents])
        .withColumns({f"before_{w}": F.col(f"before_{w}") + F.col(f"outer_{w}") for w in weights})
        .drop(*[f"outer_{w}" for w in weights])
    )


def number_rows(
    df: DataFrame, key: list[str], order: list[str], blocks: list[Column], out: str = "t", size: int = BLOCK
) -> DataFrame:
    """Number the rows of each key 0, 1, 2 ... by ``order``.

    Keys of at most ``size`` rows are sorted whole, with one shuffle of the rows. For
    longer ones ``blocks`` are expressions that never decrease along ``order``, coarse to
    fine (a month, then a day): only rows of one block are sorted together. Rows with a
    NULL in the key or a block are counted but left out.
    """
    whole = df.dropna(subset=key)
    # At most one key per ``size`` rows, so the list is small by count.
    long_keys = F.broadcast(whole.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).select(*key))
    inside = Window.partitionBy(*key).orderBy(*order)
    short = whole.join(long_keys, key, "left_anti").withColumn(out, F.row_number().over(inside) - 1)
    short = short.filter(reduce(and_, [b.isNotNull() for b in blocks]))
    return short.unionByName(_number_by_blocks(whole.join(long_keys, key, "left_semi"), key, order, blocks, out))


def _number_by_blocks(df: DataFrame, key: list[str], order: list[str], blocks: list[Column], out: str) -> DataFrame:
    names = [f"_b{i}" for i in range(len(blocks))]
    tagged = df.withColumns(dict(zip(names, blocks)))
    sizes = tagged.groupBy(*key, *names).agg(F.count(F.lit(1)).alias("n"))
    starts = prefix_sums(sizes, key, names, ["n"]).select(*key, *names, "before_n")
    inside = Window.partitionBy(*key, *names).orderBy(*order)
    return (
        tagged.withColumn("_r", F.row_number().over(inside))
        .join(starts, [*key, *names])
        .withColumn(out, (F.col("before_n") + F.col("_r") - 1).cast("int"))
        .drop(*names, "_r", "before_n")
    )


def block_of(t: str = "t", size: int = BLOCK) -> Column:
    return F.expr(f"cast({t} div {size} as int)")


def in_blocks(chart: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Add ``blk``; rows within ``back`` (``ahead``) of a border are also copied
    into the next (previous) block so that row frames reach across it."""
    if max(back, ahead) > size:
        raise ValueError("a frame may not reach over a whole block")
    own = block_of(size=size)
    offset = F.col("t") % size
    homes = [own]
    if back:
        homes.append(F.when(offset >= size - back, own + 1))
    if ahead:
        homes.append(F.when((offset < ahead) & (own > 0), own - 1))
    if len(homes) == 1:
        return chart.withColumn("blk", own)
    return chart.withColumn("blk", F.explode(F.array_compact(F.array(*homes))))


def own_rows(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Drop the border copies made by :func:`in_blocks`."""
    return df.filter(F.col("blk") == block_of(size=size))


def block_window() -> Window:
    return Window.partitionBy("pid", "blk").orderBy("t")


def patient_blocks(chart: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per (patient, block) with the patient's length and last label."""
    per_patient = chart.groupBy("pid").agg(
        (F.max("t") + 1).alias("length"), F.max_by("y", "t").alias("last_y")
    )
    last_block = F.floor((F.col("length") - 1) / size).cast("int")
    return per_patient.withColumn("blk", F.explode(F.sequence(F.lit(0), last_block)))


def carried_in(chart: DataFrame, features: list[str], size: int = BLOCK) -> DataFrame:
    """Last observation of each feature before a block starts, for blocks >= 1.

    Only patients longer than one block are read again; the filter on ``t``
    reaches the Parquet scan, so on usual data this side is empty. They are
    found again by (patient, block), so a long patient is spread over tasks.
    """
    longer = chart.filter(F.col("t") >= size).groupBy("pid").agg(F.max(block_of(size=size)).alias("last"))
    wanted = longer.select("pid", F.explode(F.sequence(F.lit(0), "last")).alias("blk"))
    seen = {f: F.when(F.col(f).isNotNull(), F.col("t")) for f in features}
    per_block = (
        chart.withColumn("blk", block_of(size=size))
        .join(wanted, ["pid", "blk"], "left_semi")
        .groupBy("pid", "blk")
        .agg(
            *[F.max_by(f, seen[f]).alias(f"in_{f}") for f in features],
            *[F.max(seen[f]).alias(f"at_{f}") for f in features],
        )
    )
    earlier = Window.partitionBy("pid").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        "pid",
        "blk",
        *[F.last(f"{p}_{f}", ignorenulls=True).over(earlier).alias(f"{p}_{f}")
          for p in ("in", "at") for f in features],
    ).filter("blk >= 1")


def with_last_observed(
    chart: DataFrame, features: list[str], horizon: int | None = None, size: int = BLOCK
) -> DataFrame:
    """Add ``last_<f>`` and ``seen_<f>`` (value and row of the last observation up
    to and including this row). With a horizon also add ``ahead`` (the label
    that many rows later), ``length`` and ``last_y``.

    All windows share one (patient, block) sort; the joined sides are keyed the
    same way and need no further shuffle of the chart.
    """
    upto = block_window().rowsBetween(Window.unboundedPreceding, 0)
    rows = in_blocks(chart, ahead=horizon or 0, size=size)
    columns = {}
    for f in features:
        present = F.col(f).isNotNull()
        columns[f"last_{f}"] = F.last(f, ignorenulls=True).over(upto)
        columns[f"seen_{f}"] = F.last(F.when(present, F.col("t")), ignorenulls=True).over(upto)
    if horizon:
        columns["ahead"] = F.lead("y", horizon).over(block_window())
    rows = own_rows(rows.withColumns(columns), size)
    if horizon:
        rows = rows.join(patient_blocks(chart, size), ["pid", "blk"])
    if features:
        rows = rows.join(carried_in(chart, features, size), ["pid", "blk"], "left")
        rows = rows.withColumns(
            {f"last_{f}": F.coalesce(f"last_{f}", f"in_{f}") for f in features}
            | {f"seen_{f}": F.coalesce(f"seen_{f}", f"at_{f}") for f in features}
        ).drop(*[f"{p}_{f}" for p in ("in", "at") for f in features])
    return rows.drop("blk")
