"""Borders of the bins that tree learners cut features into, and rows told apart by
bins alone: trees cannot see more of a row, so rows alike in all bins and the label
are one row with a weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.operators.frequency import unpivot
from bedside.operators.ranking import ranked_counts
from bedside.session import cut


def tree_borders(train: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Per feature the borders MLlib's trees take from all rows: midpoints of the values
    if there are at most ``bins``, else one near each multiple of an even share. A value
    with more than a share pushes the next borders to the values behind it.

    A border depends on the first value past its share and the value before it, a pushed
    one on fewer than ``bins`` values behind; only those reach the driver, whatever the
    number of values.
    """
    counts = unpivot(train.select(*features), [], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = cut(ranked_counts(counts, ["feature"], "value", ["n"]), "ranked")
    rows = train.count()
    bins = min(bins, rows)
    # How many shares end before the middle of a value's rows.
    past = F.floor((bins * (2 * F.col("before_n") + F.col("n")) - 1) / F.lit(2 * rows)).cast("int")
    ranked = ranked.withColumn("past", past)
    firsts: dict[str, list[float]] = {}
    for r in ranked.groupBy("feature", "past").agg(F.min("value").alias("value")).collect():
        firsts.setdefault(r["feature"], []).append(r["value"])

    def interval() -> Column:
        out = F.lit(0)
        for f, values in firsts.items():
            number = F.size(F.filter(F.array(*[F.lit(v) for v in sorted(values)]), lambda v: v <= F.col("value")))
            out = F.when(F.col("feature") == f, number).otherwise(out)
        return out

    near = ranked.withColumn("part", interval())
    order = Window.partitionBy("feature", "part").orderBy("value")
    heads = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= bins + 1)
    lasts = near.groupBy("feature", "part").agg(F.max("value").alias("last"))
    ends = {(r["feature"], r["part"]): r["last"] for r in lasts.collect()}
    met: dict[str, list] = {}
    for r in heads.collect():
        met.setdefault(r["feature"], []).append(r)
    return [_borders(sorted(met[f], key=lambda r: r["value"]), f, ends, bins) for f in features]


def _borders(met: list, feature: str, ends: dict, bins: int) -> list[float]:
    borders, share = [], 1
    few = len(met) <= bins and max(r["place"] for r in met) <= bins
    for earlier, r in zip(met, met[1:]):
        before = earlier["value"] if r["place"] > 1 else ends[feature, earlier["part"]]
        if few or r["past"] >= share:
            borders.append((before + r["value"]) / 2.0)
            share += 1
    return borders


def with_bins(df: DataFrame, features: list[str], borders: list[list[float]]) -> DataFrame:
    """Each feature as the number of its borders below it; a border itself lies left."""
    def number(f: str, cuts: list[float]) -> Column:
        if not cuts:
            return F.col(f) * 0.0
        # The first border that is not below the value, found by halving.
        def halved(low: int, high: int) -> Column:
            if low == high:
                return F.lit(float(low))
            middle = (low + high) // 2
            return F.when(F.col(f) <= cuts[middle], halved(low, middle)).otherwise(halved(middle + 1, high))

        return F.when(F.col(f).isNotNull(), halved(0, len(cuts)))

    return df.withColumns({f: number(f, cuts) for f, cuts in zip(features, borders)})


def weighted_cells(train: DataFrame, features: list[str], borders: list[list[float]], label: str = "y") -> DataFrame:
    """(features as bins, label, ``weight``): one row for all rows alike, written, since
    a learner scans them many times."""
    cells = with_bins(train.select(*features, label), features, borders)
    return cut(cells.groupBy(*features, label).agg(F.count(F.lit(1)).cast("double").alias("weight")), "cells")
