"""Sketches of features, kept per part (a day, a file) and merged for any report, so
that a new part costs one scan of itself alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bedside.operators.frequency import unpivot
from bedside.operators.information import inner_edges

QUANTILE_SIZE = 800  # entries a level of a quantile sketch
DISTINCT_BITS = 12  # a distinct sketch has 2 to this power buckets


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """Bound on the distance of a sketched quantile's rank from the one asked for, as a
    share of all rows: twice the published 99 % fit for KLL, some five deviations."""
    return 2 * 2.296 / size**0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Four standard errors of a distinct count, as a share of it."""
    return 4 * 1.04 / 2 ** (bits / 2)


def sketch_parts(
    chart: DataFrame, features: list[str], part: Column, size: int = QUANTILE_SIZE, bits: int = DISTINCT_BITS
) -> DataFrame:
    """(part, feature, n, low, high, quantiles, distinct) over present finite cells.

    Each task sketches what it reads before anything moves, so a part that holds most
    rows costs no more than another. -0.0 and 0.0 are one value.
    """
    long = unpivot(chart.withColumn("part", part), ["part"], features)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    value = F.when(F.col("value") == 0, 0.0).otherwise(F.col("value").cast("double"))
    cells = long.filter(finite).select("part", "feature", value.alias("value"))
    return cells.groupBy("part", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", F.lit(size)).alias("quantiles"),
        F.hll_sketch_agg(F.xxhash64("value"), F.lit(bits)).alias("distinct"),
    )


def store_parts(sketches: DataFrame, path: str) -> None:
    """Keep the sketches under ``path``; parts that come again replace their earlier
    sketches, other parts stay as they are."""
    (
        sketches.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("part").parquet(path)
    )


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of whole features, or of groups named by ``by``: a row per part is read,
    no cell."""
    return sketches.groupBy(*(by or []), "feature").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def sketched_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, n, prob, value) by merged sketches; the ends are exact."""
    found = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(float(p)) for p in probs]))
    each = sketches.select(
        "feature", "n", "low", "high",
        F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), found.alias("value"))).alias("q"),
    )
    p = F.col("q.prob")
    value = F.when(p <= 0, F.col("low")).when(p >= 1, F.col("high")).otherwise(F.col("q.value"))
    return each.select("feature", "n", p.alias("prob"), value.alias("value"))


def sketched_distinct(sketches: DataFrame) -> DataFrame:
    """(feature, n, distinct_values) by merged sketches."""
    return sketches.select("feature", "n", F.hll_sketch_estimate("distinct").alias("distinct_values"))


def sketched_edges(sketches: DataFrame, bins: int = 5) -> DataFrame:
    """(feature, edges) for :func:`information.with_bin`: quantile borders without a
    pass over the cells. Fewer bins for a feature of fewer distinct values."""
    used = F.greatest(F.lit(2), F.least(F.lit(bins), F.hll_sketch_estimate("distinct")))
    # The sketch takes constant probabilities only: one list for each number of bins.
    lists = [
        F.when(used == k, F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(i / k) for i in range(k + 1)])))
        for k in range(2, bins + 1)
    ]
    return sketches.select("feature", inner_edges(F.coalesce(*lists)).alias("edges"))


def rank_distance(counts: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(feature, prob, error): how far the rank of each sketched value lies from the one
    asked for. ``counts`` holds each (feature, value) with its ``n``; the quantiles are
    a few rows per feature and are broadcast."""
    asked = quantiles.select("feature", "prob", F.col("value").alias("_q"), F.col("n").alias("_n"))
    sums = counts.join(F.broadcast(asked), "feature").groupBy("feature", "prob").agg(
        F.sum(F.when(F.col("value") < F.col("_q"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("_q"), F.col("n")).otherwise(0)).alias("upto"),
        F.max("_n").alias("n"),
    )
    off = F.greatest(F.col("below") / F.col("n") - F.col("prob"), F.col("prob") - F.col("upto") / F.col("n"))
    return sums.select("feature", "prob", F.greatest(off, F.lit(0.0)).alias("error"))
