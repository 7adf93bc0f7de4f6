"""Mutual information of each feature with the outcome, on the rows where the
feature is present. Everything after the first step works on counts of equal
values, so repeated values cost nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.operators.frequency import guard_status, unpivot
from bedside.operators.ranking import exact_quantiles
from bedside.session import cut


def value_counts(chart: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, y, n) over present cells, combined before the shuffle."""
    long = unpivot(chart.filter(F.col("y").isNotNull()), ["y"], features)
    present = long.filter(F.col("value").isNotNull())
    return present.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(chart: DataFrame, features: list[str]) -> DataFrame:
    """Distinct values and distinct classes per feature."""
    counted = value_counts(chart, features)
    values = counted.select("feature", "value").distinct().groupBy("feature").agg(
        F.count(F.lit(1)).alias("distinct_values")
    )
    classes = counted.select("feature", "y").distinct().groupBy("feature").agg(
        F.count(F.lit(1)).alias("classes")
    )
    return all_features(values.join(F.broadcast(classes), "feature"), features)


def all_features(per_feature: DataFrame, features: list[str]) -> DataFrame:
    """One row per listed feature, counts 0 for a feature that never occurs."""
    names = per_feature.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(F.broadcast(per_feature), "feature", "left").fillna(0)


def inner_edges(edges: Column) -> Column:
    """Bin borders without the outer two; an edge within 1e-8 of the one before
    it is merged into it."""
    kept = F.filter(
        edges, lambda e, i: (i == 0) | (e - F.get(edges, F.greatest(i - 1, F.lit(0))) > 1e-8)
    )
    return F.slice(kept, 2, F.greatest(F.size(kept) - 2, F.lit(0)))


def quantile_edges(counts: DataFrame, bins: int = 5) -> DataFrame:
    """(feature, edges): inner borders of up to ``bins`` quantile bins, fewer when
    a feature has fewer distinct values."""
    per_value = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    used = F.greatest(F.lit(2), F.least(F.lit(bins), F.col("distinct")))
    probs = [F.least(F.lit(float(i)) / used, F.lit(1.0)) for i in range(bins + 1)]
    found = exact_quantiles(per_value, ["feature"], "value", probs)
    return found.select("feature", inner_edges(F.col("quantiles")).alias("edges"))


def uniform_edges(counts: DataFrame, bins: int = 5) -> DataFrame:
    """(feature, edges): inner borders of up to ``bins`` bins of equal width, fewer when
    a feature has fewer distinct values and none when it has one."""
    spans = counts.groupBy("feature", "value").agg(F.sum("n").alias("n")).groupBy("feature").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("distinct")
    )
    used = F.greatest(F.lit(2), F.least(F.lit(bins), F.col("distinct"))).cast("int")
    width = (F.col("high") - F.col("low")) / used
    borders = F.transform(F.sequence(F.lit(1), used - 1), lambda i: F.col("low") + width * i)
    none = F.array().cast("array<double>")
    return spans.select("feature", F.when(F.col("distinct") > 1, borders).otherwise(none).alias("edges"))


EDGES = {"quantile": quantile_edges, "uniform": uniform_edges}


def with_bin(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of inner edges not above the value. One edge row per feature."""
    joined = df.join(F.broadcast(edges), "feature")
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return joined.withColumn("bin", bin_).drop("edges")


def quantile_bin(chart: DataFrame, features: list[str], bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """(pid, t, feature, value, bin) over present cells; ``strategy`` is a key of ``EDGES``."""
    edges = EDGES[strategy](cut(value_counts(chart, features), "values"), bins)
    long = unpivot(chart, ["pid", "t"], features).filter(F.col("value").isNotNull())
    return with_bin(long, edges)


def mutual_information(chart: DataFrame, features: list[str], bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """(feature, mi, status), in nats. 0 for a feature with one value, NULL if it
    has fewer than ``2 * bins`` present rows or one class."""
    counts = cut(value_counts(chart, features), "values")
    table = (
        with_bin(counts, EDGES[strategy](counts, bins))
        .groupBy("feature", "bin", "y")
        .agg(F.sum("n").alias("n"))
    )
    # At most bins x classes rows per feature from here on.
    whole = Window.partitionBy("feature")
    joint = table.withColumns(
        {
            "total": F.sum("n").over(whole),
            "n_bin": F.sum("n").over(Window.partitionBy("feature", "bin")),
            "n_y": F.sum("n").over(Window.partitionBy("feature", "y")),
        }
    )
    share = F.col("n") / F.col("total")
    ratio = F.col("n").cast("double") * F.col("total") / (F.col("n_bin").cast("double") * F.col("n_y"))
    scored = joint.groupBy("feature").agg(
        F.greatest(F.sum(share * F.ln(ratio)), F.lit(0.0)).alias("score"),
        F.sum("n").alias("present"),
        F.size(F.collect_set("y")).alias("classes"),
    )
    status = guard_status(F.col("present"), F.col("classes"), bins)
    return all_features(scored, features).select(
        "feature", F.when(status == "ok", F.col("score")).alias("mi"), status.alias("status")
    )


def mi_order(scores: DataFrame) -> DataFrame:
    """Best first, missing scores last; one row per feature."""
    order = Window.orderBy(F.desc_nulls_last("mi"), "feature")
    return scores.withColumn("rank", F.row_number().over(order))
