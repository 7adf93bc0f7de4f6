"""How often each measurement is recorded: per patient, cohort and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.cells import availability_tier


def unpivot(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(ids, features, "feature", "value")


def unpivot_cells(chart: DataFrame, features: list[str]) -> DataFrame:
    """One record per (row, feature) with a presence flag."""
    return unpivot(chart, ["pid", "t"], features).withColumn(
        "present", F.col("value").isNotNull().cast("int")
    )


def project_features(df: DataFrame, keep: list[str] | None = None, drop: list[str] = ()) -> DataFrame:
    """Keep listed columns that exist, in list order, or drop listed columns."""
    wanted = df.columns if keep is None else [c for c in keep if c in df.columns]
    return df.select(*[c for c in wanted if c not in drop])


def patient_profile(chart: DataFrame, features: list[str]) -> DataFrame:
    """Rows, presence share per feature, any-positive flag and positive rows."""
    rows = F.count(F.lit(1))
    return chart.groupBy("pid").agg(
        rows.alias("rows"),
        *[(F.count(f) / rows).alias(f"freq_{f}") for f in features],
        (F.coalesce(F.max("y"), F.lit(0)) == 1).alias("is_positive"),
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("duration"),
    )


def drop_empty_patients(lengths: DataFrame, minimum: int = 1) -> DataFrame:
    return lengths.filter(F.col("rows") >= minimum)


def _averages(features: list[str]) -> list[Column]:
    return [F.avg(f"freq_{f}").alias(f) for f in features] + [F.count(F.lit(1)).alias("files")]


def cohort_frequency(profile: DataFrame, features: list[str]) -> DataFrame:
    """Macro averages, each patient weighing one, for both cohorts and for all
    patients, in one pass over the profile: (cohort, feature, avg_freq, files)."""
    cohort = F.when(F.col("is_positive"), "positive").otherwise("negative")
    wide = (
        profile.withColumn("cohort", cohort)
        .rollup("cohort")
        .agg(*_averages(features))
        .withColumn("cohort", F.coalesce("cohort", F.lit("all")))
    )
    return wide.unpivot(["cohort", "files"], features, "feature", "avg_freq").select(
        "cohort", "feature", "avg_freq", "files"
    )


def entry_frequency(chart: DataFrame, features: list[str]) -> DataFrame:
    """Micro averages: present rows over rows, per row label. Both labels are
    listed; a label without rows has frequency 0. Rows without a label (too
    short to hold one) are left out."""
    positive = F.col("y") == 1
    totals = chart.filter(F.col("y").isNotNull()).agg(
        *[F.count(F.when(side, F.lit(1))).alias(f"n_{k}")
          for k, side in ((0, ~positive), (1, positive))],
        *[F.count(F.when(side, F.col(f))).alias(f"{f}_{k}")
          for k, side in ((0, ~positive), (1, positive)) for f in features],
    )
    cells = F.array(
        *[F.struct(
            F.lit(k).alias("label"), F.lit(f).alias("feature"),
            F.col(f"{f}_{k}").alias("present"), F.col(f"n_{k}").alias("entries"))
          for k in (0, 1) for f in features]
    )
    return totals.select(F.inline(cells)).withColumn(
        "freq", F.coalesce(F.expr("present / nullif(entries, 0)"), F.lit(0.0))
    )


def label_duration(profile: DataFrame) -> DataFrame:
    """Positive patients, contributors, positive hours, hours per contributor."""
    positive = F.col("is_positive")
    lasting = positive & (F.col("duration") > 0)
    hours = F.coalesce(F.sum(F.when(lasting, F.col("duration"))), F.lit(0))
    return profile.agg(
        F.count(F.when(positive, 1)).alias("positive_patients"),
        F.count(F.when(lasting, 1)).alias("contributors"),
        hours.alias("total_hours"),
    ).withColumn("mean_hours", F.expr("total_hours / nullif(contributors, 0)"))


def _side(condition: str, value: str) -> Column:
    return F.max(F.when(F.expr(condition), F.col(value)))


def cohort_compare(cohorts: DataFrame) -> DataFrame:
    """Features known to both cohorts; difference in percentage points. Both
    sides are picked in one pass instead of joining the table to itself."""
    both = cohorts.groupBy("feature").agg(
        _side("cohort = 'positive'", "avg_freq").alias("pos_freq"),
        _side("cohort = 'negative'", "avg_freq").alias("neg_freq"),
    ).dropna(subset=["pos_freq", "neg_freq"])
    return both.withColumn("difference", (F.col("pos_freq") - F.col("neg_freq")) * 100)


def entry_compare(entries: DataFrame) -> DataFrame:
    """Every analysed feature; a feature absent on one side counts as 0 there."""
    both = entries.groupBy("feature").agg(
        _side("label = 1", "freq").alias("pos_freq"), _side("label = 0", "freq").alias("neg_freq")
    ).fillna(0.0, ["pos_freq", "neg_freq"])
    return both.withColumn("difference", (F.col("pos_freq") - F.col("neg_freq")) * 100)


def with_category(per_feature: DataFrame, categories: DataFrame) -> DataFrame:
    """Label features by category; features in no category leave the report.
    The category table has one row per column of the chart."""
    return per_feature.join(F.broadcast(categories), "feature")


def category_rank(per_feature: DataFrame, percent: str) -> DataFrame:
    """Rank inside each category by percent, ties in list order, with the tier."""
    order = Window.partitionBy("category").orderBy(F.desc(percent), "feature_ord")
    return per_feature.withColumn("rank", F.row_number().over(order)).withColumn(
        "tier", availability_tier(F.col(percent))
    )


def abs_diff_order(compared: DataFrame) -> DataFrame:
    order = Window.partitionBy("category").orderBy(F.desc(F.abs("difference")), "feature_ord")
    return compared.withColumn("rank", F.row_number().over(order))


def availability_summary(per_feature: DataFrame, percent: str) -> DataFrame:
    return per_feature.groupBy(availability_tier(F.col(percent)).alias("tier")).agg(
        F.count(F.lit(1)).alias("features")
    )


def class_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    wide = df.groupBy(*by).agg(*[(F.count(F.lit(1)) - F.count(f)).alias(f) for f in features])
    return wide.unpivot(by, features, "feature", "missing")


def common_features(cohorts: DataFrame) -> DataFrame:
    """Features recorded in both cohorts."""
    known = cohorts.filter(F.col("avg_freq").isNotNull())
    return (
        known.filter("cohort = 'positive'").select("feature")
        .intersect(known.filter("cohort = 'negative'").select("feature"))
    )


def min_sample_guard(chart: DataFrame, features: list[str], bins: int = 5) -> DataFrame:
    """Per feature: present rows, classes and whether it may be scored. Counts per
    class first, so no distinct count has to gather values."""
    per_class = (
        chart.filter(F.col("y").isNotNull())
        .groupBy("y")
        .agg(*[F.count(f).alias(f) for f in features])
        .unpivot(["y"], features, "feature", "n")
    )
    return per_class.groupBy("feature").agg(
        F.sum("n").alias("present"),
        F.count(F.when(F.col("n") > 0, 1)).alias("classes"),
    ).withColumn("status", guard_status(F.col("present"), F.col("classes"), bins))


def guard_status(present: Column, classes: Column, bins: int) -> Column:
    return (
        F.when(present < 2 * bins, "too few rows").when(classes < 2, "one class").otherwise("ok")
    )
