"""Row-level preparation for classifiers: target, imputation, split, scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bedside.functions.cells import to_number
from bedside.functions.hashing import hash_text
from bedside.operators.ranking import one_row, quota_cut, take_quota


def clean_target(df: DataFrame, target: str, out: str = "y") -> DataFrame:
    """Drop rows whose target is missing or not a number, then make it an integer."""
    number = to_number(F.col(target).cast("string"))
    return df.withColumn(out, number).filter(F.col(out).isNotNull()).withColumn(
        out, F.col(out).cast("int")
    )


def check_trainable(df: DataFrame, label: str = "y", minimum: int = 10) -> None:
    """Refuse data too small to learn from: under ``minimum`` rows or one class."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")
    ).first()
    if row["n"] < minimum or row["low"] == row["high"]:
        raise ValueError(f"cannot train on {row['n']} rows with labels {row['low']} to {row['high']}")


def column_means(df: DataFrame, features: list[str]) -> DataFrame:
    """One row of means; a column without values gets NULL."""
    return df.agg(*[F.avg(f).alias(f) for f in features])


def mean_impute(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL becomes the column mean. Means come from all rows unless ``fit_on``
    (say, the training rows) is given."""
    means = one_row(column_means(df if fit_on is None else fit_on, features))
    filled = df.withColumn("_means", means).withColumns(
        {f: F.coalesce(f, f"_means.{f}") for f in features}
    )
    return filled.drop("_means")


def standard_scale(
    df: DataFrame, features: list[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """z-scores with the population deviation; a constant column is only centred."""
    stats = (df if fit_on is None else fit_on).agg(
        *[F.avg(f).alias(f"mean_{f}") for f in features],
        *[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"std_{f}")
          for f in features],
    )
    scaled = df.withColumn("_s", one_row(stats)).withColumns(
        {f: (F.col(f) - F.col(f"_s.mean_{f}")) / F.col(f"_s.std_{f}") for f in features}
    )
    return scaled.drop("_s")


def stratified_split(
    df: DataFrame, label: str, ids: list[Column], fraction: float = 0.25, seed: str = "42"
) -> DataFrame:
    """Flag ``is_test`` on exactly ``ceil(fraction * n)`` rows of every class,
    the first in hash order. Classes are few; the data is not shuffled."""
    quota = F.ceil(F.col("total") * fraction)
    return take_quota(df, label, hash_text(seed, *ids), quota, "is_test")


def patient_split(chart: DataFrame, fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """(pid, is_validation): whole patients go to one side; 0 disables."""
    return patient_split_rows(chart.select("pid").distinct(), fraction, seed)


def patient_split_rows(chart: DataFrame, fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """The rows of a chart flagged by :func:`patient_split`.

    The border hash alone decides, so every row is judged on its own ``pid``
    and no patient's rows have to meet.
    """
    if not 0 < fraction < 1:
        return chart.withColumn("is_validation", F.lit(False))
    patients = chart.select("pid").distinct().withColumn("_all", F.lit(1))
    order = hash_text(seed, F.col("pid"))
    border = quota_cut(patients, "_all", order, F.ceil(F.col("total") * fraction))
    return chart.withColumn(
        "is_validation", F.coalesce(order <= border.select("cut").scalar(), F.lit(False))
    )


def label_weights(train: DataFrame, label: str = "y") -> DataFrame:
    """Balanced class weights ``n / (2 n_class)`` as one row ``w0, w1``."""
    n, pos = F.count(F.lit(1)), F.sum(label)
    return train.agg((n / (2.0 * (n - pos))).alias("w0"), (n / (2.0 * pos)).alias("w1"))


def scale_pos_weight(train: DataFrame, label: str = "y") -> DataFrame:
    """Negatives over positives, 1 if there are no positives."""
    counted = train.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("negatives"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
    )
    ratio = F.coalesce(F.expr("negatives / nullif(positives, 0)"), F.lit(1.0))
    return counted.withColumn("scale_pos_weight", ratio)
