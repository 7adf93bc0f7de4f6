"""Sequence features of a chart: masks, normalisation, last observation, time
since observation, horizon targets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.hashing import hash_uniform
from bedside.functions.mixture import decay_factor
from bedside.operators.blocks import (
    BLOCK, block_of, block_window, in_blocks, own_rows, patient_blocks, with_last_observed,
)
from bedside.operators.ranking import one_row, ranked_counts


def truncate_sequence(chart: DataFrame, max_len: int | None) -> DataFrame:
    return chart if max_len is None else chart.filter(F.col("t") < max_len)


def limit_patients(chart: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` patients by id. Every task keeps its own first
    ``n`` ids; the largest kept id is compared row by row."""
    last = chart.select("pid").distinct().orderBy("pid").limit(n).agg(F.max("pid").alias("last"))
    return chart.filter(F.col("pid") <= last.scalar())


# --- normalisation -----------------------------------------------------------


def norm_stats(chart: DataFrame, features: list[str], empty_mean: float | None = 0.0) -> DataFrame:
    """(feature, mean, std): one pass of sums, population deviation, variance
    clipped at 0, zero deviation replaced by 1. A feature without values has
    ``empty_mean`` (0, or NULL for the second published form) and deviation 1.
    """
    sums = chart.agg(
        *[F.count(f).alias(f"n_{f}") for f in features],
        *[F.sum(f).alias(f"s_{f}") for f in features],
        *[F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features],
    )
    per_feature = sums.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"),
                           F.col(f"s_{f}").alias("s"), F.col(f"q_{f}").alias("q"))
                  for f in features]
            )
        )
    )
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    std = F.coalesce(F.nullif(F.sqrt(variance), F.lit(0.0)), F.lit(1.0))
    seen = F.col("n") > 0
    return per_feature.select(
        "feature",
        F.when(seen, mean).otherwise(F.lit(empty_mean)).alias("mean"),
        F.when(seen, std).otherwise(1.0).alias("std"),
    )


def stats_row(stats: DataFrame, features: list[str]) -> Column:
    """The per-feature table as one struct ``mean_<f>, std_<f>``."""
    def pick(f: str, part: str) -> Column:
        return F.max(F.when(F.col("feature") == f, F.col(part))).alias(f"{part}_{f}")

    return one_row(stats.agg(*[pick(f, part) for part in ("mean", "std") for f in features]))


def normalise(chart: DataFrame, features: list[str], stats: DataFrame) -> DataFrame:
    """(x - mean) / std; missing stays NULL."""
    return chart.withColumn("_s", stats_row(stats, features)).withColumns(
        {f: (F.col(f) - F.col(f"_s.mean_{f}")) / F.col(f"_s.std_{f}") for f in features}
    ).drop("_s")


def zero_fill(chart: DataFrame, features: list[str]) -> DataFrame:
    return chart.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in features})


# --- windows -----------------------------------------------------------------


def locf(chart: DataFrame, features: list[str], size: int = BLOCK) -> DataFrame:
    """Last observed value up to and including each row, 0 before the first."""
    walked = with_last_observed(chart, features, size=size)
    return walked.select(
        "pid", "t", *[F.coalesce(f"last_{f}", F.lit(0.0)).alias(f) for f in features]
    )


def since_observed(t: Column, seen: Column) -> Column:
    """Rows since the last observation; counts from row 0 if there was none."""
    return (t - F.coalesce(seen, F.lit(0))).cast("double")


def time_since_observed(chart: DataFrame, features: list[str], size: int = BLOCK) -> DataFrame:
    walked = with_last_observed(chart, features, size=size)
    return walked.select(
        "pid", "t", *[since_observed(F.col("t"), F.col(f"seen_{f}")).alias(f) for f in features]
    )


def horizon_target(chart: DataFrame, horizon: int, size: int = BLOCK) -> DataFrame:
    """Label ``horizon`` rows ahead. The last rows take the patient's last label
    and are not valid."""
    if horizon < 1:
        raise ValueError("the horizon is at least 1")
    valid = F.col("t") < F.col("length") - horizon
    walked = with_last_observed(chart, [], horizon, size)
    return walked.withColumns(
        {"valid": valid, "y_target": F.when(valid, F.col("ahead")).otherwise(F.col("last_y"))}
    ).drop("ahead", "last_y")


def next_label(chart: DataFrame, size: int = BLOCK) -> DataFrame:
    """The one-row horizon; the last row repeats its own label."""
    rows = in_blocks(chart, ahead=1, size=size)
    following = F.lead("y", 1).over(block_window())
    return own_rows(rows.withColumn("y_next", F.coalesce(following, F.col("y"))), size).drop("blk")


def sequence_length(chart: DataFrame, size: int = BLOCK) -> DataFrame:
    """The patient's row count on every row, joined per block."""
    return (
        chart.withColumn("blk", block_of(size=size))
        .join(patient_blocks(chart, size).select("pid", "blk", "length"), ["pid", "blk"])
        .drop("blk")
    )


def transition_flag(targets: DataFrame) -> DataFrame:
    """Valid rows that go from label 0 to label 1 at the horizon."""
    return targets.withColumn(
        "transition", (F.col("y") == 0) & (F.col("y_target") == 1) & F.col("valid")
    )


# --- full feature set --------------------------------------------------------


def sequence_features(
    chart: DataFrame,
    features: list[str],
    stats: DataFrame,
    horizon: int = 1,
    max_len: int | None = None,
    label_channel: bool = False,
    size: int = BLOCK,
) -> DataFrame:
    """Per row and feature: ``x_`` normalised value (0 if missing), ``m_`` mask,
    ``d_`` rows since observed, ``l_`` last observed normalised value; with
    ``y_current``, ``y_target``, ``valid`` and ``length``.

    With ``label_channel`` the current label is one more feature that is always
    observed. All windows run in one sort of the chart.
    """
    rows = normalise(truncate_sequence(chart, max_len), features, stats)
    walked = with_last_observed(rows, features, horizon, size)
    valid = F.col("t") < F.col("length") - horizon
    columns = []
    for f in features:
        columns += [
            F.coalesce(f, F.lit(0.0)).alias(f"x_{f}"),
            F.col(f).isNotNull().cast("int").alias(f"m_{f}"),
            since_observed(F.col("t"), F.col(f"seen_{f}")).alias(f"d_{f}"),
            F.coalesce(f"last_{f}", F.lit(0.0)).alias(f"l_{f}"),
        ]
    if label_channel:
        current = F.col("y").cast("double")
        columns += [
            current.alias("x_label"), F.lit(1).alias("m_label"),
            F.lit(0.0).alias("d_label"), current.alias("l_label"),
        ]
    return walked.select(
        "pid", "t", *columns,
        F.col("y").alias("y_current"),
        F.when(valid, F.col("ahead")).otherwise(F.col("last_y")).alias("y_target"),
        valid.alias("valid"),
        "length",
    )


def decay_impute(sequences: DataFrame, gammas: dict[str, float]) -> DataFrame:
    """``m x + (1 - m) exp(-max(gamma, 0) delta) x_last`` per feature."""
    columns = {}
    for f, gamma in gammas.items():
        m = F.col(f"m_{f}")
        fading = decay_factor(F.lit(float(gamma)), F.col(f"d_{f}")) * F.col(f"l_{f}")
        columns[f"z_{f}"] = m * F.col(f"x_{f}") + (1 - m) * fading
    return sequences.withColumns(columns)


def artificial_missingness(
    chart: DataFrame, features: list[str], rate: float, seed: str = "42"
) -> DataFrame:
    """Mask ``m_<f>`` of each feature with observed cells hidden at ``rate``;
    the values are kept."""
    def mask(f: str) -> Column:
        draw = hash_uniform(seed, F.col("pid"), F.col("t"), F.lit(f))
        return F.when(F.col(f).isNotNull() & (draw >= rate), 1).otherwise(0)

    return chart.withColumns({f"m_{f}": mask(f) for f in features})


# --- packing -----------------------------------------------------------------


def pack_sequences(
    sequences: DataFrame, columns: list[str], batch: int = 64, part_rows: int = BLOCK
) -> DataFrame:
    """Per-patient matrices in batches of ``batch`` patients, padded with zero
    rows to the longest patient of the batch, true length kept.

    Batches take patients in id order; inside a batch ``position`` goes by
    falling length. A matrix longer than ``part_rows`` is stored as several
    parts, so no cell holds a whole long patient; parts that would hold nothing
    but padding are not stored, ``padded`` tells their extent. Patients are
    numbered through ranges of ids, not in one sort.
    """
    lengths = sequences.groupBy("pid").agg(F.count(F.lit(1)).alias("length")).withColumn(
        "n", F.lit(1)
    )
    numbered = (
        ranked_counts(lengths, [], "pid", ["n"])
        .withColumn("batch_id", F.floor(F.col("before_n") / batch).cast("int"))
        .drop("n", "before_n")
    )
    in_batch = Window.partitionBy("batch_id")
    falling = in_batch.orderBy(F.desc("length"), "pid")
    placed = numbered.withColumns(
        {
            "position": F.row_number().over(falling) - 1,
            "padded": F.max("length").over(in_batch),
        }
    )
    row = F.array(*[F.col(c).cast("float") for c in columns])
    parts = sequences.groupBy("pid", F.floor(F.col("t") / part_rows).cast("int").alias("part")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("t", row.alias("row")))), lambda s: s["row"]
        ).alias("rows")
    )
    width = F.least(F.col("padded") - F.col("part") * part_rows, F.lit(part_rows)).cast("int")
    zeros = F.array(*[F.lit(0.0).cast("float") for _ in columns])
    return parts.join(placed, "pid").select(
        "batch_id", "position", "pid", "part", "length", "padded",
        F.concat("rows", F.array_repeat(zeros, width - F.size("rows"))).alias("x"),
    )
