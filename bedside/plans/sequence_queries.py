"""Sequence preparation: splits, statistics, windows, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.functions import mixture as mx
from bedside.operators import sequence as sq
from bedside.operators import tabular as tb
from bedside.operators.blocks import with_last_observed
from bedside.plans import inputs, sql
from bedside.plans.registry import q6, query, r6
from bedside.plans.sql import uniform, with_items, with_stay
from bedside.session import stored

FEATURES = inputs.STAY_FEATURES
GAMMAS = {"click": 0.05, "engage": 0.1, "signup": -0.2, "anyv": 0.0, "refund": 0.3}
HORIZON = 6


def stats_sql(source: str, features, empty: str = "0.0") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, CASE WHEN count({f}) = 0 THEN {empty} ELSE avg({f}) END AS mean,
        coalesce(nullif(sqrt(greatest(0.0, sum({f} * {f}) / nullif(count({f}), 0)
          - pow(sum({f}) / nullif(count({f}), 0), 2))), 0), 1.0) AS std FROM {source}"""
        for f in features
    )


SPLIT = """pats AS (SELECT DISTINCT pid FROM stay),
sides AS (
  SELECT pid, row_number() OVER (ORDER BY md5(pid || '|42')) <= ceil(0.2 * count(*) OVER ()) AS is_validation
  FROM pats)"""

STATS = f"""{SPLIT}, train AS (SELECT s.* FROM stay s JOIN sides USING (pid) WHERE NOT is_validation),
stats AS ({stats_sql("train", FEATURES)})"""

NORMED = f"""{STATS}, z AS (
  SELECT pid, t, y, {", ".join(
      f"({f} - (SELECT mean FROM stats WHERE feature = '{f}')) / (SELECT std FROM stats WHERE feature = '{f}') AS {f}"
      for f in FEATURES)}
  FROM stay)"""

FRAME = "OVER (PARTITION BY pid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def sequence_sql(horizon: int) -> str:
    per_feature = ",\n         ".join(
        f"coalesce({f}, 0.0) AS x_{f}, CAST({f} IS NOT NULL AS INTEGER) AS m_{f}, "
        f"CAST(t - coalesce(max(CASE WHEN {f} IS NOT NULL THEN t END) {FRAME}, 0) AS DOUBLE) AS d_{f}, "
        f"coalesce(last_value({f} IGNORE NULLS) {FRAME}, 0.0) AS l_{f}"
        for f in FEATURES
    )
    return f"""{NORMED}, seq AS (
  SELECT pid, t, {per_feature},
         y AS y_current,
         CASE WHEN t < count(*) OVER (PARTITION BY pid) - {horizon} THEN lead(y, {horizon}) OVER (PARTITION BY pid ORDER BY t)
              ELSE last_value(y) OVER (PARTITION BY pid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
         END AS y_target,
         t < count(*) OVER (PARTITION BY pid) - {horizon} AS valid,
         count(*) OVER (PARTITION BY pid) AS length
  FROM z)"""


TARGETS = f"""tg AS (
  SELECT *, count(*) OVER (PARTITION BY pid) AS length,
         t < count(*) OVER (PARTITION BY pid) - {HORIZON} AS valid,
         CASE WHEN t < count(*) OVER (PARTITION BY pid) - {HORIZON} THEN lead(y, {HORIZON}) OVER (PARTITION BY pid ORDER BY t)
              ELSE last_value(y) OVER (PARTITION BY pid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
         END AS y_target
  FROM stay)"""


def training_stats(spark, sf_dir):
    """Statistics of the training patients only, computed once and kept for later
    jobs: one row per feature."""
    def build():
        rows = tb.patient_split_rows(inputs.stay(spark, sf_dir), 0.2).filter("NOT is_validation")
        return sq.norm_stats(rows, FEATURES).coalesce(1)

    return stored(spark, f"stats:{sf_dir}", build)


def sequences(spark, sf_dir, horizon=HORIZON, **options):
    chart = inputs.stay(spark, sf_dir)
    return sq.sequence_features(chart, FEATURES, training_stats(spark, sf_dir), horizon, **options)


@query("patient_split", with_stay(f"{SPLIT} SELECT pid, CAST(is_validation AS INTEGER) AS is_validation FROM sides"))
def patient_split(spark, sf_dir):
    sides = tb.patient_split(inputs.stay(spark, sf_dir), 0.2)
    return sides.select("pid", F.col("is_validation").cast("int").alias("is_validation"))


@query("truncate_sequence", with_stay(f"SELECT pid, t, {q6('anyv')} AS anyv, y FROM stay WHERE t < 24"))
def truncate_sequence(spark, sf_dir):
    return sq.truncate_sequence(inputs.stay(spark, sf_dir), 24).select("pid", "t", r6("anyv"), "y")


@query("limit_patients", with_stay(f"""SELECT pid, t, {q6('anyv')} AS anyv, y FROM stay
WHERE pid IN (SELECT DISTINCT pid FROM stay ORDER BY pid LIMIT 10)"""))
def limit_patients(spark, sf_dir):
    return sq.limit_patients(inputs.stay(spark, sf_dir), 10).select("pid", "t", r6("anyv"), "y")


@query("norm_stats_running", with_stay(f"""stats AS ({stats_sql("stay", FEATURES)})
SELECT feature, {q6('mean')} AS mean, {q6('std')} AS std FROM stats"""))
def norm_stats_running(spark, sf_dir):
    return sq.norm_stats(inputs.stay(spark, sf_dir), FEATURES).select("feature", r6("mean"), r6("std"))


@query("norm_stats_nan", with_stay(f"""cells AS ({sql.long_form()})
SELECT feature, {q6('avg(value)')} AS mean, {q6('coalesce(nullif(stddev_pop(value), 0), 1.0)')} AS std
FROM cells GROUP BY feature"""))
def norm_stats_nan(spark, sf_dir):
    stats = sq.norm_stats(inputs.stay(spark, sf_dir), FEATURES, empty_mean=None)
    return stats.select("feature", r6("mean"), r6("std"))


@query("broadcast_normalise", with_stay(f"""{NORMED}
SELECT pid, t, {", ".join(f"{q6(f'coalesce({f}, 0.0)')} AS {f}" for f in FEATURES)} FROM z"""))
def broadcast_normalise(spark, sf_dir):
    normed = sq.normalise(inputs.stay(spark, sf_dir), FEATURES, training_stats(spark, sf_dir))
    return sq.zero_fill(normed, FEATURES).select("pid", "t", *[r6(f) for f in FEATURES])


@query("locf", with_stay(f"""{NORMED}
SELECT pid, t, {", ".join(f"{q6(f'coalesce(last_value({f} IGNORE NULLS) {FRAME}, 0.0)')} AS {f}" for f in FEATURES)}
FROM z"""))
def locf(spark, sf_dir):
    normed = sq.normalise(inputs.stay(spark, sf_dir), FEATURES, training_stats(spark, sf_dir))
    return sq.locf(normed, FEATURES).select("pid", "t", *[r6(f) for f in FEATURES])


@query("time_since_observed", with_stay(f"""SELECT pid, t, {", ".join(
    f"CAST(t - coalesce(max(CASE WHEN {f} IS NOT NULL THEN t END) {FRAME}, 0) AS DOUBLE) AS {f}" for f in FEATURES)}
FROM stay"""))
def time_since_observed(spark, sf_dir):
    return sq.time_since_observed(inputs.stay(spark, sf_dir), FEATURES)


ITEM_GAPS = ["disc", "tax", "qf"]


@query("locf_items", with_items(f"""SELECT pid, t, {", ".join(
    f"coalesce(last_value({f} IGNORE NULLS) {FRAME}, 0.0) AS {f}, "
    f"CAST(t - coalesce(max(CASE WHEN {f} IS NOT NULL THEN t END) {FRAME}, 0) AS DOUBLE) AS since_{f}"
    for f in ITEM_GAPS)} FROM items"""))
def locf_items(spark, sf_dir):
    """Last value and gap of three sparse columns over all line items."""
    walked = with_last_observed(inputs.items(spark, sf_dir, ITEM_GAPS), ITEM_GAPS)
    return walked.select(
        "pid", "t",
        *[F.coalesce(f"last_{f}", F.lit(0.0)).alias(f) for f in ITEM_GAPS],
        *[sq.since_observed(F.col("t"), F.col(f"seen_{f}")).alias(f"since_{f}") for f in ITEM_GAPS],
    )


@query("horizon_target", with_stay(f"""{TARGETS}
SELECT pid, t, y, CAST(y_target AS INTEGER) AS y_target, CAST(valid AS INTEGER) AS valid, CAST(length AS INTEGER) AS length FROM tg"""))
def horizon_target(spark, sf_dir):
    found = sq.horizon_target(inputs.stay(spark, sf_dir), HORIZON)
    return found.select("pid", "t", "y", "y_target", F.col("valid").cast("int").alias("valid"), "length")


@query("next_label", with_stay("""SELECT pid, t, y,
  CAST(coalesce(lead(y) OVER (PARTITION BY pid ORDER BY t), y) AS INTEGER) AS y_next FROM stay"""))
def next_label(spark, sf_dir):
    return sq.next_label(inputs.stay(spark, sf_dir)).select("pid", "t", "y", "y_next")


@query("transition_flag", with_stay(f"""{TARGETS}
SELECT pid, t, CAST(y = 0 AND y_target = 1 AND valid AS INTEGER) AS transition FROM tg"""))
def transition_flag(spark, sf_dir):
    flagged = sq.transition_flag(sq.horizon_target(inputs.stay(spark, sf_dir), HORIZON))
    return flagged.select("pid", "t", F.col("transition").cast("int").alias("transition"))


@query("sequence_length", with_stay("SELECT pid, t, CAST(count(*) OVER (PARTITION BY pid) AS INTEGER) AS length FROM stay"))
def sequence_length(spark, sf_dir):
    return sq.sequence_length(inputs.stay(spark, sf_dir)).select("pid", "t", "length")


@query("sequence_features", with_stay(f"""{sequence_sql(HORIZON)}
SELECT pid, t, {", ".join(f"{q6(f'x_{f}')} AS x_{f}, m_{f}, d_{f}, {q6(f'l_{f}')} AS l_{f}" for f in FEATURES)},
       y_current, CAST(y_target AS INTEGER) AS y_target, CAST(valid AS INTEGER) AS valid, CAST(length AS INTEGER) AS length
FROM seq"""))
def sequence_features(spark, sf_dir):
    found = sequences(spark, sf_dir)
    parts = [c for f in FEATURES for c in (r6(f"x_{f}"), f"m_{f}", f"d_{f}", r6(f"l_{f}"))]
    return found.select(
        "pid", "t", *parts, "y_current", "y_target", F.col("valid").cast("int").alias("valid"), "length"
    )


@query("label_channel", with_stay(f"""{NORMED}
SELECT pid, t, {", ".join(f"{q6(f'coalesce({f}, 0.0)')} AS x_{f}" for f in FEATURES)}, CAST(y AS DOUBLE) AS x_label, 1 AS m_label,
       CAST(0 AS DOUBLE) AS d_label, CAST(y AS DOUBLE) AS l_label FROM z"""))
def label_channel(spark, sf_dir):
    found = sequences(spark, sf_dir, 1, label_channel=True)
    return found.select("pid", "t", *[r6(f"x_{f}") for f in FEATURES], "x_label", "m_label", "d_label", "l_label")


@query("decay_factor", with_stay(f"""SELECT pid, t, {", ".join(
    f"{q6(f'exp(-greatest({float(g)}, 0.0) * (t % 24))')} AS {f}" for f, g in GAMMAS.items())} FROM stay"""))
def decay_factor(spark, sf_dir):
    delta = (F.col("t") % 24).cast("double")
    return inputs.stay(spark, sf_dir).select(
        "pid", "t", *[r6(mx.decay_factor(F.lit(float(g)), delta), f) for f, g in GAMMAS.items()]
    )


@query("decay_impute", with_stay(f"""{sequence_sql(HORIZON)}
SELECT pid, t, {", ".join(
    f"{q6(f'm_{f} * x_{f} + (1 - m_{f}) * exp(-greatest({float(g)}, 0.0) * d_{f}) * l_{f}')} AS z_{f}"
    for f, g in GAMMAS.items())} FROM seq"""))
def decay_impute(spark, sf_dir):
    filled = sq.decay_impute(sequences(spark, sf_dir), GAMMAS)
    return filled.select("pid", "t", *[r6(f"z_{f}") for f in FEATURES])


@query("artificial_missingness", with_stay(f"""SELECT pid, t, {", ".join(
    f"{q6(f)} AS {f}, CAST({f} IS NOT NULL AND "
    + uniform(f"pid || '|' || t || '|{f}|42'") + f" >= 0.3 AS INTEGER) AS m_{f}" for f in FEATURES)} FROM stay"""))
def artificial_missingness(spark, sf_dir):
    hidden = sq.artificial_missingness(inputs.stay(spark, sf_dir), FEATURES, 0.3)
    return hidden.select("pid", "t", *[r6(f) for f in FEATURES], *[f"m_{f}" for f in FEATURES])


PACKED = [f"x_{f}" for f in FEATURES]


@query("pack_sequences", with_stay(f"""{sequence_sql(1)}, p AS (
  SELECT pid, count(*) AS length,
         list([{", ".join(f"CAST(round({c}, 6) AS FLOAT)" for c in PACKED)}] ORDER BY t) AS rows
  FROM seq GROUP BY pid),
b AS (SELECT *, (row_number() OVER (ORDER BY pid) - 1) // 16 AS batch_id FROM p),
q AS (SELECT *, max(length) OVER (PARTITION BY batch_id) AS padded,
             row_number() OVER (PARTITION BY batch_id ORDER BY length DESC, pid) - 1 AS position FROM b)
SELECT CAST(batch_id AS INTEGER) AS batch_id, CAST(position AS INTEGER) AS position, pid, CAST(0 AS INTEGER) AS part,
       CAST(length AS BIGINT) AS length, CAST(padded AS BIGINT) AS padded,
       list_concat(rows, list_transform(range(padded - length),
         lambda i: [{', '.join(['CAST(0 AS FLOAT)'] * len(PACKED))}])) AS x
FROM q"""))
def pack_sequences(spark, sf_dir):
    rounded = sequences(spark, sf_dir, 1).select("pid", "t", *[r6(c) for c in PACKED])
    return sq.pack_sequences(rounded, PACKED, batch=16)
