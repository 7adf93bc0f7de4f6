"""Recording frequency, cohorts, labels and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.functions import cells
from bedside.operators import frequency as fq
from bedside.operators import tabular as tb
from bedside.plans import inputs, sql
from bedside.plans.registry import q6, query, r6
from bedside.plans.sql import with_items, with_stay

FEATURES = inputs.STAY_FEATURES

PROFILE = f"""profile AS (
  SELECT pid, count(*) AS n, {", ".join(f"count({f}) / CAST(count(*) AS DOUBLE) AS {f}" for f in FEATURES)},
         max(y) = 1 AS is_positive, sum(y) AS duration
  FROM stay GROUP BY pid)"""

COHORT = f"""long AS ({sql.long_form("profile", extra="pid, is_positive")}),
cohort AS (
  SELECT 'all' AS cohort, feature, avg(value) AS f, count(*) AS files FROM long GROUP BY feature
  UNION ALL
  SELECT CASE WHEN is_positive THEN 'positive' ELSE 'negative' END, feature, avg(value), count(*)
  FROM long GROUP BY 1, 2)"""

ENTRY = f"""cells AS ({sql.long_form()}),
entry AS (
  SELECT CASE WHEN y = 1 THEN 1 ELSE 0 END AS label, feature, count(value) AS present,
         count(*) AS entries, count(value) / CAST(count(*) AS DOUBLE) AS freq
  FROM cells GROUP BY 1, 2)"""

RAW = """raw AS (
  SELECT pid, t,
         CASE WHEN click IS NOT NULL THEN CAST(CAST(floor(click) AS INTEGER) AS VARCHAR)
              WHEN t % 5 = 0 THEN 'NaN' WHEN t % 5 = 1 THEN '' WHEN t % 5 = 2 THEN '  '
              WHEN t % 5 = 3 THEN ' nan' END AS cell,
         CASE WHEN t % 7 = 0 THEN '1.0' WHEN t % 7 = 1 THEN NULL WHEN t % 7 = 2 THEN 'x'
              ELSE CAST(y AS VARCHAR) END AS label_text
  FROM stay)"""


def raw_cells(spark, sf_dir):
    """Text cells in every form a patient file may hold."""
    number = F.floor("click").cast("int").cast("string")
    chart = inputs.stay(spark, sf_dir)
    step = F.col("t") % 5
    odd = F.col("t") % 7
    return chart.select(
        "pid", "t",
        F.when(F.col("click").isNotNull(), number).when(step == 0, "NaN").when(step == 1, "")
        .when(step == 2, "  ").when(step == 3, " nan").alias("cell"),
        F.when(odd == 0, "1.0").when(odd == 1, F.lit(None)).when(odd == 2, "x")
        .otherwise(F.col("y").cast("string")).alias("label_text"),
    )


def profile(spark, sf_dir):
    return fq.patient_profile(inputs.stay(spark, sf_dir), FEATURES)


def cohorts(spark, sf_dir):
    return fq.cohort_frequency(profile(spark, sf_dir), FEATURES)


# --- cells, filters and projections -----------------------------------------


@query("cell_present", with_stay(f"""{RAW}
SELECT pid, t, CAST(cell IS NOT NULL AND lower(cell) <> 'nan' AND trim(cell) <> '' AS INTEGER) AS present
FROM raw"""))
def cell_present(spark, sf_dir):
    present = F.coalesce(cells.cell_present(F.col("cell")), F.lit(False))
    return raw_cells(spark, sf_dir).select("pid", "t", present.cast("int").alias("present"))


@query("to_number", with_stay(f"""{RAW}
SELECT pid, t, CASE WHEN isnan(v) THEN NULL ELSE v END AS number
FROM (SELECT pid, t, try_cast(cell AS DOUBLE) v FROM raw)"""))
def to_number(spark, sf_dir):
    return raw_cells(spark, sf_dir).select("pid", "t", cells.to_number(F.col("cell")).alias("number"))


@query("label_is_one", with_stay(f"""{RAW}
SELECT pid, t, CAST(coalesce(label_text = '1', false) AS INTEGER) AS positive FROM raw"""))
def label_is_one(spark, sf_dir):
    positive = cells.label_is_one(F.col("label_text")).cast("int")
    return raw_cells(spark, sf_dir).select("pid", "t", positive.alias("positive"))


@query("clean_target", with_stay(f"""{RAW}
SELECT pid, t, CAST(trunc(v) AS INTEGER) AS target
FROM (SELECT pid, t, try_cast(label_text AS DOUBLE) v FROM raw) WHERE v IS NOT NULL AND NOT isnan(v)"""))
def clean_target(spark, sf_dir):
    return tb.clean_target(raw_cells(spark, sf_dir), "label_text", "target").select("pid", "t", "target")


@query("split_line", with_stay(f"""{RAW}, lines AS (
  SELECT pid, t, coalesce(cell, '') || '|' || coalesce(label_text, '') || '| ' AS line FROM raw),
parts AS (SELECT pid, t, string_split(trim(line), '|') AS p FROM lines)
SELECT pid, t, CAST(len(p) AS INTEGER) AS fields, p[1] AS f0, p[2] AS f1, p[3] AS f2 FROM parts"""))
def split_line(spark, sf_dir):
    line = F.concat(
        F.coalesce("cell", F.lit("")), F.lit("|"), F.coalesce("label_text", F.lit("")), F.lit("| ")
    )
    parts = cells.split_line(line)
    return raw_cells(spark, sf_dir).select(
        "pid", "t", F.size(parts).alias("fields"), *[F.get(parts, F.lit(i)).alias(f"f{i}") for i in range(3)]
    )


@query("project_features", with_stay(f"SELECT pid, t, {q6('anyv')} AS anyv, {q6('click')} AS click FROM stay"))
def project_features(spark, sf_dir):
    kept = fq.project_features(
        inputs.stay(spark, sf_dir), ["pid", "t", "anyv", "heart", "click", "signup"], ["signup"]
    )
    return kept.select("pid", "t", r6("anyv"), r6("click"))


@query("unpivot_cells", with_stay(f"""cells AS ({sql.long_form()})
SELECT pid, t, feature, {q6('value')} AS value, CAST(value IS NOT NULL AS INTEGER) AS present FROM cells"""))
def unpivot_cells(spark, sf_dir):
    long = fq.unpivot_cells(inputs.stay(spark, sf_dir), FEATURES)
    return long.select("pid", "t", "feature", r6("value"), "present")


@query("min_sample_guard", with_stay(f"""cells AS ({sql.long_form()}), g AS (
  SELECT feature, count(value) AS present,
         count(DISTINCT CASE WHEN value IS NOT NULL THEN y END) AS classes FROM cells GROUP BY feature)
SELECT feature, CAST(present AS BIGINT) AS present, CAST(classes AS BIGINT) AS classes,
       CASE WHEN present < 10 THEN 'too few rows' WHEN classes < 2 THEN 'one class' ELSE 'ok' END AS status
FROM g"""))
def min_sample_guard(spark, sf_dir):
    return fq.min_sample_guard(inputs.stay(spark, sf_dir), FEATURES)


@query("drop_empty_patients", with_stay("""n AS (SELECT pid, count(*) AS rows FROM stay WHERE signup IS NOT NULL GROUP BY pid)
SELECT pid, CAST(rows AS BIGINT) AS rows FROM n WHERE rows >= 2"""))
def drop_empty_patients(spark, sf_dir):
    seen = inputs.stay(spark, sf_dir).filter("signup IS NOT NULL")
    return fq.drop_empty_patients(seen.groupBy("pid").agg(F.count(F.lit(1)).alias("rows")), 2)


@query("availability_tier", with_stay("""SELECT pid, t, CASE WHEN anyv >= 80 THEN 'High' WHEN anyv >= 40 THEN 'Medium'
  WHEN anyv > 0 THEN 'Low' ELSE 'None' END AS tier FROM stay"""))
def availability_tier(spark, sf_dir):
    return inputs.stay(spark, sf_dir).select("pid", "t", cells.availability_tier(F.col("anyv")).alias("tier"))


# --- per patient, per cohort, per label -------------------------------------


@query("patient_profile", with_stay(f"""{PROFILE}
SELECT pid, CAST(n AS BIGINT) AS rows, {", ".join(f"{q6(f)} AS freq_{f}" for f in FEATURES)},
       CAST(is_positive AS INTEGER) AS is_positive, CAST(duration AS BIGINT) AS duration FROM profile"""))
def patient_profile(spark, sf_dir):
    return profile(spark, sf_dir).select(
        "pid", "rows", *[r6(f"freq_{f}") for f in FEATURES],
        F.col("is_positive").cast("int").alias("is_positive"), "duration",
    )


ITEM_FEATURES = ["qty", "price", "disc", "tax", "qf"]


@query("patient_profile_items", with_items(f"""profile AS (
  SELECT pid, CAST(count(*) AS BIGINT) AS rows,
         {", ".join(f"{q6(f'count({f}) / CAST(count(*) AS DOUBLE)')} AS freq_{f}" for f in ITEM_FEATURES)},
         CAST(max(y) AS INTEGER) AS is_positive, CAST(sum(y) AS BIGINT) AS duration
  FROM items GROUP BY pid) SELECT * FROM profile"""))
def patient_profile_items(spark, sf_dir):
    found = fq.patient_profile(inputs.items(spark, sf_dir), ITEM_FEATURES)
    return found.select(
        "pid", "rows", *[r6(f"freq_{f}") for f in ITEM_FEATURES],
        F.col("is_positive").cast("int").alias("is_positive"), "duration",
    )


@query("cohort_frequency_all", with_stay(f"""{PROFILE}, {COHORT}
SELECT feature, {q6('f')} AS avg_freq, CAST(files AS BIGINT) AS files FROM cohort WHERE cohort = 'all'"""))
def cohort_frequency_all(spark, sf_dir):
    return cohorts(spark, sf_dir).filter("cohort = 'all'").select("feature", r6("avg_freq"), "files")


@query("cohort_frequency_split", with_stay(f"""{PROFILE}, {COHORT}
SELECT cohort, feature, {q6('f')} AS avg_freq, CAST(files AS BIGINT) AS files FROM cohort"""))
def cohort_frequency_split(spark, sf_dir):
    return cohorts(spark, sf_dir).select("cohort", "feature", r6("avg_freq"), "files")


@query("entry_frequency", with_stay(f"""{ENTRY}
SELECT CAST(label AS INTEGER) AS label, feature, CAST(present AS BIGINT) AS present,
       CAST(entries AS BIGINT) AS entries, {q6('freq')} AS freq FROM entry"""))
def entry_frequency(spark, sf_dir):
    found = fq.entry_frequency(inputs.stay(spark, sf_dir), FEATURES)
    return found.select("label", "feature", "present", "entries", r6("freq"))


@query("label_duration", with_stay(f"""{PROFILE}
SELECT CAST(count(*) FILTER (is_positive) AS BIGINT) AS positive_patients,
       CAST(count(*) FILTER (is_positive AND duration > 0) AS BIGINT) AS contributors,
       CAST(sum(duration) FILTER (is_positive) AS BIGINT) AS total_hours,
       {q6('avg(duration) FILTER (is_positive AND duration > 0)')} AS mean_hours FROM profile"""))
def label_duration(spark, sf_dir):
    return fq.label_duration(profile(spark, sf_dir)).select(
        "positive_patients", "contributors", "total_hours", r6("mean_hours")
    )


@query("availability_summary", with_stay(f"""{PROFILE}, {COHORT}, tiers AS (
  SELECT CASE WHEN f * 100 >= 80 THEN 'High' WHEN f * 100 >= 40 THEN 'Medium'
              WHEN f > 0 THEN 'Low' ELSE 'None' END AS tier FROM cohort WHERE cohort = 'all')
SELECT tier, CAST(count(*) AS BIGINT) AS features FROM tiers GROUP BY tier"""))
def availability_summary(spark, sf_dir):
    every = cohorts(spark, sf_dir).filter("cohort = 'all'")
    return fq.availability_summary(every.withColumn("percent", F.col("avg_freq") * 100), "percent")


@query("missing_counts", with_stay(f"""cells AS ({sql.long_form()})
SELECT y, feature, CAST(count(*) - count(value) AS BIGINT) AS missing FROM cells GROUP BY y, feature"""))
def missing_counts(spark, sf_dir):
    return fq.missing_counts(inputs.stay(spark, sf_dir), FEATURES, ["y"])


# --- comparisons and reports -------------------------------------------------

COMPARED = f"""cmp AS (
  SELECT p.feature, p.f AS pos_freq, n.f AS neg_freq, (p.f - n.f) * 100 AS difference
  FROM cohort p JOIN cohort n ON p.feature = n.feature AND p.cohort = 'positive' AND n.cohort = 'negative')"""


@query("cohort_compare", with_stay(f"""{PROFILE}, {COHORT}, {COMPARED}
SELECT feature, {q6('pos_freq')} AS pos_freq, {q6('neg_freq')} AS neg_freq, {q6('difference')} AS difference FROM cmp"""))
def cohort_compare(spark, sf_dir):
    return fq.cohort_compare(cohorts(spark, sf_dir)).select(
        "feature", r6("pos_freq"), r6("neg_freq"), r6("difference")
    )


@query("entry_compare", with_stay(f"""{ENTRY}
SELECT coalesce(a.feature, b.feature) AS feature, {q6('coalesce(a.freq, 0)')} AS pos_freq,
       {q6('coalesce(b.freq, 0)')} AS neg_freq,
       {q6('(coalesce(a.freq, 0) - coalesce(b.freq, 0)) * 100')} AS difference
FROM (SELECT * FROM entry WHERE label = 1) a FULL JOIN (SELECT * FROM entry WHERE label = 0) b
  ON a.feature = b.feature"""))
def entry_compare(spark, sf_dir):
    found = fq.entry_compare(fq.entry_frequency(inputs.stay(spark, sf_dir), FEATURES))
    return found.select("feature", r6("pos_freq"), r6("neg_freq"), r6("difference"))


@query("feature_category_join", with_stay(f"""{sql.CATEGORIES}, {PROFILE}, {COHORT}
SELECT category, CAST(feature_ord AS INTEGER) AS feature_ord, c.feature, {q6('f')} AS avg_freq
FROM cohort c JOIN cats USING (feature) WHERE cohort = 'all'"""))
def feature_category_join(spark, sf_dir):
    every = cohorts(spark, sf_dir).filter("cohort = 'all'")
    return fq.with_category(every, inputs.categories(spark)).select(
        "category", "feature_ord", "feature", r6("avg_freq")
    )


@query("category_rank", with_stay(f"""{sql.CATEGORIES}, {PROFILE}, {COHORT}, p AS (
  SELECT category, c.feature, feature_ord, round(f * 100, 6) AS percent
  FROM cohort c JOIN cats USING (feature) WHERE cohort = 'all')
SELECT category, feature, percent + 0 AS percent,
       CAST(row_number() OVER (PARTITION BY category ORDER BY percent DESC, feature_ord) AS INTEGER) AS rank,
       CASE WHEN percent >= 80 THEN 'High' WHEN percent >= 40 THEN 'Medium' WHEN percent > 0 THEN 'Low' ELSE 'None' END AS tier
FROM p"""))
def category_rank(spark, sf_dir):
    every = cohorts(spark, sf_dir).filter("cohort = 'all'").withColumn("percent", r6(F.col("avg_freq") * 100))
    ranked = fq.category_rank(fq.with_category(every, inputs.categories(spark)), "percent")
    return ranked.select("category", "feature", "percent", "rank", "tier")


@query("abs_diff_order", with_stay(f"""{sql.CATEGORIES}, {PROFILE}, {COHORT}, {COMPARED}, r AS (
  SELECT category, feature, feature_ord, pos_freq, neg_freq, round(difference, 6) AS difference
  FROM cmp JOIN cats USING (feature))
SELECT category, feature, {q6('pos_freq')} AS pos_freq, {q6('neg_freq')} AS neg_freq, difference + 0 AS difference,
       CAST(row_number() OVER (PARTITION BY category ORDER BY abs(difference) DESC, feature_ord) AS INTEGER) AS rank
FROM r"""))
def abs_diff_order(spark, sf_dir):
    """The cohort comparison table: scan, two aggregations, join, rank."""
    compared = fq.cohort_compare(cohorts(spark, sf_dir)).withColumn("difference", r6("difference"))
    ranked = fq.abs_diff_order(fq.with_category(compared, inputs.categories(spark)))
    return ranked.select("category", "feature", r6("pos_freq"), r6("neg_freq"), "difference", "rank")


@query("common_features", with_stay(f"""{PROFILE}, {COHORT}
SELECT feature FROM cohort WHERE cohort = 'positive' AND f IS NOT NULL
INTERSECT SELECT feature FROM cohort WHERE cohort = 'negative' AND f IS NOT NULL"""))
def common_features(spark, sf_dir):
    return fq.common_features(cohorts(spark, sf_dir))
