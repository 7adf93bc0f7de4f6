"""Patient files: the ``stay`` chart is exported as delimited text by Spark and
read back, so the chart itself is what the result is checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from bedside.functions.cells import to_number
from bedside.operators import frequency as fq
from bedside.operators import information as mi
from bedside.operators import sequence as sq
from bedside.plans import inputs, sql
from bedside.plans.frequency_queries import COHORT, COMPARED, ENTRY, PROFILE
from bedside.plans.registry import q6, query, r6
from bedside.plans.score_queries import MI_FEATURES, SCORES, mi_chart
from bedside.plans.sequence_queries import stats_sql
from bedside.plans.sql import with_stay
from bedside.session import cut, new_path, shared_dir, stored
from bedside.sources import incremental as inc
from bedside.sources import patient_files as pf
from bedside.sources import sinks

FEATURES = inputs.STAY_FEATURES
LABEL = "outcome"
COLUMNS = {f: f for f in FEATURES} | {"y": LABEL}
HEADER = list(COLUMNS.values())


def pid_of_file():
    return F.regexp_extract("file", r"(\d+)\.[a-z]+$", 1).cast("long").alias("pid")


_EXPORTS: dict[tuple[str, str, str], str] = {}


def export(spark, sf_dir, kind="psv"):
    """Write the chart as patient files once per application. ``mixed`` writes
    patients with odd ids as comma-separated ``q<id>.csv``."""
    slot = (spark.sparkContext.applicationId, sf_dir, kind)
    if slot not in _EXPORTS:
        path = new_path(spark, f"export-{kind}")
        chart = inputs.stay(spark, sf_dir)
        pid = F.col("pid").cast("string")
        name, mark = F.concat(F.lit("p"), pid, F.lit(".psv")), "|"
        if kind == "mixed":
            odd = F.col("pid") % 2 == 1
            name = F.when(odd, F.concat(F.lit("q"), pid, F.lit(".csv"))).otherwise(name)
            mark = F.when(odd, ",").otherwise("|")
        sinks.write_patient_files(chart, path, COLUMNS, name, mark)
        _EXPORTS[slot] = path
    return _EXPORTS[slot]


def lines(spark, sf_dir, kind="psv"):
    pattern = r"^p.*\.psv$" if kind == "psv" else r"\.(psv|csv)$"
    return stored(
        spark, f"lines-{kind}:{sf_dir}",
        lambda: pf.placed_lines(spark, export(spark, sf_dir, kind), pattern),
    )


CHART_SQL = f"SELECT pid, t, {', '.join(f'{q6(f)} AS {f}' for f in FEATURES)}, y FROM stay"


@query("scan_patient_files", with_stay("""f AS (SELECT 'p' || pid || '.psv' AS file, CAST(count(*) + 1 AS BIGINT) AS lines FROM stay GROUP BY pid)
SELECT file, lines FROM f ORDER BY file LIMIT 10"""))
def scan_patient_files(spark, sf_dir):
    return pf.scan_patient_files(lines(spark, sf_dir), 10)


@query("scan_patient_files_all", with_stay("SELECT 'p' || pid || '.psv' AS file, CAST(count(*) + 1 AS BIGINT) AS lines FROM stay GROUP BY pid"))
def scan_patient_files_all(spark, sf_dir):
    return pf.scan_patient_files(lines(spark, sf_dir))


@query("discover_headers", "SELECT * FROM (VALUES " + ", ".join(f"('{h}')" for h in HEADER) + ") v(name)")
def discover_headers(spark, sf_dir):
    return pf.discover_headers(lines(spark, sf_dir))


@query("read_by_name", with_stay(CHART_SQL.replace(", y FROM", ", CAST(y AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS absent FROM")))
def read_by_name(spark, sf_dir):
    rows = pf.read_by_name(lines(spark, sf_dir), [*HEADER, "absent"])
    return rows.select(pid_of_file(), "t", *[r6(f) for f in FEATURES], F.col(LABEL).alias("y"), "absent")


@query("read_positional", with_stay(CHART_SQL.replace(", y FROM", ", CAST(y AS VARCHAR) AS y FROM")))
def read_positional(spark, sf_dir):
    rows = pf.read_positional(lines(spark, sf_dir), HEADER)
    return rows.select(
        pid_of_file(), "t", *[r6(to_number(F.col(f)), f) for f in FEATURES], F.col(LABEL).alias("y")
    )


FILE_PROFILE = with_stay(f"""{PROFILE}
SELECT 'p' || pid || '.psv' AS pid, CAST(n AS BIGINT) AS rows, {", ".join(f"{q6(f)} AS freq_{f}" for f in FEATURES)},
       CAST(is_positive AS INTEGER) AS is_positive, CAST(duration AS BIGINT) AS duration FROM profile""")


@query("patient_profile_files", FILE_PROFILE)
def patient_profile_files(spark, sf_dir):
    """Profiles by the text rules: one header by position, label text ``1``."""
    text = pf.read_positional(lines(spark, sf_dir), HEADER)
    found = fq.patient_profile(pf.presence_chart(text, FEATURES, LABEL), FEATURES)
    return found.select(
        "pid", "rows", *[r6(f"freq_{f}") for f in FEATURES],
        F.col("is_positive").cast("int").alias("is_positive"), "duration",
    )


@query("entry_frequency_files", with_stay(f"""{ENTRY}
SELECT CAST(label AS INTEGER) AS label, feature, CAST(present AS BIGINT) AS present,
       CAST(entries AS BIGINT) AS entries, {q6('freq')} AS freq FROM entry"""))
def entry_frequency_files(spark, sf_dir):
    """Entry frequencies by the text rules: each file's own header."""
    text = pf.read_text_by_name(lines(spark, sf_dir), HEADER)
    found = fq.entry_frequency(pf.presence_chart(text, FEATURES, LABEL), FEATURES)
    return found.select("label", "feature", "present", "entries", r6("freq"))


@query("time_index", with_stay("SELECT pid, t FROM stay"))
def time_index(spark, sf_dir):
    return pf.read_by_name(lines(spark, sf_dir), ["anyv"]).select(pid_of_file(), "t")


@query("mixed_format_union", with_stay(f"""SELECT CASE WHEN pid % 2 = 1 THEN 'q' || pid || '.csv' ELSE 'p' || pid || '.psv' END AS file,
  t, {', '.join(f'{q6(f)} AS {f}' for f in FEATURES)}, CAST(y AS DOUBLE) AS y FROM stay"""))
def mixed_format_union(spark, sf_dir):
    rows = pf.read_union(lines(spark, sf_dir, "mixed"))
    return rows.select("file", "t", *[r6(f) for f in FEATURES], F.col(LABEL).alias("y"))


@query("quoted_records", with_stay("""SELECT pid, t, CASE t % 3 WHEN 0 THEN 'hour "' || t || '", of' || chr(10) || 'patient ' || pid
  WHEN 1 THEN 'a,b' ELSE '' END AS note, CAST(y AS VARCHAR) AS outcome FROM stay"""))
def quoted_records(spark, sf_dir):
    """Notes with commas, quotes and line ends, written as quoted cells and read back."""
    chart = inputs.stay(spark, sf_dir)
    hour, pid = F.col("t").cast("string"), F.col("pid").cast("string")
    long = F.concat(F.lit('hour "'), hour, F.lit('", of\npatient '), pid)
    note = F.when(F.col("t") % 3 == 0, long).when(F.col("t") % 3 == 1, "a,b").otherwise("")
    cell = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    path = new_path(spark, "notes")
    name = F.concat(F.lit("q"), pid, F.lit(".csv"))
    sinks.write_patient_files(chart.withColumn("note", cell), path, {"note": "note", "y": LABEL}, name, ",")
    rows = pf.read_text_by_name(pf.ingest_records(spark, path), ["note", LABEL])
    return rows.select(pid_of_file(), "t", "note", LABEL)


def extract(spark, sf_dir):
    """Folder of the extracted patients and the check of their number."""
    path = new_path(spark, "positive")
    return path, sinks.extract_positive_cohort(lines(spark, sf_dir), path, LABEL, expected=1790)


@query("positive_cohort_extract", with_stay("""p AS (SELECT pid, count(*) + 1 AS n FROM stay GROUP BY pid HAVING max(y) = 1)
SELECT CAST(count(*) AS BIGINT) AS found, CAST(1790 AS BIGINT) AS expected, CAST(count(*) = 1790 AS INTEGER) AS as_expected,
       CAST(sum(n) AS BIGINT) AS lines_written FROM p"""))
def positive_cohort_extract(spark, sf_dir):
    path, check = extract(spark, sf_dir)
    written = pf.ingest_lines(spark, path).agg(F.count(F.lit(1)).alias("n"))
    return check.select(
        "found", "expected", F.col("as_expected").cast("int").alias("as_expected"),
        written.scalar().alias("lines_written"),
    )


@query("positive_cohort_rows", with_stay(CHART_SQL.replace(", y FROM", ", CAST(y AS DOUBLE) AS y FROM")
       + " WHERE pid IN (SELECT pid FROM stay WHERE y = 1)"))
def positive_cohort_rows(spark, sf_dir):
    """The extracted patients, read again from their files."""
    path, _ = extract(spark, sf_dir)
    rows = pf.read_by_name(pf.ingest_lines(spark, path), HEADER)
    return rows.select(pid_of_file(), "t", *[r6(f) for f in FEATURES], F.col(LABEL).alias("y"))


@query("write_results_csv", with_stay(f"""{PROFILE}, {COHORT}, {COMPARED}
SELECT feature, {q6('pos_freq')} AS pos_freq, {q6('neg_freq')} AS neg_freq, {q6('difference')} AS difference FROM cmp"""))
def write_results_csv(spark, sf_dir):
    profile = fq.patient_profile(inputs.stay(spark, sf_dir), FEATURES)
    compared = fq.cohort_compare(fq.cohort_frequency(profile, FEATURES))
    rounded = compared.select("feature", r6("pos_freq"), r6("neg_freq"), r6("difference"))
    return sinks.write_results_csv(rounded, new_path(spark, "results"))


@query("stats_roundtrip", with_stay(f"""stats AS ({stats_sql("stay", FEATURES)})
SELECT feature, {q6('mean')} AS mean, {q6('std')} AS std FROM stats"""))
def stats_roundtrip(spark, sf_dir):
    stats = sq.norm_stats(inputs.stay(spark, sf_dir), FEATURES)
    return sinks.save_stats(stats, new_path(spark, "stats")).select("feature", r6("mean"), r6("std"))


REPORTS = f"""{sql.CATEGORIES}, {PROFILE}, {COHORT}, {COMPARED}, {ENTRY}, {SCORES},
pct AS (SELECT category, c.feature, feature_ord, round(f * 100, 6) AS percent FROM cohort c JOIN cats USING (feature) WHERE cohort = 'all'),
ranked AS (SELECT feature, percent, row_number() OVER (PARTITION BY category ORDER BY percent DESC, feature_ord) AS rank,
  CASE WHEN percent >= 80 THEN 'High' WHEN percent >= 40 THEN 'Medium' WHEN percent > 0 THEN 'Low' ELSE 'None' END AS tier FROM pct),
dif AS (SELECT category, feature, feature_ord, pos_freq, neg_freq, round(difference, 6) AS difference FROM cmp JOIN cats USING (feature)),
difr AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY abs(difference) DESC, feature_ord) AS rank FROM dif),
ent AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.freq, 0) AS p, coalesce(b.freq, 0) AS n
        FROM (SELECT * FROM entry WHERE label = 1) a FULL JOIN (SELECT * FROM entry WHERE label = 0) b ON a.feature = b.feature),
mir AS (SELECT feature, {q6('mi')} AS mi, row_number() OVER (ORDER BY {q6('mi')} DESC NULLS LAST, feature) AS rank FROM mi)
SELECT 'average_frequency' AS report, feature, CAST(rank AS INTEGER) AS rank, tier, percent + 0 AS value, CAST(NULL AS DOUBLE) AS other FROM ranked
UNION ALL SELECT 'label_duration', 'mean_hours', NULL, NULL, {q6('avg(duration) FILTER (is_positive AND duration > 0)')}, CAST(count(*) FILTER (is_positive) AS DOUBLE) FROM profile
UNION ALL SELECT 'cohort_frequency', feature, CAST(rank AS INTEGER), category, difference + 0, {q6('pos_freq')} FROM difr
UNION ALL SELECT 'entry_level', feature, NULL, NULL, {q6('(p - n) * 100')}, {q6('p')} FROM ent
UNION ALL SELECT 'mutual_information', feature, CAST(rank AS INTEGER), NULL, mi, NULL FROM mir"""


@query("report_bundle", with_stay(REPORTS))
def report_bundle(spark, sf_dir):
    """The analyses with their tiers, ranks, durations and differences, each kept
    under one output folder and read back."""
    chart = inputs.stay(spark, sf_dir)
    profile = fq.patient_profile(chart, FEATURES)
    cohorts = cut(fq.cohort_frequency(profile, FEATURES), "cohorts")
    every = cohorts.filter("cohort = 'all'").withColumn("percent", r6(F.col("avg_freq") * 100))
    categories = inputs.categories(spark)
    difference = fq.cohort_compare(cohorts).withColumn("difference", r6("difference"))
    scores = mi.mutual_information(mi_chart(spark, sf_dir), MI_FEATURES)
    reports = sinks.write_reports({
        "average_frequency": fq.category_rank(fq.with_category(every, categories), "percent"),
        "label_duration": fq.label_duration(profile),
        "cohort_frequency": fq.abs_diff_order(fq.with_category(difference, categories)),
        "entry_level": fq.entry_compare(fq.entry_frequency(chart, FEATURES)),
        "mutual_information": mi.mi_order(scores.select("feature", r6("mi"))),
    }, new_path(spark, "reports"))
    none, text = F.lit(None), F.lit(None).cast("string")
    shown = {
        "average_frequency": (F.col("feature"), F.col("rank"), F.col("tier"), F.col("percent"), none),
        "label_duration": (F.lit("mean_hours"), none, text, r6("mean_hours"), F.col("positive_patients")),
        "cohort_frequency": (F.col("feature"), F.col("rank"), F.col("category"), F.col("difference"), r6("pos_freq")),
        "entry_level": (F.col("feature"), none, text, r6("difference"), r6("pos_freq")),
        "mutual_information": (F.col("feature"), F.col("rank"), text, F.col("mi"), none),
    }
    parts = [
        reports[name].select(
            F.lit(name).alias("report"), feature.alias("feature"), rank.cast("int").alias("rank"), tier.alias("tier"),
            value.cast("double").alias("value"), other.cast("double").alias("other"),
        )
        for name, (feature, rank, tier, value, other) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("keyed_materialise", with_stay("""SELECT CAST(max(n) AS INTEGER) AS longest, CAST(sum(n) AS BIGINT) AS rows, 1 AS reused
FROM (SELECT least(count(*), 48) AS n FROM stay GROUP BY pid)"""))
def keyed_materialise(spark, sf_dir):
    """Prepared sequences are stored under a key of their inputs and settings; the
    second request reads them."""
    source = lines(spark, sf_dir)
    chart = inputs.stay(spark, sf_dir)
    stats = sq.norm_stats(chart, FEATURES)
    settings = stats.select(
        F.concat_ws("=", "feature", F.round("mean", 6), F.round("std", 6)).alias("part")
    ).unionByName(spark.createDataFrame([("max_len=48",), ("label=False",), ("horizon=6",)], "part string"))
    key = sinks.content_digest(source, "file") + "-" + sinks.content_digest(settings, "part")
    folder = f"{shared_dir(spark)}/prepared"
    about = {"features": ",".join(FEATURES), "max_len": "48", "label": "False", "horizon": "6"}

    def build():
        return sq.sequence_features(chart, FEATURES, stats, 6, max_len=48)

    sinks.keyed_table(spark, folder, key, about, build)
    table, reused = sinks.keyed_table(spark, folder, key, about, build)
    return table.agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("rows")).withColumn(
        "reused", F.lit(int(reused))
    )


@query("incremental_materialise", with_stay("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT pid) AS BIGINT) AS patients,
  CAST(sum(y) AS BIGINT) AS positives, 1 AS rebuilt FROM stay"""))
def incremental_materialise(spark, sf_dir):
    """A table built while the first file lacked its last line, then refreshed from all
    files: one part is built again."""
    source = lines(spark, sf_dir)
    first = source.agg(F.min("file")).scalar()
    mine = F.col("file") == first
    whole = source.filter(mine)
    end = whole.select(F.max(F.struct("chunk", "split", "pos"))).scalar()
    shorter = source.filter(~mine | (F.struct("chunk", "split", "pos") != end))
    folder = new_path(spark, "following")

    def build(rows):
        return pf.read_by_name(rows, HEADER)

    inc.refresh(shorter, folder, build, {"columns": ",".join(HEADER)})
    rebuilt = inc.refresh(source, folder, build, {"columns": ",".join(HEADER)})
    return inc.current_table(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("file").alias("patients"),
        F.sum(LABEL).cast("long").alias("positives"),
    ).withColumn("rebuilt", F.lit(len(rebuilt)))
