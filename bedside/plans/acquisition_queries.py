"""Active feature acquisition over all patients."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.operators import acquisition as aq
from bedside.operators import sequence as sq
from bedside.plans import inputs, sql
from bedside.plans.registry import q6, query, r6
from bedside.plans.sequence_queries import sequence_sql, sequences, training_stats
from bedside.plans.sql import with_stay
from bedside.session import new_path, stored
from bedside.sources import sinks

FEATURES = inputs.STAY_FEATURES
NAMES = [f"{p}_{f}" for p in ("x", "m", "d") for f in FEATURES]
TOP_K = 3
THRESHOLD = 0.15

# A fixed three-model scorer, so that both engines score the same way.
MODELS = [
    {"intercept": -2.0, "x_click": 0.6, "x_engage": -0.4, "x_signup": 0.3, "x_anyv": 0.9,
     "m_click": 0.2, "m_signup": 0.1, "d_anyv": -0.01, "d_click": 0.02},
    {"intercept": -1.5, "x_click": -0.2, "x_engage": 0.8, "x_signup": 0.5, "x_anyv": 0.4,
     "m_engage": 0.3, "d_engage": 0.01, "d_signup": -0.005},
    {"intercept": -1.0, "x_anyv": 1.2, "x_refund": 0.7, "m_refund": -0.5, "m_signup": 0.4, "d_refund": -0.002},
]


def scored(spark, sf_dir):
    """Sequence features at horizon 1 with uncertainty and baseline entropy."""
    table = stored(spark, f"sequence:{sf_dir}", lambda: sequences(spark, sf_dir, 1))
    return aq.with_scores(table, FEATURES, aq.linear_scorer(MODELS))


def report(spark, sf_dir):
    table = stored(spark, f"sequence:{sf_dir}", lambda: sequences(spark, sf_dir, 1))
    return aq.acquisition_report(table, FEATURES, aq.linear_scorer(MODELS), top_k=TOP_K)


def logits_sql(asked: str | None = None, value: str = "") -> list[str]:
    """Logit per model; with ``asked`` the named feature counts as observed."""
    def column(name: str) -> str:
        part, f = name.split("_", 1)
        new = {"x": value, "m": "1", "d": "0.0"}[part]
        return f"CASE WHEN {asked} = '{f}' THEN {new} ELSE {name} END" if asked else name

    return [
        f"({m['intercept']} + " + " + ".join(f"({column(n)}) * ({w})" for n, w in m.items() if n != "intercept") + ")"
        for m in MODELS
    ]


def entropy_sql(logits: list[str]) -> str:
    mean = "(" + " + ".join(f"1.0 / (1.0 + exp(-{z}))" for z in logits) + ") / 3.0"
    p = f"least(greatest({mean}, 1e-7), 1.0 - 1e-7)"
    return f"(-({p} * log2({p}) + (1.0 - {p}) * log2(1.0 - {p})))"


Z = logits_sql()
SCORED = f"""{sequence_sql(1)}, sc AS MATERIALIZED (
  SELECT *, greatest(0.0, ({" + ".join(f"{z} * {z}" for z in Z)}) / 3.0 - pow(({" + ".join(Z)}) / 3.0, 2)) AS uncertainty,
         {entropy_sql(Z)} AS baseline FROM seq)"""
CHOSEN = f"""{SCORED}, ch AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY uncertainty DESC, t) AS n FROM sc WHERE t < length - 1)
  WHERE n <= {TOP_K}),
cells AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT *, '{f}' AS feature_name, {i} AS feature_model_idx FROM ch WHERE m_{f} = 0" for i, f in enumerate(FEATURES))})"""
GAINED = f"""{CHOSEN}, gain AS MATERIALIZED (
  SELECT pid AS patient_id, t AS timestep_idx_analyzed, feature_name, feature_model_idx, baseline AS b,
         ({" + ".join(entropy_sql(logits_sql("feature_name", v)) for v in ("0.0", "1.0", "-1.0"))}) / 3.0 AS e FROM cells)"""


@query("uncertainty_filter", with_stay(f"""{SCORED}
SELECT pid, t, {q6('uncertainty')} AS uncertainty FROM sc WHERE t < length - 1 AND uncertainty >= {THRESHOLD}"""))
def uncertainty_filter(spark, sf_dir):
    return aq.choose_steps(scored(spark, sf_dir), threshold=THRESHOLD).select("pid", "t", r6("uncertainty"))


@query("top_k_uncertain", with_stay(f"{CHOSEN} SELECT pid, t, {q6('uncertainty')} AS uncertainty FROM ch"))
def top_k_uncertain(spark, sf_dir):
    return aq.choose_steps(scored(spark, sf_dir), top_k=TOP_K).select("pid", "t", r6("uncertainty"))


@query("missing_cells_at_step", with_stay(f"""{CHOSEN}
SELECT pid, t, feature_name, CAST(feature_model_idx AS INTEGER) AS feature_model_idx FROM cells"""))
def missing_cells_at_step(spark, sf_dir):
    chosen = aq.choose_steps(scored(spark, sf_dir), top_k=TOP_K)
    return aq.missing_cells(chosen, FEATURES).select("pid", "t", "feature_name", "feature_model_idx")


@query("what_if_fanout", with_stay(f"""{CHOSEN}, fan AS (SELECT *, unnest([0.0, 1.0, -1.0]) AS sample FROM cells)
SELECT pid, t, feature_name, CAST(sample AS DOUBLE) AS sample, {", ".join(
    f"(round(CASE WHEN feature_name = '{f}' THEN CAST(sample AS DOUBLE) ELSE x_{f} END, 6) + 0) AS x_{f}, "
    f"CAST(CASE WHEN feature_name = '{f}' THEN 1 ELSE m_{f} END AS INTEGER) AS m_{f}, "
    f"CASE WHEN feature_name = '{f}' THEN CAST(0 AS DOUBLE) ELSE d_{f} END AS d_{f}, {q6(f'l_{f}')} AS l_{f}" for f in FEATURES)} FROM fan"""))
def what_if_fanout(spark, sf_dir):
    cells = aq.missing_cells(aq.choose_steps(scored(spark, sf_dir), top_k=TOP_K), FEATURES)
    fan = aq.what_if_fanout(cells, FEATURES)
    parts = [c for f in FEATURES for c in (r6(f"x_{f}"), f"m_{f}", f"d_{f}", r6(f"l_{f}"))]
    return fan.select("pid", "t", "feature_name", "sample", *parts)


GAIN_COLUMNS = f"""patient_id, CAST(timestep_idx_analyzed AS INTEGER) AS timestep_idx_analyzed, feature_name,
  CAST(feature_model_idx AS INTEGER) AS feature_model_idx, {q6('b')} AS baseline_entropy_at_timestep,
  {q6('e')} AS expected_entropy_after_acquiring_feature, {q6('b - e')} AS information_gain"""


def rounded(df):
    return df.select(
        "patient_id", "timestep_idx_analyzed", "feature_name", "feature_model_idx",
        r6("baseline_entropy_at_timestep"), r6("expected_entropy_after_acquiring_feature"),
        r6("information_gain"),
    )


@query("information_gain", with_stay(GAINED.replace(f"WHERE n <= {TOP_K}", "WHERE t = 0")
       + f" SELECT {GAIN_COLUMNS} FROM gain"))
def information_gain(spark, sf_dir):
    """Gain of the missing cells at every patient's first step."""
    first = aq.choose_steps(scored(spark, sf_dir))
    return rounded(aq.information_gain(aq.missing_cells(first, FEATURES), FEATURES, aq.linear_scorer(MODELS)))


@query("acquisition_report", with_stay(f"{GAINED} SELECT {GAIN_COLUMNS} FROM gain"))
def acquisition_report(spark, sf_dir):
    return sinks.write_results_csv(rounded(report(spark, sf_dir)), new_path(spark, "acquisition"))


@query("gain_by_feature", with_stay(f"""{GAINED}
SELECT feature_name, {q6('avg(b - e)')} AS mean_gain FROM gain GROUP BY feature_name ORDER BY mean_gain DESC, feature_name LIMIT 10"""))
def gain_by_feature(spark, sf_dir):
    return aq.gain_by_feature(report(spark, sf_dir)).select("feature_name", r6("mean_gain"))


@query("feature_counts_top", with_stay(f"""{GAINED}
SELECT feature_name, CAST(count(*) AS BIGINT) AS analysed FROM gain GROUP BY feature_name ORDER BY analysed DESC, feature_name LIMIT 10"""))
def feature_counts_top(spark, sf_dir):
    return aq.feature_counts_top(report(spark, sf_dir))


@query("acquisition_fitted", with_stay(f"""cells AS ({sql.long_form()})
SELECT feature AS feature_name, 1 AS in_range FROM cells WHERE value IS NULL GROUP BY feature"""))
def acquisition_fitted(spark, sf_dir):
    """The same report with three logistic models fitted on the sequences: every
    feature with missing cells is ranked, and a gain is at most one bit."""
    table = stored(spark, f"sequence:{sf_dir}", lambda: sequences(spark, sf_dir, 1))
    scorer = aq.fit_scorer(table, FEATURES)
    found = aq.gain_by_feature(aq.acquisition_report(table, FEATURES, scorer, top_k=TOP_K))
    return found.select("feature_name", (F.abs("mean_gain") <= 1).cast("int").alias("in_range"))


DONOR_SQL = f"""q AS (SELECT quantile_cont(t, [{1 / 3!r}, {2 / 3!r}]) AS e FROM stay),
obs AS (SELECT pid, t, feature, value, CASE WHEN t > e[2] THEN 2 WHEN t > e[1] THEN 1 ELSE 0 END AS tertile
        FROM ({sql.long_form()}), q WHERE value IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY feature, tertile ORDER BY md5(pid || '|' || t || '|' || feature || '|42')) AS n FROM obs)"""


@query("donor_samples", with_stay(f"""{DONOR_SQL}
SELECT feature AS feature_name, CAST(tertile AS INTEGER) AS tertile, CAST(n - 1 AS INTEGER) AS donor, {q6('value')} AS value FROM rk WHERE n <= 5"""))
def donor_samples(spark, sf_dir):
    chart = inputs.stay(spark, sf_dir)
    found = aq.donor_samples(chart, FEATURES, aq.tertile_edges(chart), 5)
    return found.select("feature_name", "tertile", F.posexplode("values").alias("donor", "value")).withColumn(
        "value", r6("value")
    )


DONOR_GAIN = f"""{CHOSEN}, q AS (SELECT quantile_cont(t, [{1 / 3!r}, {2 / 3!r}]) AS e FROM stay),
obs AS (SELECT pid, t, feature, value, CASE WHEN t > e[2] THEN 2 WHEN t > e[1] THEN 1 ELSE 0 END AS tertile
        FROM ({sql.long_form('z')}), q WHERE value IS NOT NULL),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature, tertile
         ORDER BY md5(pid || '|' || t || '|' || feature || '|42')) AS n FROM obs) WHERE n <= 5),
ct AS (SELECT cells.*, CASE WHEN t > e[2] THEN 2 WHEN t > e[1] THEN 1 ELSE 0 END AS tertile FROM cells, q),
fan AS (SELECT ct.*, {entropy_sql(logits_sql('feature_name', 'rk.value'))} AS after
        FROM ct JOIN rk ON rk.feature = ct.feature_name AND rk.tertile = ct.tertile)"""


@query("donor_gain", with_stay(f"""{DONOR_GAIN}
SELECT pid AS patient_id, t AS timestep_idx_analyzed, feature_name, {q6('max(baseline) - avg(after)')} AS information_gain
FROM fan GROUP BY pid, t, feature_name"""))
def donor_gain(spark, sf_dir):
    """Gains with observed donor values of the same third of the stay."""
    chart = inputs.stay(spark, sf_dir)
    edges = aq.tertile_edges(chart)
    normed = sq.normalise(chart, FEATURES, training_stats(spark, sf_dir))
    donors = aq.donor_samples(normed, FEATURES, edges, 5)
    cells = aq.missing_cells(aq.choose_steps(scored(spark, sf_dir), top_k=TOP_K), FEATURES)
    gains = aq.information_gain_from_donors(
        aq.with_tertile(cells, edges), FEATURES, aq.linear_scorer(MODELS), donors
    )
    return gains.select("patient_id", "timestep_idx_analyzed", "feature_name", r6("information_gain"))


# Fixed predictors of each feature from the others, so that both engines match alike.
PREDICTORS = {
    "click": {"intercept": 0.1, "x_anyv": 0.6, "m_engage": -0.2, "d_engage": 0.01},
    "engage": {"intercept": -0.05, "x_anyv": 0.8, "x_click": -0.1, "m_signup": 0.15},
    "signup": {"intercept": 0.0, "x_anyv": 0.4, "d_refund": -0.005, "m_click": 0.1},
    "anyv": {"intercept": 0.02, "x_click": 0.3, "x_engage": 0.5},
    "refund": {"intercept": -0.1, "x_anyv": 0.7, "m_signup": -0.3, "d_click": 0.002},
}


def predicted_sql(f: str) -> str:
    model = PREDICTORS[f]
    terms = "".join(f" + {n} * ({w})" for n, w in model.items() if n != "intercept")
    return f"(round({model['intercept']}{terms}, 6) + 0)"


POOL = " UNION ALL ".join(
    f"SELECT pid || ':' || t AS id, '{f}' AS feature, CAST(x_{f} AS DOUBLE) AS value, {predicted_sql(f)} AS p FROM seq WHERE m_{f} = 1"
    for f in FEATURES
)
MATCHED = f"""{CHOSEN}, pool AS MATERIALIZED ({POOL}),
asked AS (SELECT *, CASE feature_name {" ".join(f"WHEN '{f}' THEN {predicted_sql(f)}" for f in FEATURES)} END AS p FROM cells),
near AS (SELECT c.pid, c.t, c.feature_name, min({{'d': (c.p - d.p) * (c.p - d.p), 'id': d.id, 'value': d.value}}, 5) AS donors
  FROM asked c JOIN pool d ON d.feature = c.feature_name GROUP BY ALL)"""


def matched(spark, sf_dir):
    table = stored(spark, f"sequence:{sf_dir}", lambda: sequences(spark, sf_dir, 1))
    cells = aq.missing_cells(aq.choose_steps(scored(spark, sf_dir), top_k=TOP_K), FEATURES)
    return aq.conditional_donors(cells, table, FEATURES, PREDICTORS, 5)


@query("conditional_donors", with_stay(f"""{MATCHED}
SELECT pid, t, feature_name, i - 1 AS donor, donors[i].id AS donor_id, {q6('donors[i].value')} AS value
FROM (SELECT *, unnest(range(1, len(donors) + 1)) AS i FROM near)"""))
def conditional_donors(spark, sf_dir):
    """Observed values of the rows that predict a missing cell's feature most alike."""
    found = matched(spark, sf_dir).select("pid", "t", "feature_name", F.posexplode("donors").alias("donor", "_d"))
    return found.select(
        "pid", "t", "feature_name", F.col("donor").cast("long").alias("donor"), F.col("_d.id").alias("donor_id"), r6("_d.value", "value")
    )


@query("conditional_gain", with_stay(f"""{MATCHED}, fan AS (
  SELECT a.*, v.value AS given FROM asked a JOIN (SELECT pid, t, feature_name, unnest(donors) AS v FROM near) USING (pid, t, feature_name))
SELECT pid AS patient_id, t AS timestep_idx_analyzed, feature_name,
  {q6(f"max(baseline) - avg({entropy_sql(logits_sql('feature_name', 'given'))})")} AS information_gain
FROM fan GROUP BY pid, t, feature_name"""))
def conditional_gain(spark, sf_dir):
    """Gains with each cell's own donors in place of the fixed what-if values."""
    cells = matched(spark, sf_dir).withColumn("values", F.transform("donors", lambda d: d["value"])).filter(F.size("values") > 0)
    gains = aq.information_gain_from_values(cells, FEATURES, aq.linear_scorer(MODELS))
    return gains.select("patient_id", "timestep_idx_analyzed", "feature_name", r6("information_gain"))
