"""Mutual information, mixture functions and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.functions import hashing, mixture as mx
from bedside.operators import evaluation as ev
from bedside.operators import frequency as fq
from bedside.operators import information as mi
from bedside.operators import sequence as sq
from bedside.operators import sketches as sk
from bedside.operators import tabular as tb
from bedside.plans import inputs, sql
from bedside.plans.registry import q6, query, r6
from bedside.plans.sequence_queries import HORIZON, TARGETS
from bedside.plans.sql import with_preds, with_stay
from bedside.session import cut, stored

FEATURES = inputs.STAY_FEATURES
# A two-valued feature next to the recorded ones: its equal quantile edges merge.
MI_FEATURES = [*FEATURES, "high"]

MI_CHART = "mic AS (SELECT *, CASE WHEN anyv > 50 THEN 1.0 ELSE 0.0 END AS high FROM stay)"
MI_CELLS = f"mc AS (SELECT * FROM ({sql.long_form('mic', MI_FEATURES)}) WHERE value IS NOT NULL)"
QUANTILE_CASES = " ".join(
    f"WHEN {k} THEN quantile_cont(value, [{', '.join(repr(i / k) for i in range(k + 1))}])" for k in (2, 3, 4, 5)
)
BINS = f"""{MI_CHART}, {MI_CELLS},
nb AS (SELECT feature, greatest(2, least(5, count(DISTINCT value))) AS k FROM mc GROUP BY feature),
qa AS (SELECT mc.feature, k, CASE k {QUANTILE_CASES} END AS qs FROM mc JOIN nb ON mc.feature = nb.feature GROUP BY mc.feature, k),
qs AS (SELECT feature, unnest(qs) AS edge, unnest(range(k + 1)) AS i FROM qa),
q2 AS (SELECT *, edge - lag(edge) OVER (PARTITION BY feature ORDER BY i) AS gap FROM qs),
kept AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY i) AS r,
                count(*) OVER (PARTITION BY feature) AS c FROM q2 WHERE gap IS NULL OR gap > 1e-8),
edges AS (SELECT feature, edge FROM kept WHERE r > 1 AND r < c),
binned AS (SELECT mc.feature, pid, t, y, value,
                  (SELECT count(*) FROM edges WHERE edges.feature = mc.feature AND edges.edge <= mc.value) AS bin FROM mc)"""

SCORES = f"""{BINS}, ct AS (
  SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS tot, sum(n) OVER (PARTITION BY feature, bin) AS nx,
             sum(n) OVER (PARTITION BY feature, y) AS ny FROM ct),
sc AS (SELECT feature, greatest(sum(n / tot * ln(n * tot / (nx * ny))), 0.0) AS s FROM w GROUP BY feature),
g AS (SELECT feature, count(value) AS present, count(DISTINCT CASE WHEN value IS NOT NULL THEN y END) AS classes
      FROM ({sql.long_form('mic', MI_FEATURES)}) GROUP BY feature),
mi AS (SELECT g.feature, CASE WHEN present >= 10 AND classes >= 2 THEN s END AS mi,
              CASE WHEN present < 10 THEN 'too few rows' WHEN classes < 2 THEN 'one class' ELSE 'ok' END AS status
       FROM g LEFT JOIN sc ON g.feature = sc.feature)"""


def mi_chart(spark, sf_dir):
    high = F.when(F.col("anyv") > 50, 1.0).otherwise(0.0)
    return inputs.stay(spark, sf_dir).withColumn("high", high)


@query("quantile_bin", with_stay(f"""{BINS}
SELECT pid, t, feature, {q6('value')} AS value, CAST(bin AS INTEGER) AS bin FROM binned"""))
def quantile_bin(spark, sf_dir):
    binned = mi.quantile_bin(mi_chart(spark, sf_dir), MI_FEATURES)
    return binned.select("pid", "t", "feature", r6("value"), "bin")


@query("uniform_bin", with_stay(f"""{MI_CHART}, {MI_CELLS},
sp AS (SELECT feature, min(value) AS low, max(value) AS high, count(DISTINCT value) AS d FROM mc GROUP BY feature),
wd AS (SELECT *, greatest(2, least(5, d)) AS k, (high - low) / greatest(2, least(5, d)) AS width FROM sp),
ed AS (SELECT feature, low + width * i AS edge FROM (SELECT *, unnest(range(1, k)) AS i FROM wd WHERE d > 1)),
bn AS (SELECT mc.feature, mc.value, mc.y, (SELECT count(*) FROM ed WHERE ed.feature = mc.feature AND ed.edge <= mc.value) AS bin FROM mc)
SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, {q6('min(value)')} AS low, {q6('max(value)')} AS high FROM bn GROUP BY feature, bin"""))
def uniform_bin(spark, sf_dir):
    """The other strategy: bins of equal width, here counted."""
    binned = mi.quantile_bin(mi_chart(spark, sf_dir), MI_FEATURES, strategy="uniform")
    return binned.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("value"), "low"), r6(F.max("value"), "high")
    )


@query("distinct_counts", with_stay(f"""{MI_CHART}, c AS ({sql.long_form('mic', MI_FEATURES)})
SELECT feature, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values,
       CAST(count(DISTINCT CASE WHEN value IS NOT NULL THEN y END) AS BIGINT) AS classes FROM c GROUP BY feature"""))
def distinct_counts(spark, sf_dir):
    return mi.distinct_counts(mi_chart(spark, sf_dir), MI_FEATURES)


@query("mutual_information", with_stay(f"{SCORES} SELECT feature, {q6('mi')} AS mi, status FROM mi"))
def mutual_information(spark, sf_dir):
    scores = mi.mutual_information(mi_chart(spark, sf_dir), MI_FEATURES)
    return scores.select("feature", r6("mi"), "status")


@query("mi_order", with_stay(f"""{SCORES}, r AS (SELECT feature, {q6('mi')} AS mi FROM mi)
SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC NULLS LAST, feature) AS INTEGER) AS rank FROM r"""))
def mi_order(spark, sf_dir):
    scores = mi.mutual_information(mi_chart(spark, sf_dir), MI_FEATURES)
    return mi.mi_order(scores.select("feature", r6("mi")))


# --- sketches ----------------------------------------------------------------

KINDS = ["click", "view", "purchase"]
PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]
KIND_CELLS = "kc AS (SELECT event_type AS feature, value FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL)"


def monthly_sketches(spark, sf_dir):
    """Sketches of the values of three kinds of event, stored per month; and the exact
    counts they are held against."""
    events = inputs.table(spark, sf_dir, "events")
    chart = events.select("ts", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in KINDS])

    def build():
        month = F.date_format(F.col("ts"), "yyyy-MM")
        return sk.sketch_parts(chart, KINDS, month)

    parts = stored(spark, f"sketches:{sf_dir}", build)
    counts = mi.value_counts(chart.withColumn("y", F.lit(1)), KINDS).select("feature", "value", "n")
    return sk.merged(parts), counts


@query("sketch_quantiles", f"""WITH {KIND_CELLS}
SELECT feature, CAST(prob AS DOUBLE) AS prob, CAST(count(*) AS BIGINT) AS n, 1 AS within
FROM kc, (SELECT unnest({PROBS}) AS prob) GROUP BY feature, prob""")
def sketch_quantiles(spark, sf_dir):
    """Quantiles of all months from stored sketches; ``within``: the rank error, taken
    from all values, is within the bound."""
    whole, counts = monthly_sketches(spark, sf_dir)
    found = cut(sk.sketched_quantiles(whole, PROBS), "quantiles")
    errors = sk.rank_distance(counts, found)
    return found.select("feature", "prob", "n").join(F.broadcast(errors), ["feature", "prob"]).select(
        "feature", "prob", "n", (F.col("error") <= sk.rank_error()).cast("int").alias("within")
    )


@query("sketch_distinct", f"""WITH {KIND_CELLS}
SELECT feature, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS exact, 1 AS within FROM kc GROUP BY feature""")
def sketch_distinct(spark, sf_dir):
    """Distinct values by merged sketches beside the exact counts."""
    whole, counts = monthly_sketches(spark, sf_dir)
    exact = cut(counts.groupBy("feature").agg(F.count(F.lit(1)).alias("exact")), "exact")
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * sk.distinct_error()
    return sk.sketched_distinct(whole).join(F.broadcast(exact), "feature").select(
        "feature", "n", "exact", near.cast("int").alias("within")
    )


# --- mixture functions -------------------------------------------------------


def over_preds(key: str, spark_column, sql_expr: str):
    """Register one column expression over the mixture outputs."""

    @query(key, with_preds(f"SELECT vec_id, {q6(sql_expr)} AS value FROM preds"))
    def run(spark, sf_dir):
        return inputs.preds(spark, sf_dir).select("vec_id", r6(spark_column(), "value"))


SIG = "1.0 / (1.0 + exp(-{}))"
P_SQL = " + ".join(f"pis[{k}] * (1.0 / (1.0 + exp(-mus[{k}])))" for k in (1, 2, 3))
CLAMPED = f"least(greatest({P_SQL}, 1e-7), 1.0 - 1e-7)"
VAR_SQL = (
    "greatest(0.0, (pis[1]*mus[1]*mus[1] + pis[2]*mus[2]*mus[2] + pis[3]*mus[3]*mus[3])"
    " - pow(pis[1]*mus[1] + pis[2]*mus[2] + pis[3]*mus[3], 2))"
)
BCE_SQL = "greatest(mus[{0}], 0.0) - mus[{0}] * y + ln(1.0 + exp(-abs(mus[{0}])))"
NLL_SQL = "-ln(" + " + ".join(f"exp(ln(pis[{k}] + 1e-8) - ({BCE_SQL.format(k)}))" for k in (1, 2, 3)) + ")"


def over_logits(key: str, spark_column, sql_expr: str):
    """The same for an expression of one logit, applied to all three."""
    values = ", ".join(f"{q6(sql_expr.format(k))} AS value{k}" for k in (1, 2, 3))

    @query(key, with_preds(f"SELECT vec_id, {values} FROM preds"))
    def run(spark, sf_dir):
        found = [r6(spark_column(F.col("mus")[k - 1]), f"value{k}") for k in (1, 2, 3)]
        return inputs.preds(spark, sf_dir).select("vec_id", *found)


over_logits("sigmoid", mx.sigmoid, SIG.replace("{}", "mus[{0}]"))
over_logits("bce_with_logits", lambda mu: mx.bce_with_logits(mu, F.col("y")), BCE_SQL)
over_preds("log_sum_exp", lambda: mx.log_sum_exp(F.col("mus")), "ln(exp(mus[1]) + exp(mus[2]) + exp(mus[3]))")
over_preds("mixture_probability", lambda: mx.mixture_probability(F.col("pis"), F.col("mus")), P_SQL)
over_preds(
    "predictive_entropy",
    lambda: mx.predictive_entropy(F.col("pis"), F.col("mus")),
    f"-({CLAMPED} * log2({CLAMPED}) + (1.0 - {CLAMPED}) * log2(1.0 - {CLAMPED}))",
)
over_preds("logit_variance", lambda: mx.logit_variance(F.col("pis"), F.col("mus")), VAR_SQL)


@query("softmax", with_preds("s AS (SELECT vec_id, mus, exp(mus[1]) + exp(mus[2]) + exp(mus[3]) AS z FROM preds) SELECT vec_id, "
       + ", ".join(f"{q6(f'exp(mus[{k}]) / z')} AS w{k}" for k in (1, 2, 3)) + " FROM s"))
def softmax(spark, sf_dir):
    weights = mx.softmax(F.col("mus"))
    return inputs.preds(spark, sf_dir).select(
        "vec_id", *[r6(F.get(weights, F.lit(k - 1)), f"w{k}") for k in (1, 2, 3)]
    )


@query("euclidean_distance", """SELECT CAST(vec_id AS BIGINT) AS vec_id,
  (round(sqrt(list_sum(list_transform(range(1, 33), lambda i:
    pow(CAST(embedding[i] AS DOUBLE) - CAST(embedding[i + 32] AS DOUBLE), 2)))), 6) + 0) AS value FROM embeddings""")
def euclidean_distance(spark, sf_dir):
    vector = F.col("embedding").cast("array<double>")
    halves = F.slice(vector, 1, 32), F.slice(vector, 33, 32)
    return inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), r6(mx.euclidean_distance(*halves), "value")
    )


@query("content_key", with_stay("""n AS (SELECT pid % 10 AS grp, 'p' || pid || '.psv' AS name FROM stay),
p AS (SELECT grp, md5(array_to_string(list_sort(list(name)), ',')) AS digest FROM (SELECT DISTINCT grp, name FROM n) GROUP BY grp, left(md5(name), 4))
SELECT grp, md5(array_to_string(list_sort(list(digest)), ',')) AS key FROM p GROUP BY grp"""))
def content_key(spark, sf_dir):
    name = F.concat(F.lit("p"), F.col("pid").cast("string"), F.lit(".psv"))
    names = inputs.stay(spark, sf_dir).select((F.col("pid") % 10).alias("grp"), name.alias("name"))
    return hashing.content_keys(names, ["grp"], "name")


# --- metrics -----------------------------------------------------------------

LOGITS = {"anyv": "(coalesce(anyv, 0.0D) - 50) / 50", "click": "(coalesce(click, 0.0D) - 40) / 25",
          "engage": "(coalesce(engage, 0.0D) - 40) / 25"}

MODELS = f"""{TARGETS}, pr AS (""" + " UNION ALL ".join(
    f"""SELECT {i} AS model_ord, '{m}' AS model, pid, t, y AS y_now, y_target, valid,
        1.0 / (1.0 + exp(-({e.replace('0.0D', '0.0')}))) AS score FROM tg"""
    for i, (m, e) in enumerate(LOGITS.items())
) + """), ok AS (SELECT model_ord, model, y_target AS y, round(score, 9) AS score,
       CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM pr WHERE valid)"""

METRIC_SQL = f"""mt AS (
  SELECT model_ord, model, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn
  FROM ok GROUP BY 1, 2),
me AS (SELECT model_ord, model, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM mt)"""

AUC_SQL = """rk AS (SELECT model_ord, model, y, rank() OVER (PARTITION BY model ORDER BY score)
    + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM ok),
au AS (SELECT model_ord, model, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc
       FROM rk GROUP BY 1, 2)"""


def scored(spark, sf_dir):
    """(model_ord, model, y, score, pred) of three fixed scores on valid rows."""
    rows = sq.horizon_target(inputs.stay(spark, sf_dir), HORIZON).filter("valid")
    each = F.array(
        *[F.struct(F.lit(i).alias("model_ord"), F.lit(m).alias("model"),
                   mx.sigmoid(F.expr(e)).alias("p")) for i, (m, e) in enumerate(LOGITS.items())]
    )
    return rows.select(F.col("y_target").alias("y"), F.inline(each)).select(
        "model_ord", "model", "y", F.round("p", 9).alias("score"),
        F.when(F.col("p") > 0.5, 1).otherwise(0).alias("pred"),
    )


def one_score(spark, sf_dir):
    """A fixed logit on every row, with its loss: input of the transition metrics."""
    rows = sq.horizon_target(inputs.stay(spark, sf_dir), HORIZON)
    logit = (F.col("anyv") - 50) / 50
    return rows.withColumns(
        {"probability": mx.sigmoid(logit), "nll": mx.bce_with_logits(logit, F.col("y_target"))}
    )


METRICS = ["accuracy", "precision", "recall", "f1"]


@query("classification_metrics", with_stay(f"{MODELS}, {METRIC_SQL} SELECT model, "
       + ", ".join(f"{q6(m)} AS {m}" for m in METRICS) + " FROM me"))
def classification_metrics(spark, sf_dir):
    found = ev.classification_metrics(scored(spark, sf_dir), ["model"])
    return found.select("model", *[r6(m) for m in METRICS])


@query("confusion_matrix", with_stay(f"""{MODELS}
SELECT model, CAST(y AS INTEGER) AS label, CAST(count(*) FILTER (pred = 0) AS BIGINT) AS pred_0, CAST(count(*) FILTER (pred = 1) AS BIGINT) AS pred_1
FROM ok GROUP BY model, y"""))
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(scored(spark, sf_dir), by=["model"])


@query("roc_auc", with_stay(f"{MODELS}, {AUC_SQL} SELECT model, {q6('auc')} AS auc FROM au"))
def roc_auc(spark, sf_dir):
    return ev.roc_auc(scored(spark, sf_dir), ["model"]).select("model", r6("auc"))


@query("model_leaderboard", with_stay(f"""{MODELS}, {METRIC_SQL}, {AUC_SQL},
lb AS (SELECT me.*, round(auc, 6) AS auc FROM me JOIN au USING (model))
SELECT model, {", ".join(f"{q6(m)} AS {m}" for m in METRICS)}, auc + 0 AS auc,
       CAST(row_number() OVER (ORDER BY auc DESC, model_ord) = 1 AS INTEGER) AS is_best FROM lb"""))
def model_leaderboard(spark, sf_dir):
    table = ev.leaderboard(scored(spark, sf_dir))
    return table.select("model", *[r6(m) for m in METRICS], r6("auc"), F.col("is_best").cast("int").alias("is_best"))


@query("mixture_nll", with_preds(f"SELECT {q6(f'avg({NLL_SQL})')} AS nll FROM preds"))
def mixture_nll(spark, sf_dir):
    return ev.mixture_loss(inputs.preds(spark, sf_dir)).select(r6("nll"))


@query("uncertainty_summary", with_preds(f"""v AS (SELECT {VAR_SQL} AS v FROM preds),
b AS (SELECT CASE WHEN v >= 20 THEN 11 ELSE CAST(floor(v / 2.0) AS INTEGER) + 1 END AS bin FROM v)
SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, (SELECT {q6('avg(v)')} FROM v) AS mean_variance
FROM b GROUP BY bin"""))
def uncertainty_summary(spark, sf_dir):
    found = ev.uncertainty_summary(inputs.preds(spark, sf_dir), 0, 20, 10)
    return found.select("bin", "n", r6("mean_variance"))


SCORED_SQL = f"""{TARGETS}, sc AS (
  SELECT *, 1.0 / (1.0 + exp(-((anyv - 50) / 50))) AS p,
         greatest((anyv - 50) / 50, 0.0) - (anyv - 50) / 50 * y_target + ln(1.0 + exp(-abs((anyv - 50) / 50))) AS nll,
         y = 0 AND y_target = 1 AND valid AS moved FROM tg)"""


@query("transition_recall", with_stay(f"""{SCORED_SQL}
SELECT CAST(count(*) FILTER (moved) AS BIGINT) AS transitions,
       {q6('count(*) FILTER (moved AND p > 0.5) / nullif(count(*) FILTER (moved), 0)')} AS recall FROM sc"""))
def transition_recall(spark, sf_dir):
    return ev.transition_recall(one_score(spark, sf_dir)).select("transitions", r6("recall"))


@query("transition_weighted_loss", with_stay(f"""{SCORED_SQL}
SELECT {q6('avg(nll) + 3.0 * coalesce(avg(nll) FILTER (moved), 0)')} AS added,
       {q6('avg(nll * CASE WHEN moved THEN 3.0 ELSE 1.0 END)')} AS scaled FROM sc WHERE valid"""))
def transition_weighted_loss(spark, sf_dir):
    return ev.transition_weighted_loss(one_score(spark, sf_dir), 3.0).select(r6("added"), r6("scaled"))


@query("masked_reconstruction_error", with_stay("""m AS (SELECT """ + ", ".join(f"avg({f}) AS m_{f}" for f in sql.FEATURES) + """ FROM stay)
SELECT """ + q6("sum(" + " + ".join(f"coalesce(pow(m_{f} - {f}, 2), 0)" for f in sql.FEATURES) + ") / ("
       + " + ".join(f"count({f})" for f in sql.FEATURES) + ")") + " AS error FROM stay, m"))
def masked_reconstruction_error(spark, sf_dir):
    """Error of mean imputation over all observed cells."""
    chart = inputs.stay(spark, sf_dir)
    means = tb.one_row(tb.column_means(chart, sql.FEATURES))
    rows = chart.withColumn("_m", means)
    triples = [
        (F.coalesce(f"_m.{f}", F.lit(0.0)), F.coalesce(f, F.lit(0.0)), F.col(f).isNotNull().cast("int"))
        for f in sql.FEATURES
    ]
    return ev.masked_reconstruction_error(rows, triples).select(r6("error"))


@query("class_distribution", with_stay("SELECT y, CAST(count(*) AS BIGINT) AS n FROM stay GROUP BY y"))
def class_distribution(spark, sf_dir):
    return fq.class_distribution(inputs.stay(spark, sf_dir), ["y"])
