"""Tabular preparation, neighbours, rebalancing and classifiers."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame, functions as F

from bedside.operators import boosting as bo
from bedside.operators import calibration as cb
from bedside.operators import evaluation as ev
from bedside.operators import frequency as fq
from bedside.operators import lsh
from bedside.operators import models as md
from bedside.operators import neighbours as nb
from bedside.operators import rebalance as rb
from bedside.operators import tabular as tb
from bedside.plans import inputs, sql
from bedside.plans.registry import q6, query, r6
from bedside.plans.sql import POINTS, SPLIT, d2, uniform, with_stay
from bedside.session import cut

FEATURES = inputs.POINT_FEATURES
RADIUS = 1.0
DETECTORS = 10000


def listed(prefix: str = "", template: str = "{q} AS {f}") -> str:
    return ", ".join(template.format(q=q6(prefix + f), f=f) for f in FEATURES)


# --- preparation -------------------------------------------------------------


@query("mean_impute", with_stay(f"{SPLIT} SELECT pid, t, {listed()} FROM imputed"))
def mean_impute(spark, sf_dir):
    filled = tb.mean_impute(inputs.stay(spark, sf_dir), FEATURES)
    return filled.select("pid", "t", *[r6(f) for f in FEATURES])


@query("stratified_split", with_stay(f"{SPLIT} SELECT pid, t, y, CAST(is_test AS INTEGER) AS is_test FROM split"))
def stratified_split(spark, sf_dir):
    split = tb.stratified_split(inputs.stay(spark, sf_dir), "y", [F.col("pid"), F.col("t")])
    return split.select("pid", "t", "y", F.col("is_test").cast("int").alias("is_test"))


@query("standard_scale", with_stay(f"{POINTS} SELECT id, CAST(is_test AS INTEGER) AS is_test, {listed()} FROM points"))
def standard_scale(spark, sf_dir):
    points = inputs.build_points(inputs.stay(spark, sf_dir))
    return points.select("id", F.col("is_test").cast("int").alias("is_test"), *FEATURES)


@query("scale_pos_weight", with_stay(f"""{POINTS}
SELECT CAST(sum(1 - y) AS BIGINT) AS negatives, CAST(sum(y) AS BIGINT) AS positives,
       {q6('coalesce(sum(1 - y) / nullif(sum(y), 0), 1.0)')} AS scale_pos_weight FROM train"""))
def scale_pos_weight(spark, sf_dir):
    train, _ = inputs.train_test(spark, sf_dir)
    return tb.scale_pos_weight(train).select("negatives", "positives", r6("scale_pos_weight"))


@query("union_by_name", with_stay(f"""SELECT pid, t, {q6('click')} AS click, {q6('anyv')} AS anyv, y FROM stay WHERE pid % 2 = 0
UNION ALL SELECT pid, t, NULL, {q6('anyv')}, y FROM stay WHERE pid % 2 = 1"""))
def union_by_name(spark, sf_dir):
    chart = inputs.stay(spark, sf_dir)
    one = chart.filter("pid % 2 = 0").select("pid", "t", r6("click"), r6("anyv"), "y")
    other = chart.filter("pid % 2 = 1").select("y", "t", r6("anyv"), "pid")
    return one.unionByName(other, allowMissingColumns=True)


# --- radius joins and detectors ----------------------------------------------

BOUNDS = f"""bounds AS (SELECT {", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES)} FROM train)"""


def candidates_sql(n: int) -> str:
    columns = ", ".join(
        f"round(lo_{f} + " + uniform(f"det_id || '|{f}|42'") + f" * (hi_{f} - lo_{f}), 6) + 0 AS {f}"
        for f in FEATURES
    )
    return f"""{BOUNDS}, cand AS MATERIALIZED (SELECT det_id, {columns}
  FROM (SELECT unnest(range({n})) AS det_id), bounds),
kept AS MATERIALIZED (SELECT * FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM train s WHERE s.y = 0 AND {d2('c', 's')} <= {RADIUS * RADIUS}))"""


# The operator draws until it has enough; the text draws four times as many as it
# asks for, and would count too few if that were not enough.
ROUND = 16384
DETECTOR_SQL = f"""{candidates_sql(4 * DETECTORS)},
numbered AS (SELECT *, row_number() OVER (ORDER BY det_id) AS n,
                    det_id - coalesce(lag(det_id) OVER (ORDER BY det_id), -1) AS gap FROM kept),
ruled AS (SELECT *, max(gap) OVER (ORDER BY det_id ROWS UNBOUNDED PRECEDING) AS worst FROM numbered),
dets AS MATERIALIZED (SELECT det_id, {", ".join(FEATURES)} FROM ruled WHERE worst <= 1000 AND n <= {DETECTORS})"""


def detectors_of(spark, sf_dir):
    train, _ = inputs.train_test(spark, sf_dir)
    return rb.nsa_detectors(
        train, FEATURES, RADIUS, DETECTORS, round_size=ROUND
    )


@query("feature_bounds", with_stay(f"{POINTS}, long AS ({sql.long_form('train', FEATURES, 'id')}) "
       "SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature"))
def feature_bounds(spark, sf_dir):
    return rb.feature_bounds(inputs.train_test(spark, sf_dir)[0], FEATURES)


@query("radius_anti_join", with_stay(f"{POINTS}, {candidates_sql(ROUND)} SELECT det_id, {', '.join(FEATURES)} FROM kept"))
def radius_anti_join(spark, sf_dir):
    train, _ = inputs.train_test(spark, sf_dir)
    bounds = [(r["feature"], r["lo"], r["hi"]) for r in rb.feature_bounds(train, FEATURES).collect()]
    drawn = rb.candidates(bounds, spark, 0, ROUND, "42")
    return nb.radius_anti_join(drawn, train.filter("y = 0"), FEATURES, RADIUS).select(
        "det_id", *FEATURES
    )


@query("nsa_detectors", with_stay(f"{POINTS}, {DETECTOR_SQL} SELECT det_id, {', '.join(FEATURES)} FROM dets"))
def nsa_detectors(spark, sf_dir):
    return detectors_of(spark, sf_dir).select("det_id", *FEATURES)


@query("radius_semi_join", with_stay(f"""{POINTS}, {DETECTOR_SQL}
SELECT id, CAST(EXISTS (SELECT 1 FROM dets d WHERE {d2('test', 'd')} <= {RADIUS * RADIUS}) AS INTEGER) AS flag FROM test"""))
def radius_semi_join(spark, sf_dir):
    _, test = inputs.train_test(spark, sf_dir)
    return nb.radius_flag(test, detectors_of(spark, sf_dir), FEATURES, RADIUS).select("id", "flag")


@query("nsa_classify", with_stay(f"""{POINTS}, {DETECTOR_SQL}, fl AS (
  SELECT y, EXISTS (SELECT 1 FROM dets d WHERE {d2('test', 'd')} <= {RADIUS * RADIUS}) AS p FROM test),
c AS (SELECT count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y = 0 AND p) AS fp,
             count(*) FILTER (y = 1 AND NOT p) AS fn, count(*) FILTER (y = 0 AND NOT p) AS tn FROM fl)
SELECT 'negative selection' AS model, {q6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy,
       {q6('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision, {q6('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall,
       {q6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1 FROM c"""))
def nsa_classify(spark, sf_dir):
    train, test = inputs.train_test(spark, sf_dir)
    metrics, _ = rb.nsa_classify(
        train, test, FEATURES, RADIUS, num_detectors=DETECTORS, round_size=ROUND
    )
    return metrics.select("model", *[r6(m) for m in ("accuracy", "precision", "recall", "f1")])


@query("augment_union", with_stay(f"""{POINTS}, {DETECTOR_SQL}
SELECT id, y, {listed()} FROM train UNION ALL SELECT 'detector:' || det_id, 1, {listed()} FROM dets"""))
def augment_union(spark, sf_dir):
    train, _ = inputs.train_test(spark, sf_dir)
    return rb.augment_union(train, detectors_of(spark, sf_dir), FEATURES)


# --- neighbours and SMOTE ----------------------------------------------------


@query("knn_classify", with_stay(f"""{POINTS}, n AS (
  SELECT q.id, min({{'d': {d2('q', 's')}, 'id': s.id, 'y': s.y}}, 5) AS near FROM test q, train s GROUP BY q.id)
SELECT id, {q6("list_avg(list_transform(near, lambda z: z.y))")} AS score,
       CAST(list_sum(list_transform(near, lambda z: z.y)) > 2 AS INTEGER) AS pred FROM n"""))
def knn_classify(spark, sf_dir):
    train, test = inputs.train_test(spark, sf_dir)
    return nb.knn_classify(test, train, FEATURES).select("id", r6("score"), "pred")


@query("neighbour_recall")
def neighbour_recall(spark, sf_dir):
    """Recall of the approximate search at 5 neighbours: the test rows of patients whose
    number is divisible by 50 against all training rows."""
    train, test = inputs.train_test(spark, sf_dir)
    asked = cut(test.filter(F.substring_index("id", ":", 1).cast("long") % 50 == 0), "asked")
    found = lsh.approximate_nearest(asked, train, FEATURES, 5)
    return lsh.recall(found, nb.nearest(asked, train, FEATURES, 5), FEATURES)


SMOTE_SQL = f"""small AS (SELECT CASE WHEN sum(y) <= sum(1 - y) THEN 1 ELSE 0 END AS label FROM train),
mi AS MATERIALIZED (SELECT train.* FROM train, small WHERE y = label),
need AS (SELECT abs(sum(1 - y) - sum(y)) AS need, least(sum(y), sum(1 - y)) AS few FROM train),
nn AS MATERIALIZED (SELECT q.id, min({{'d': {d2('q', 's')}, 'id': s.id}}, 6) AS near FROM mi q, mi s GROUP BY q.id),
lists AS (SELECT id, list_filter(near, lambda z: z.id <> id)[1:5] AS near FROM nn),
base AS (SELECT mi.*, need // few + CASE WHEN row_number() OVER (ORDER BY md5(id || '|copy|42')) <= need % few THEN 1 ELSE 0 END AS copies
         FROM mi, need),
spread AS (SELECT b.*, l.near, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM base b JOIN lists l USING (id)),
pick AS (SELECT *, near[CAST(floor({uniform("id || '|' || copy || '|pick|42'")} * len(near)) AS BIGINT) + 1].id AS neighbour,
                {uniform("id || '|' || copy || '|gap|42'")} AS gap FROM spread),
made AS (SELECT p.id AS parent, CAST(p.copy AS INTEGER) AS copy, neighbour, {", ".join(f"p.{f} + gap * (o.{f} - p.{f}) AS {f}" for f in FEATURES)}
         FROM pick p JOIN mi o ON o.id = p.neighbour)"""


def smote_of(train):
    return rb.smote(train, FEATURES).select("parent", "copy", "neighbour", "y", *[r6(f) for f in FEATURES])


@query("smote", with_stay(f"{POINTS}, {SMOTE_SQL} SELECT parent, copy, neighbour, label AS y, {listed()} FROM made, small"))
def smote(spark, sf_dir):
    return smote_of(inputs.train_test(spark, sf_dir)[0])


# The same with the classes exchanged, so that class 1 is the larger one.
TURNED = POINTS.replace("SELECT * FROM points WHERE NOT is_test", "SELECT * REPLACE (1 - y AS y) FROM points WHERE NOT is_test")


@query("smote_larger_positive", with_stay(f"{TURNED}, {SMOTE_SQL} SELECT parent, copy, neighbour, label AS y, {listed()} FROM made, small"))
def smote_larger_positive(spark, sf_dir):
    train, _ = inputs.train_test(spark, sf_dir)
    return smote_of(train.withColumn("y", 1 - F.col("y")))


@query("smote_balance", with_stay(f"""{POINTS}, n AS (SELECT count(*) FILTER (y = 0) AS many, count(*) FILTER (y = 1) AS few FROM train)
SELECT CAST(many AS BIGINT) AS negatives, CAST(many AS BIGINT) AS positives, CAST(many - few AS BIGINT) AS made,
       CAST(0 AS BIGINT) AS outside FROM n"""))
def smote_balance(spark, sf_dir):
    """Invariants: equal class counts, every made row between its parents."""
    train, _ = inputs.train_test(spark, sf_dir)
    made = rb.smote(train, FEATURES)
    ends = train.filter("y = 1")
    a = ends.select(F.col("id").alias("parent"), *[F.col(f).alias(f"a_{f}") for f in FEATURES])
    b = ends.select(F.col("id").alias("neighbour"), *[F.col(f).alias(f"b_{f}") for f in FEATURES])
    off = F.lit(False)
    for f in FEATURES:
        low, high = F.least(f"a_{f}", f"b_{f}"), F.greatest(f"a_{f}", f"b_{f}")
        off = off | (F.col(f) < low - 1e-9) | (F.col(f) > high + 1e-9)
    checked = made.join(a, "parent").join(b, "neighbour").agg(
        F.count(F.lit(1)).alias("made"), F.count(F.when(off, 1)).alias("outside")
    )
    sizes = tb.one_row(train.agg(
        F.count(F.when(F.col("y") == 0, 1)).alias("many"), F.count(F.when(F.col("y") == 1, 1)).alias("few")
    ))
    return checked.withColumn("_n", sizes).select(
        F.col("_n.many").alias("negatives"), (F.col("_n.few") + F.col("made")).alias("positives"),
        "made", "outside",
    )


@query("class_distribution_split", with_stay(f"""{POINTS}
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, y, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1, 2"""))
def class_distribution_split(spark, sf_dir):
    part = F.when(F.col("is_test"), "test").otherwise("train")
    return fq.class_distribution(inputs.points(spark, sf_dir).withColumn("part", part), ["part", "y"])


# --- classifiers -------------------------------------------------------------

# What SQL can say of the result of a classifier it cannot fit: which rows were scored,
# that the metrics are those of the confusion counts, and that the area shows the signal
# of the rows. ``classifier_report`` has the metrics themselves.
SCORED_ROWS = "CAST((SELECT count(*) FROM test) AS BIGINT) AS test_rows, CAST((SELECT sum(y) FROM test) AS BIGINT) AS positives, 1 AS consistent, 1 AS signal"


def checked(by_model):
    """(model, test_rows, positives, consistent, signal) of predictions by model."""
    rows = [df.select(F.lit(name).alias("model"), "y", "pred") for name, df in by_model.items()]
    counts = ev.confusion_matrix(reduce(DataFrame.unionByName, rows), by=["model"]).groupBy("model").agg(
        *[F.max(F.when(F.col("label") == i, F.col(f"pred_{j}"))).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)]
    )
    fn, fp, tn, tp = (F.col(c) for c in ("c10", "c01", "c00", "c11"))
    n = tn + fp + fn + tp

    def same(metric, top, bottom):
        return F.abs(F.col(metric) - F.coalesce(F.try_divide(top, bottom), F.lit(0.0))) < 1e-9

    agrees = (
        same("accuracy", tp + tn, n) & same("precision", tp, tp + fp)
        & same("recall", tp, tp + fn) & same("f1", 2 * tp, 2 * tp + fp + fn)
    )
    return md.metrics_of(by_model).join(cut(counts, "counts"), "model").select(
        "model", n.alias("test_rows"), (fn + tp).alias("positives"),
        agrees.cast("int").alias("consistent"), (F.col("auc") > 0.5).cast("int").alias("signal"),
    )


def single_model(name: str):
    @query(name, with_stay(f"{POINTS} SELECT '{name}' AS model, {SCORED_ROWS}"))
    def run(spark, sf_dir):
        train, test = inputs.train_test(spark, sf_dir)
        return checked({name: md.predictions(md.fit(name, train, FEATURES), test, FEATURES)})


for _name in ("decision_tree", "random_forest", "gradient_boosting", "linear_svm"):
    single_model(_name)


@query("logistic_regression", with_stay(f"{POINTS} SELECT 'logistic_regression' AS model, {SCORED_ROWS}, 1 AS converged"))
def logistic_regression(spark, sf_dir):
    """With a check that the gradient vanishes at the solution."""
    train, test = inputs.train_test(spark, sf_dir)
    model = md.fit("logistic_regression", train, FEATURES)
    found = checked({"logistic_regression": md.predictions(model, test, FEATURES)})
    return found.withColumn("converged", F.lit(int(md.largest_gradient(model, train, FEATURES) < 1e-4)))


# Class means and variances, the log likelihoods and the probability they give, and the
# metrics and area of it. The library adds a billionth of the largest variance.
_GAUSS = " + ".join(f"ln(v_{f}) + (t.{f} - m_{f}) * (t.{f} - m_{f}) / v_{f}" for f in FEATURES)
GAUSSIAN_SQL = f"""long AS ({sql.long_form('train', FEATURES, 'y')}),
widest AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(value) AS v FROM long GROUP BY feature)),
classes AS (SELECT y AS label, ln(count(*) / (SELECT count(*) FROM train)) AS prior,
  {", ".join(f"avg({f}) AS m_{f}, var_pop({f}) + max(e) AS v_{f}" for f in FEATURES)} FROM train, widest GROUP BY y),
like_ AS (SELECT t.id, t.y, c.label, c.prior - 0.5 * ({_GAUSS}) AS l FROM test t, classes c),
scored AS (SELECT id, y, round(1 / (1 + exp(max(l) FILTER (label = 0) - max(l) FILTER (label = 1))), 9) AS score FROM like_ GROUP BY id, y),
c AS (SELECT count(*) FILTER (y = 1 AND score > 0.5) AS tp, count(*) FILTER (y = 0 AND score > 0.5) AS fp,
             count(*) FILTER (y = 1 AND score <= 0.5) AS fn, count(*) FILTER (y = 0 AND score <= 0.5) AS tn FROM scored),
ranks AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored),
area AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM ranks)
SELECT CAST(y AS INTEGER) AS label, feature, {q6('avg(value)')} AS mean, round(var_pop(value), 5) AS variance, tn, fp, fn, tp,
  {q6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {q6('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision,
  {q6('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall, {q6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1,
  round(coalesce(auc, 0.0), 5) AS auc
FROM long, c, area GROUP BY ALL"""


@query("gaussian_nb", with_stay(f"{POINTS}, {GAUSSIAN_SQL}"))
def gaussian_nb(spark, sf_dir):
    """Class means and variances as learned, with confusion counts, metrics and
    area of the predictions."""
    train, test = inputs.train_test(spark, sf_dir)
    model = md.fit("gaussian_nb", train, FEATURES)
    scored = md.predictions(model, test, FEATURES).withColumn("model", F.lit("gaussian_nb"))
    counts = ev.confusion_matrix(scored).agg(*[
        F.max(F.when(F.col("label") == i, F.col(f"pred_{j}"))).alias(name)
        for name, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ])
    metrics = md.metrics_of({"gaussian_nb": scored}).select(
        *[r6(m) for m in ("accuracy", "precision", "recall", "f1")], F.round("auc", 5).alias("auc")
    )
    classes = md.gaussian_classes(model, FEATURES, spark)
    classes = classes.withColumn("_c", tb.one_row(counts)).withColumn("_m", tb.one_row(metrics))
    return classes.select("label", "feature", r6("mean"), F.round("variance", 5).alias("variance"), "_c.*", "_m.*")


@query("svm_probabilities")
def svm_probabilities(spark, sf_dir):
    """Predicted and found share of positives by bins of the probability that a linear
    SVM gives after calibration."""
    train, test = inputs.train_test(spark, sf_dir)
    return cb.calibration_bins(cb.calibrated_predictions("linear_svm", train, test, FEATURES))


@query("classifier_report")
def classifier_report(spark, sf_dir):
    """Metrics of every classifier on the same rows; a row with its message for each
    that failed."""
    train, test = inputs.train_test(spark, sf_dir)
    return md.compare_classifiers(train, test, FEATURES)


@query("boosting_with_missing", with_stay(f"{POINTS} SELECT 'boosting_with_missing' AS model, {SCORED_ROWS}"))
def boosting_with_missing(spark, sf_dir):
    train, test = missing_train_test(spark, sf_dir)
    return checked({"boosting_with_missing": bo.predictions(bo.fit(train, inputs.STAY_FEATURES), test)})


def missing_train_test(spark, sf_dir):
    """Rows of the chart with their missing cells, split by class."""
    chart = inputs.stay(spark, sf_dir)
    rows = cut(tb.stratified_split(chart, "y", [F.col("pid"), F.col("t")]).withColumn("id", inputs.row_key()), "split")
    return rows.filter("NOT is_test"), rows.filter("is_test")


_LONG_ORDER = " UNION ALL ".join(
    f"SELECT y, {i} AS i, '{f}' AS feature, {f} AS value FROM tr" for i, f in enumerate(inputs.STAY_FEATURES)
)
FIRST_SPLIT_SQL = f"""tr AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(pid || '|' || t || '|42')) <= ceil(0.25 * count(*) OVER (PARTITION BY y)) AS is_test
  FROM stay) WHERE NOT is_test),
ratio AS (SELECT coalesce(sum(1 - y) / nullif(sum(y), 0), 1.0) AS w FROM tr),
long AS ({_LONG_ORDER}),
borders AS (SELECT feature, list_distinct(list_transform(quantile_cont(value, [{", ".join(str(i / 16) for i in range(1, 16))}]), lambda q: round(q, 6))) AS cuts
  FROM long WHERE value IS NOT NULL GROUP BY feature),
cells AS (SELECT feature, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(coalesce(cuts, []), lambda c: value > c)) END AS bin,
  CASE WHEN y = 1 THEN w ELSE 1.0 END AS w, y FROM long LEFT JOIN borders USING (feature), ratio),
sums AS (SELECT feature, bin, sum(w * (0.5 - y)) AS g, sum(w * 0.25) AS h FROM cells GROUP BY ALL),
run AS (SELECT feature, bin,
  sum(CASE WHEN bin >= 0 THEN g END) OVER up AS gu, sum(CASE WHEN bin >= 0 THEN h END) OVER up AS hu,
  coalesce(sum(CASE WHEN bin < 0 THEN g END) OVER own, 0) AS g0, coalesce(sum(CASE WHEN bin < 0 THEN h END) OVER own, 0) AS h0,
  sum(g) OVER own AS ga, sum(h) OVER own AS ha
  FROM sums WINDOW own AS (PARTITION BY feature), up AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
sides AS (SELECT feature, bin, m AS missing_left, gu + m * g0 AS gl, hu + m * h0 AS hl, ga, ha FROM run, (VALUES (0), (1)) AS s(m) WHERE bin >= 0)
SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(missing_left AS INTEGER) AS missing_left,
  {q6('gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)')} AS gain
FROM sides WHERE hl >= 1 AND ha - hl >= 1"""


@query("missing_split_gains", with_stay(FIRST_SPLIT_SQL))
def missing_split_gains(spark, sf_dir):
    """Gain of every first split of the boosted trees, missing cells on either side."""
    features = inputs.STAY_FEATURES
    train, _ = missing_train_test(spark, sf_dir)
    rows = bo.training_rows(train, features, bo.bin_borders(train, features, 16))
    first = bo.with_gradients(rows, F.lit(0.0)).withColumn("node", F.lit(1))
    names = F.array(*[F.lit(f) for f in features])
    return bo.split_gains(bo.histograms(first, len(features))).select(
        F.get(names, F.col("feature")).alias("feature"), "bin", F.col("missing_left").cast("int").alias("missing_left"), r6("gain")
    )


@query("tabular_classification", with_stay(f"""{POINTS}, {DETECTOR_SQL},
size AS (SELECT greatest(count(*) FILTER (y = 0), count(*) FILTER (y = 1) + (SELECT count(*) FROM dets)) AS n FROM train)
SELECT unnest([{", ".join(f"'{m}'" for m in [*md.CLASSIFIERS, "knn"])}]) AS model,
       CAST((SELECT count(*) FROM test) AS BIGINT) AS test_rows, CAST((SELECT sum(y) FROM test) AS BIGINT) AS positives,
       1 AS consistent, CAST(n AS BIGINT) AS train_negatives, CAST(n AS BIGINT) AS train_positives, CAST(NULL AS VARCHAR) AS error FROM size"""))
def tabular_classification(spark, sf_dir):
    """Detectors join the training rows, SMOTE balances them, then all classifiers
    are compared on the untouched test rows."""
    train, test = inputs.train_test(spark, sf_dir)
    augmented = cut(rb.augment_union(train, detectors_of(spark, sf_dir), FEATURES), "augmented")
    final = cut(rb.balanced(augmented, FEATURES), "final")
    sizes = tb.one_row(final.agg(F.sum(1 - F.col("y")).alias("zeros"), F.sum("y").alias("ones")))
    done, failed = md.all_predictions(final, test, FEATURES)
    return with_errors(checked(done).drop("signal"), failed).withColumn("_n", sizes).select(
        "model", "test_rows", "positives", "consistent",
        F.col("_n.zeros").alias("train_negatives"), F.col("_n.ones").alias("train_positives"), "error",
    )


def with_errors(found: DataFrame, failed: dict[str, str]) -> DataFrame:
    """A row with ``error`` for each classifier that failed."""
    broken = found.sparkSession.createDataFrame(list(failed.items()), "model string, error string")
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)


@query("projection_2d", with_stay(f"""{POINTS}
SELECT CAST(count(*) AS BIGINT) AS rows, round({" + ".join(f"var_samp({f})" for f in FEATURES)}, 5) AS total_variance,
       1 AS ordered, 1 AS uncorrelated, 1 AS same_plane FROM points"""))
def projection_2d(spark, sf_dir):
    """Checks of the projection: all components together keep the total variance,
    variances fall, components do not covary, and the two are the first two."""
    points = inputs.points(spark, sf_dir)
    names = [f"pc{i + 1}" for i in range(len(FEATURES))]
    every = md.project(points, FEATURES, len(FEATURES)).drop("y")
    two = md.projection_2d(points, FEATURES).select("id", F.col("pc1").alias("a"), F.col("pc2").alias("b"))
    spread = [F.var_samp(n) for n in names]
    falling = reduce(and_, [a >= b - 1e-9 for a, b in zip(spread, spread[1:])])
    apart = reduce(and_, [
        F.abs(F.covar_samp(a, b)) < 1e-6 for i, a in enumerate(names) for b in names[i + 1 :]
    ])
    off = F.greatest(F.abs(F.abs("a") - F.abs("pc1")), F.abs(F.abs("b") - F.abs("pc2")))
    return every.join(two, "id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(reduce(add, spread), 5).alias("total_variance"),
        falling.cast("int").alias("ordered"), apart.cast("int").alias("uncorrelated"),
        (F.max(off) < 1e-6).cast("int").alias("same_plane"),
    )
