"""Which missing measurement would be worth taking: how much observing it would
lower the entropy of the prediction.

A scorer is a function from the columns of one row to ``(pis, mus)``. All
what-if values of a cell are scored inside one row, so ranking cells needs no
shuffle after the time steps are chosen.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.hashing import hash_text, hash_uniform
from bedside.functions.mixture import logit_variance, predictive_entropy
from bedside.operators.models import assemble
from bedside.operators.neighbours import hand_back, nearest
from bedside.operators.ranking import exact_quantiles
from bedside.session import cut

# What-if values: the mean and one deviation to either side, in normalised units.
SAMPLES = (0.0, 1.0, -1.0)

Scorer = Callable[[dict[str, Column]], tuple[Column, Column]]


def row_columns(features: list[str]) -> dict[str, Column]:
    return {f"{p}_{f}": F.col(f"{p}_{f}") for p in ("x", "m", "d") for f in features}


def linear_scorer(models: list[dict[str, float]]) -> Scorer:
    """Equal-weight mixture of logistic models; each maps column names and
    ``intercept`` to coefficients."""
    def score(columns: dict[str, Column]) -> tuple[Column, Column]:
        logits = [
            reduce(lambda a, b: a + b,
                   [columns[name] * F.lit(float(w)) for name, w in model.items() if name != "intercept"],
                   F.lit(float(model["intercept"])))
            for model in models
        ]
        return F.array(*[F.lit(1.0 / len(models))] * len(models)), F.array(*logits)

    return score


def fit_scorer(sequences: DataFrame, features: list[str], k: int = 3, seed: str = "42") -> Scorer:
    """``k`` logistic models of the target, each on its own hash part of the
    valid rows. Only coefficients come back to the driver."""
    names = list(row_columns(features))
    part = F.floor(hash_uniform(seed, F.col("pid")) * k)
    rows = assemble(
        sequences.filter("valid").select(*[F.col(n).cast("double").alias(n) for n in names],
                                         F.col("y_target").alias("y"), part.alias("part")),
        names,
    )
    models = []
    for i in range(k):
        fitted = LogisticRegression(labelCol="y", maxIter=50, regParam=0.01).fit(rows.filter(F.col("part") == i))
        models.append(dict(zip(names, map(float, fitted.coefficients))) | {"intercept": float(fitted.intercept)})
    return linear_scorer(models)


def with_scores(sequences: DataFrame, features: list[str], scorer: Scorer) -> DataFrame:
    """Add ``uncertainty`` (logit variance) and ``baseline`` (entropy)."""
    pis, mus = scorer(row_columns(features))
    return sequences.withColumns(
        {"uncertainty": logit_variance(pis, mus), "baseline": predictive_entropy(pis, mus)}
    )


def uncertainty_filter(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("uncertainty") >= threshold)


def choose_steps(scored: DataFrame, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """Steps that can still be predicted (``t <= length - 2``): those at or above
    the threshold if one is given, else the ``top_k`` most uncertain of each
    patient (earlier steps first on ties), else each patient's first step.

    The top-k filter runs before the shuffle as well, so a long patient sends
    only ``top_k`` rows per task.
    """
    able = scored.filter(F.col("t") < F.col("length") - 1)
    if threshold is not None:
        return uncertainty_filter(able, threshold)
    if top_k is None:
        return able.filter("t = 0")
    order = Window.partitionBy("pid").orderBy(F.desc("uncertainty"), "t")
    return able.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_k).drop("_n")


def missing_cells(steps: DataFrame, features: list[str]) -> DataFrame:
    """One row per missing feature of each chosen step, with the row's columns."""
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature_name"), F.lit(i).alias("feature_model_idx"),
                   F.col(f"m_{f}").alias("observed")) for i, f in enumerate(features)]
    )
    missing = F.filter(cells, lambda c: c["observed"] == 0)
    return steps.withColumn("_c", F.explode(missing)).withColumns(
        {"feature_name": F.col("_c.feature_name"), "feature_model_idx": F.col("_c.feature_model_idx")}
    ).drop("_c")


def what_if(features: list[str], value: Column) -> dict[str, Column]:
    """Columns of a missing-cell row if its feature had been observed as
    ``value``: mask 1, no time since observed. The last observed value stays."""
    columns = {}
    for f in features:
        asked = F.col("feature_name") == f
        columns[f"x_{f}"] = F.when(asked, value).otherwise(F.col(f"x_{f}"))
        columns[f"m_{f}"] = F.when(asked, 1).otherwise(F.col(f"m_{f}"))
        columns[f"d_{f}"] = F.when(asked, 0.0).otherwise(F.col(f"d_{f}"))
    return columns


def what_if_fanout(cells: DataFrame, features: list[str]) -> DataFrame:
    """One copy of each missing-cell row per what-if value."""
    samples = F.array(*[F.lit(s) for s in SAMPLES])
    return cells.withColumn("sample", F.explode(samples)).withColumns(
        what_if(features, F.col("sample"))
    )


def information_gain(cells: DataFrame, features: list[str], scorer: Scorer) -> DataFrame:
    """Baseline entropy minus the mean entropy over the what-if values."""
    entropies = [predictive_entropy(*scorer(what_if(features, F.lit(s)))) for s in SAMPLES]
    expected = reduce(lambda a, b: a + b, entropies) / float(len(SAMPLES))
    return cells.withColumn("_after", expected).select(
        "feature_name", "feature_model_idx",
        F.col("baseline").alias("baseline_entropy_at_timestep"),
        F.col("_after").alias("expected_entropy_after_acquiring_feature"),
        (F.col("baseline") - F.col("_after")).alias("information_gain"),
        F.col("pid").alias("patient_id"),
        F.col("t").alias("timestep_idx_analyzed"),
    )


def information_gain_from_donors(
    cells: DataFrame, features: list[str], scorer: Scorer, donors: DataFrame
) -> DataFrame:
    """The same with observed donor values in place of the fixed ones.

    ``donors`` has (feature_name, tertile, values): features x 3 rows.
    """
    return information_gain_from_values(cells.join(F.broadcast(donors), ["feature_name", "tertile"]), features, scorer)


def information_gain_from_values(cells: DataFrame, features: list[str], scorer: Scorer) -> DataFrame:
    """The same with what-if ``values`` of each cell's own."""
    after = F.transform(
        "values", lambda v: predictive_entropy(*scorer(what_if(features, v)))
    )
    mean = F.aggregate(after, F.lit(0.0), lambda a, e: a + e) / F.size("values")
    return cells.withColumn("_after", mean).select(
        F.col("pid").alias("patient_id"), F.col("t").alias("timestep_idx_analyzed"),
        "feature_name", (F.col("baseline") - F.col("_after")).alias("information_gain"),
    )


def acquisition_report(
    sequences: DataFrame, features: list[str], scorer: Scorer,
    threshold: float | None = None, top_k: int | None = None,
) -> DataFrame:
    """Gain of every missing cell at the chosen steps of all patients."""
    chosen = choose_steps(with_scores(sequences, features, scorer), threshold, top_k)
    return information_gain(missing_cells(chosen, features), features, scorer)


def gain_by_feature(report: DataFrame, n: int = 10) -> DataFrame:
    """Mean gain per feature, best first; one row per feature before the sort."""
    means = report.groupBy("feature_name").agg(F.avg("information_gain").alias("mean_gain"))
    return means.orderBy(F.desc("mean_gain"), "feature_name").limit(n)


def feature_counts_top(report: DataFrame, n: int = 10) -> DataFrame:
    counts = report.groupBy("feature_name").agg(F.count(F.lit(1)).alias("analysed"))
    return counts.orderBy(F.desc("analysed"), "feature_name").limit(n)


# --- donors ------------------------------------------------------------------


def tertile_edges(chart: DataFrame) -> DataFrame:
    """The two borders of the thirds of ``t`` over all rows, as one array."""
    counts = chart.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "t", F.col("t").cast("double")
    )
    return exact_quantiles(counts, [], "t", [F.lit(1 / 3), F.lit(2 / 3)])


def with_tertile(df: DataFrame, edges: DataFrame) -> DataFrame:
    above = [F.col("t") > edges.select(F.get("quantiles", F.lit(i))).scalar() for i in (0, 1)]
    return df.withColumn("tertile", above[0].cast("int") + above[1].cast("int"))


def donor_samples(
    chart: DataFrame, features: list[str], edges: DataFrame, k: int = 5, seed: str = "42"
) -> DataFrame:
    """(feature_name, tertile, values): ``k`` observed values per feature and
    third of ``t``, the first in hash order. Tasks keep their own first ``k``
    before the shuffle, so no task gathers all values of a feature."""
    observed = with_tertile(chart, edges).unpivot(
        ["pid", "t", "tertile"], features, "feature_name", "value"
    ).filter(F.col("value").isNotNull())
    order = hash_text(seed, F.col("pid"), F.col("t"), F.col("feature_name"))
    first = Window.partitionBy("feature_name", "tertile").orderBy("_h")
    return (
        observed.withColumn("_h", order)
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= k)
        .groupBy("feature_name", "tertile")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda s: s["value"])
             .alias("values"))
    )


# --- conditional donors ------------------------------------------------------

Predictors = dict[str, dict[str, float]]


def fit_predictors(sequences: DataFrame, features: list[str]) -> Predictors:
    """Per feature, a linear model of its observed values on value, mask and time
    since observed of the other features. Only coefficients reach the driver."""
    found = {}
    for f in features:
        names = [n for g in features if g != f for n in row_columns([g])]
        rows = sequences.filter(F.col(f"m_{f}") == 1).select(
            *[F.col(n).cast("double").alias(n) for n in names], F.col(f"x_{f}").cast("double").alias("_value")
        )
        if rows.isEmpty():
            found[f] = {"intercept": 0.0}
            continue
        model = LinearRegression(labelCol="_value", regParam=1e-6).fit(assemble(rows, names))
        found[f] = dict(zip(names, map(float, model.coefficients))) | {"intercept": float(model.intercept)}
    return found


def predicted(model: dict[str, float]) -> Column:
    """Predicted value from the columns of a row, to six digits."""
    terms = [F.col(n) * F.lit(float(w)) for n, w in model.items() if n != "intercept"]
    return F.round(reduce(lambda a, b: a + b, terms, F.lit(float(model["intercept"]))), 6)


def conditional_donors(
    cells: DataFrame, sequences: DataFrame, features: list[str], predictors: Predictors, k: int = 5,
) -> DataFrame:
    """Cells (from :func:`missing_cells`) with ``donors``: the ``k`` observed values of
    the feature whose rows predict it most like the cell's row does, as structs
    (d2, id, value), ties by row.

    All features are matched in one neighbour search: a feature has a coordinate of
    its own, so far apart that no other feature's rows come near. Cells of equal
    prediction share a search. A feature with fewer than ``k`` observed values gives
    what it has; one that was never observed gives no donors.
    """
    each = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"m_{f}").alias("m"), F.col(f"x_{f}").cast("double").alias("value"),
                 predicted(predictors[f]).alias("p"))
        for i, f in enumerate(features)
    ])
    seen = F.filter(each, lambda c: c["m"] == 1)
    pool = cut(
        sequences.select(F.concat_ws(":", F.col("pid").cast("string"), F.col("t").cast("string")).alias("id"), F.explode(seen).alias("c"))
        .select("id", "c.i", "c.value", F.col("c.p").alias("_p")), "pool",
    )
    place = {f: F.lit(i) for i, f in enumerate(features)}
    asked = cells.withColumns({
        "_i": reduce(lambda a, f: F.when(F.col("feature_name") == f, place[f]).otherwise(a), features, F.lit(None)),
        "_p": reduce(lambda a, f: F.when(F.col("feature_name") == f, predicted(predictors[f])).otherwise(a), features, F.lit(None)),
    })
    asked = cut(asked, "asked")
    reach = [rows.agg(F.max(F.abs("_p"))).first()[0] or 0.0 for rows in (pool, asked)]
    apart = 4.0 * (max(reach) + 1.0)
    near = nearest(
        asked.select((F.col("_i") * apart).alias("_g"), "_p"), pool.withColumn("_g", F.col("i") * apart), ["_g", "_p"], k, "value"
    )
    own = F.filter(F.coalesce("neighbours", F.array()), lambda n: n["v"][0] == F.col("_g"))
    donors = near.select("_g", "_p", F.transform(own, lambda n: F.struct(n["d2"], n["id"], n["value"])).alias("donors"))
    return hand_back(asked.withColumn("_g", F.col("_i") * apart), donors, ["_g", "_p"]).drop("_g", "_p", "_i")
