"""MLlib classifiers over prepared rows, scored into one predictions table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from bedside.operators.evaluation import leaderboard
from bedside.operators.neighbours import knn_classify
from bedside.operators.tabular import (
    check_trainable, column_means, label_weights, one_row, scale_pos_weight,
)
from bedside.operators.tree_bins import tree_borders, weighted_cells, with_bins
from bedside.session import cut

SEED = 42
#: Parameters of each classifier. Trees are bounded by depth, the linear models by
#: no penalty; ``settings`` of the functions below override any of them.
CLASSIFIERS = {
    "logistic_regression": (LogisticRegression, {"maxIter": 1000, "weightCol": "weight", "regParam": 0.0}),
    "decision_tree": (DecisionTreeClassifier, {"weightCol": "weight", "seed": SEED, "maxDepth": 5}),
    "random_forest": (RandomForestClassifier, {"numTrees": 100, "weightCol": "weight", "seed": SEED, "maxDepth": 5}),
    "gradient_boosting": (GBTClassifier, {"maxIter": 100, "seed": SEED, "maxDepth": 3}),
    "gaussian_nb": (NaiveBayes, {"modelType": "gaussian"}),
    "linear_svm": (LinearSVC, {"weightCol": "weight", "regParam": 0.0}),
}


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def with_balanced_weight(train: DataFrame) -> DataFrame:
    weights = train.withColumn("_w", one_row(label_weights(train)))
    return weights.withColumn("weight", F.when(F.col("y") == 1, F.col("_w.w1")).otherwise(F.col("_w.w0"))).drop("_w")


@dataclass
class OnBins:
    """A tree model learned on bins; rows are binned before it scores them."""

    model: object
    features: list[str]
    borders: list[list[float]]

    def transform(self, rows: DataFrame) -> DataFrame:
        binned = with_bins(rows.drop("features"), self.features, self.borders)
        return self.model.transform(assemble(binned, self.features))


def fit_boosting(train: DataFrame, features: list[str], **options) -> OnBins:
    """Boosted trees over weighted bins. The learner cuts features into bins again in every
    round and scans all rows a level; here rows are cut once by its own rule and rows
    alike in bins and label become one, so hundreds of scans read cells, not rows."""
    borders = tree_borders(train, features, options.get("maxBins", 32))
    cells = weighted_cells(train, features, borders)
    learner = GBTClassifier(**options, weightCol="weight", labelCol="y", featuresCol="features")
    return OnBins(learner.fit(assemble(cells, features)), features, borders)


def fit(name: str, train: DataFrame, features: list[str], **settings):
    """Fit one of ``CLASSIFIERS``; weighted ones get balanced class weights."""
    kind, options = CLASSIFIERS[name]
    if kind is GBTClassifier:
        return fit_boosting(train, features, **(options | settings))
    model = kind(**(options | settings)).setLabelCol("y").setFeaturesCol("features")
    return model.fit(assemble(with_balanced_weight(train), features))


def predictions(model, test: DataFrame, features: list[str]) -> DataFrame:
    """(id, y, score, pred). The score is the probability of class 1, or the raw
    margin for a model without probabilities. Test rows are scored once."""
    scored = model.transform(assemble(test, features))
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return cut(scored.select(
        "id", "y",
        F.round(vector_to_array(source)[1], 9).alias("score"),
        F.col("prediction").cast("int").alias("pred"),
    ), "predictions")


def evaluate(name: str, train: DataFrame, test: DataFrame, features: list[str], **settings) -> DataFrame:
    """Metrics row of one classifier."""
    check_trainable(train)
    return metrics_of({name: predictions(fit(name, train, features, **settings), test, features)})


def metrics_of(by_model: dict[str, DataFrame]) -> DataFrame:
    """Metrics per model in one table."""
    named = [
        df.select(F.lit(i).alias("model_ord"), F.lit(name).alias("model"), "y", "score", "pred")
        for i, (name, df) in enumerate(by_model.items())
    ]
    return leaderboard(reduce(DataFrame.unionByName, named)).drop("model_ord")


def all_predictions(
    train: DataFrame, test: DataFrame, features: list[str], k: int = 5
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Predictions of all classifiers and the nearest-neighbour vote on the same
    split, and the message of each one that failed."""
    check_trainable(train)
    work = {
        name: lambda name=name: predictions(fit(name, train, features), test, features) for name in CLASSIFIERS
    }
    work["knn"] = lambda: cut(knn_classify(test, train, features, k).select("id", "y", "score", "pred"), "predictions")
    done, failed = {}, {}
    for name, run in work.items():
        try:
            done[name] = run()
        except Exception as error:  # one model that cannot be fitted leaves the others standing
            failed[name] = f"{type(error).__name__}: {error}"[:500]
    return done, failed


def compare_classifiers(
    train: DataFrame, test: DataFrame, features: list[str], k: int = 5
) -> DataFrame:
    """Metrics of all classifiers; one that failed has a row with ``error`` alone."""
    done, failed = all_predictions(train, test, features, k)
    if not done:
        raise ValueError(f"no classifier could be fitted: {failed}")
    table = metrics_of(done).withColumn("error", F.lit(None).cast("string"))
    broken = train.sparkSession.createDataFrame(list(failed.items()), "model string, error string")
    return table.unionByName(broken, allowMissingColumns=True)


def largest_gradient(model, train: DataFrame, features: list[str]) -> float:
    """Largest component of the mean weighted gradient of a logistic regression."""
    rows = model.transform(assemble(with_balanced_weight(train), features))
    off = F.col("weight") * (vector_to_array("probability")[1] - F.col("y"))
    sums = rows.agg(*[F.avg(off * F.col(f)).alias(f) for f in features], F.avg(off).alias("_bias")).first()
    return max(abs(v) for v in sums)


def gaussian_classes(model, features: list[str], spark) -> DataFrame:
    """(label, feature, mean, variance) of a fitted Gaussian Bayes model."""
    rows = [
        (i, f, float(model.theta.toArray()[i, j]), float(model.sigma.toArray()[i, j]))
        for i in range(model.numClasses) for j, f in enumerate(features)
    ]
    return spark.createDataFrame(rows, "label int, feature string, mean double, variance double")


def boosting_with_missing(train: DataFrame, test: DataFrame, features: list[str], depth: int = 3) -> DataFrame:
    """Predictions of boosted trees on rows with missing cells: each feature comes with a presence
    indicator and is filled with its training mean (0 if it has none), and
    positives weigh negatives over positives. The filled rows are written once,
    since every boosting step reads them."""
    check_trainable(train)
    means = one_row(column_means(train, features))
    ratio = scale_pos_weight(train).select("scale_pos_weight").scalar()

    def filled(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("_m", means)
            .withColumns({f"has_{f}": F.col(f).isNotNull().cast("double") for f in features})
            .withColumns({f: F.coalesce(f, f"_m.{f}", F.lit(0.0)) for f in features})
            .withColumn("weight", F.when(F.col("y") == 1, ratio).otherwise(1.0))
            .drop("_m")
        )

    columns = [*features, *[f"has_{f}" for f in features]]
    model = GBTClassifier(
        maxIter=100, maxDepth=depth, seed=SEED, weightCol="weight", labelCol="y", featuresCol="features"
    ).fit(assemble(cut(filled(train), "filled"), columns))
    return predictions(model, filled(test), columns)


def project(points: DataFrame, features: list[str], k: int) -> DataFrame:
    """First ``k`` principal components with the label."""
    rows = assemble(points, features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(rows)
    pc = vector_to_array("pc")
    return model.transform(rows).select("id", "y", *[pc[i].alias(f"pc{i + 1}") for i in range(k)])


def projection_2d(points: DataFrame, features: list[str]) -> DataFrame:
    """First two principal components with the label."""
    return project(points, features, 2)
