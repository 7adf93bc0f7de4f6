"""Probabilities for classifiers that give margins: a sigmoid fitted on margins of
rows the classifier has not seen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bedside.functions.hashing import hash_uniform
from bedside.functions.mixture import bce_with_logits, sigmoid
from bedside.operators import models as md
from bedside.operators.tabular import check_trainable
from bedside.session import cut

MOST_STEPS = 50
ENOUGH = 1e-10  # fall of the mean loss at which steps end


def cross_margins(name: str, train: DataFrame, features: list[str], folds: int = 3, seed: str = "42", **settings) -> DataFrame:
    """(id, y, margin) of every training row by a model fitted without the row's fold.
    Folds are drawn by a hash of the id, so equal ids share one."""
    fold = F.floor(hash_uniform(seed, F.col("id"), F.lit("fold")) * folds)
    rows = train.withColumn("_fold", fold)
    parts = []
    for i in range(folds):
        model = md.fit(name, rows.filter(F.col("_fold") != i), features, **settings)
        parts.append(md.predictions(model, rows.filter(F.col("_fold") == i), features))
    return reduce(DataFrame.unionByName, parts).select("id", "y", F.col("score").alias("margin"))


def fit_sigmoid(margins: DataFrame) -> tuple[float, float]:
    """Slope and shift of the probability of class 1 given the margin.

    Newton steps on the mean logistic loss; each is one aggregate of six sums. Targets
    are pulled in by one row of each class, so margins that separate the classes do
    not drive the slope without bound.
    """
    size = margins.agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg"),
        F.avg("margin").alias("mean"), F.stddev_pop("margin").alias("spread"),
    ).first()
    if not size["pos"] or not size["neg"]:
        raise ValueError("a sigmoid needs margins of both classes")
    mean, spread = size["mean"], size["spread"] or 1.0
    x = (F.col("margin") - mean) / spread
    target = F.when(F.col("y") == 1, (size["pos"] + 1) / (size["pos"] + 2)).otherwise(1 / (size["neg"] + 2))

    def sums(a: float, b: float):
        z = x * a + b
        p = sigmoid(z)
        off, bend = p - target, p * (1.0 - p)
        return margins.agg(
            F.avg(bce_with_logits(z, target)).alias("loss"), F.avg(off * x).alias("ga"), F.avg(off).alias("gb"),
            F.avg(bend * x * x).alias("haa"), F.avg(bend * x).alias("hab"), F.avg(bend).alias("hbb"),
        ).first()

    a, b = 0.0, math.log((size["pos"] + 1) / (size["neg"] + 1))
    now = sums(a, b)
    for _ in range(MOST_STEPS):
        haa, hbb = now["haa"] + 1e-12, now["hbb"] + 1e-12
        det = haa * hbb - now["hab"] ** 2
        da = -(hbb * now["ga"] - now["hab"] * now["gb"]) / det
        db = -(haa * now["gb"] - now["hab"] * now["ga"]) / det
        share = 1.0
        after = sums(a + da, b + db)
        while after["loss"] > now["loss"] and share > 1e-6:
            share /= 4
            after = sums(a + share * da, b + share * db)
        fall = now["loss"] - after["loss"]
        if fall > 0:
            a, b, now = a + share * da, b + share * db, after
        if fall < ENOUGH:
            break
    return a / spread, b - a * mean / spread


def with_probability(scored: DataFrame, slope: float, shift: float) -> DataFrame:
    """``score`` becomes the probability of class 1; the prediction is above one half."""
    p: Column = F.round(sigmoid(F.col("score") * slope + shift), 9)
    return scored.withColumn("score", p).withColumn("pred", (F.col("score") > 0.5).cast("int"))


def calibrated_predictions(name: str, train: DataFrame, test: DataFrame, features: list[str], folds: int = 3, **settings) -> DataFrame:
    """(id, y, score, pred) of a margin classifier fitted on all training rows, its
    margins turned into probabilities by a sigmoid fitted on cross-fitted margins."""
    check_trainable(train)
    slope, shift = fit_sigmoid(cut(cross_margins(name, train, features, folds, **settings), "margins"))
    return with_probability(md.predictions(md.fit(name, train, features, **settings), test, features), slope, shift)


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, rows, mean_score, share): predicted and found share of class 1 by bins of
    equal width; the last bin holds 1."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.avg("y").alias("share")
    )


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row ``error``: mean distance of predicted and found share, weighted by rows."""
    gaps = calibration_bins(scored, bins)
    return gaps.agg((F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("share"))) / F.sum("rows")).alias("error"))
