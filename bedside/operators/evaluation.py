"""Exact metrics over a table of predictions, per model, in one aggregation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.mixture import logit_variance, mixture_nll
from bedside.operators.ranking import ranked_counts
from bedside.session import cut


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def classification_metrics(preds: DataFrame, by: list[str], label: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where a divisor is 0."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counted = preds.groupBy(*by).agg(
        _count(y & p).alias("tp"), _count(~y & p).alias("fp"),
        _count(y & ~p).alias("fn"), _count(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(preds: DataFrame, label: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """One row per true class (of each group), predicted classes as columns. A
    class without rows is listed with zeros."""
    y, p = F.col(label), F.col(pred)
    counts = preds.groupBy(*(by or [])).agg(
        *[_count((y == i) & (p == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)]
    )
    rows = [
        F.struct(F.lit(i).alias("label"), F.col(f"c{i}0").alias("pred_0"), F.col(f"c{i}1").alias("pred_1"))
        for i in (0, 1)
    ]
    return counts.select(*(by or []), F.inline(F.array(*rows)))


def roc_auc(preds: DataFrame, by: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties averaged; 0 if a class is absent.

    Rows with equal scores are collapsed first and ranked range by range, so no
    window holds all scores.
    """
    counts = preds.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    ranked = ranked_counts(counts, by, score, ["neg"])
    won = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(_ratio(F.sum(won), pairs).alias("auc"))


def leaderboard(preds: DataFrame, best_order: str = "model_ord") -> DataFrame:
    """Metrics per model and a flag on the best by area; the first model in list
    order keeps a tie. One row per model from the first aggregation on."""
    by = [best_order, "model"]
    # Written, a row per model: the name of a single model as a constant is no key to join on.
    counts, areas = cut(classification_metrics(preds, by), "metrics"), cut(roc_auc(preds, by), "areas")
    table = counts.join(F.broadcast(areas), by)
    best = F.max_by(best_order, F.struct("auc", -F.col(best_order))).over(Window.partitionBy())
    return table.withColumn("is_best", F.col(best_order) == best)


# --- mixture predictions -----------------------------------------------------


def mixture_loss(preds: DataFrame) -> DataFrame:
    """Mean negative log likelihood over valid rows."""
    return preds.agg(F.avg(mixture_nll(F.col("pis"), F.col("mus"), F.col("y"))).alias("nll"))


def transition_recall(preds: DataFrame) -> DataFrame:
    """Share of valid 0 -> 1 rows predicted above one half; NULL without such rows."""
    moved = (F.col("y") == 0) & (F.col("y_target") == 1) & F.col("valid")
    return preds.agg(
        _count(moved).alias("transitions"),
        (_count(moved & (F.col("probability") > 0.5)) / F.nullif(_count(moved), F.lit(0))).alias("recall"),
    )


def transition_weighted_loss(preds: DataFrame, weight: float) -> DataFrame:
    """Both published forms over valid rows: ``added`` is the mean loss plus the
    weighted mean loss on 0 -> 1 rows, ``scaled`` the mean of weighted losses."""
    weight = float(weight) if weight > 0 else 1.0
    valid = preds.filter("valid")
    moved = (F.col("y") == 0) & (F.col("y_target") == 1)
    extra = F.coalesce(F.avg(F.when(moved, F.col("nll"))), F.lit(0.0))
    return valid.agg(
        (F.avg("nll") + weight * extra).alias("added"),
        F.avg(F.col("nll") * F.when(moved, weight).otherwise(1.0)).alias("scaled"),
    )


def uncertainty_summary(preds: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Histogram of the logit variance with the overall mean on each row; values
    outside the range fall into bins 0 and ``bins + 1``."""
    value = logit_variance(F.col("pis"), F.col("mus"))
    binned = preds.select(value.alias("v")).withColumn(
        "bin", F.width_bucket("v", F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int")
    )
    sums = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    overall = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return sums.select("bin", "n").withColumn("mean_variance", overall.scalar())


def masked_reconstruction_error(df: DataFrame, triples: list[tuple[Column, Column, Column]]) -> DataFrame:
    """``sum(((x_hat - x) m)^2) / sum(m)`` over (x_hat, x, m) columns."""
    squares = reduce(add, [(a - b) * (a - b) * m * m for a, b, m in triples])
    masks = reduce(add, [m for _, _, m in triples])
    return df.agg((F.sum(squares) / F.sum(masks)).alias("error"))
