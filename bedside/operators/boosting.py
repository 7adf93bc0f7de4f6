"""Boosted trees for rows with missing cells: splits learn on which side missing goes.

A round fits one small tree to the gradients of the logistic loss. Per level, one
grouped sum gives the gradients by node, feature and bin, missing cells in a bin of
their own; a window over the bins gives the gain of every split with missing cells on
either side. Only one split per node reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.mixture import sigmoid
from bedside.operators.frequency import unpivot
from bedside.operators.ranking import exact_quantiles
from bedside.operators.tabular import check_trainable, scale_pos_weight
from bedside.session import cut

PENALTY = 1.0  # added to the sum of second derivatives of a side
LEAST = 1.0  # least sum of second derivatives a side needs
WRITTEN = 8  # rounds after which margins are written


@dataclass
class Split:
    feature: int
    bin: int
    missing_left: bool
    left: "Split | float"
    right: "Split | float"


@dataclass
class Boosted:
    """Borders per feature, trees over bins, and the number of training rounds."""

    features: list[str]
    borders: list[list[float]]
    trees: list["Split | float"] = field(default_factory=list)


def bin_borders(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of the present values of each feature, to six digits; a
    feature without values has none."""
    counts = unpivot(train.select(*features), [], features).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = exact_quantiles(counts, ["feature"], "value", [F.lit(i / bins) for i in range(1, bins)])
    rows = {r["feature"]: r["quantiles"] for r in found.collect()}
    return [sorted({round(q, 6) for q in rows.get(f, [])}) for f in features]


def binned(df: DataFrame, features: list[str], borders: list[list[float]]) -> DataFrame:
    """Columns ``_b0``, ``_b1``, ...: how many borders lie below a value, -1 if it is missing."""
    columns = {}
    for i, (f, cuts) in enumerate(zip(features, borders)):
        above = reduce(add, [(F.col(f) > c).cast("int") for c in cuts], F.lit(0))
        columns[f"_b{i}"] = F.when(F.col(f).isNull(), -1).otherwise(above)
    return df.withColumns(columns)


def histograms(rows: DataFrame, features: int) -> DataFrame:
    """(node, feature, bin, g, h): sums of first and second derivatives."""
    bins = F.posexplode(F.array(*[F.col(f"_b{i}") for i in range(features)])).alias("feature", "bin")
    return rows.select("node", "g", "h", bins).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def split_gains(sums: DataFrame) -> DataFrame:
    """Gain of every split (node, feature, bin, missing_left): values up to ``bin`` go
    left, missing cells to the side named. Sides too light to stand are left out."""
    own = Window.partitionBy("node", "feature")
    up_to = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    present = F.col("bin") >= 0
    columns = {}
    for c in ("g", "h"):
        columns[f"_{c}0"] = F.coalesce(F.sum(F.when(~present, F.col(c))).over(own), F.lit(0.0))
        columns[f"_{c}_all"] = F.sum(c).over(own)
        columns[f"_{c}_up"] = F.sum(F.when(present, F.col(c))).over(up_to)
    both = sums.withColumns(columns).filter(present).withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    for c in ("g", "h"):
        left = F.col(f"_{c}_up") + F.when(F.col("missing_left"), F.col(f"_{c}0")).otherwise(0.0)
        both = both.withColumns({f"{c}_left": left, f"{c}_right": F.col(f"_{c}_all") - left})

    def part(g: Column, h: Column) -> Column:
        return g * g / (h + PENALTY)

    gain = part(F.col("g_left"), F.col("h_left")) + part(F.col("g_right"), F.col("h_right")) - part(F.col("_g_all"), F.col("_h_all"))
    return both.filter((F.col("h_left") >= LEAST) & (F.col("h_right") >= LEAST)).select(
        "node", "feature", "bin", "missing_left", gain.alias("gain"), "g_left", "h_left", "g_right", "h_right"
    )


def best_splits(gains: DataFrame) -> DataFrame:
    """The best split of each node; equal gains go to the first feature, bin, and side
    left. A node whose gain is not above 0 is not split."""
    order = F.struct(-F.round("gain", 9), "feature", "bin", ~F.col("missing_left"))
    values = F.struct("feature", "bin", "missing_left", "g_left", "h_left", "g_right", "h_right")
    return gains.filter(F.round("gain", 9) > 0).groupBy("node").agg(F.min_by(values, order).alias("s")).select("node", "s.*")


def _goes_left(split: Split) -> Column:
    b = F.col(f"_b{split.feature}")
    return (b <= split.bin) if split.missing_left else (b >= 0) & (b <= split.bin)


def value_of(tree: Split | float) -> Column:
    """The value a tree adds to a row's margin."""
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(_goes_left(tree), value_of(tree.left)).otherwise(value_of(tree.right))


def _node_of(tree: Split | float, number: int) -> Column:
    if isinstance(tree, float):
        return F.lit(number)
    return F.when(_goes_left(tree), _node_of(tree.left, 2 * number)).otherwise(_node_of(tree.right, 2 * number + 1))


def _grow(rows: DataFrame, features: int, depth: int, rate: float) -> Split | float:
    """One tree, a level per pass over the rows."""
    tree: Split | float = 0.0
    places: dict[int, tuple[Split, str] | None] = {1: None}  # open nodes and where they hang
    for _ in range(depth):
        at = rows.withColumn("node", _node_of(tree, 1)).filter(F.col("node").isin(list(places)))
        found = best_splits(split_gains(histograms(at, features))).collect()
        below: dict[int, tuple[Split, str] | None] = {}
        for r in sorted(found, key=lambda r: r["node"]):
            weight = lambda side, r=r: float(-rate * r[f"g_{side}"] / (r[f"h_{side}"] + PENALTY))
            split = Split(r["feature"], r["bin"], r["missing_left"], weight("left"), weight("right"))
            hangs = places[r["node"]]
            if hangs is None:
                tree = split
            else:
                setattr(hangs[0], hangs[1], split)
            below[2 * r["node"]] = (split, "left")
            below[2 * r["node"] + 1] = (split, "right")
        places = below
        if not places:
            break
    return tree


def with_gradients(rows: DataFrame, margin: Column) -> DataFrame:
    """First and second derivatives of the weighted logistic loss."""
    p = sigmoid(margin)
    return rows.withColumns({"g": F.col("weight") * (p - F.col("y")), "h": F.col("weight") * p * (1.0 - p)})


def training_rows(train: DataFrame, features: list[str], borders: list[list[float]]) -> DataFrame:
    """Binned rows with weights that even out the classes."""
    ratio = scale_pos_weight(train).select("scale_pos_weight").scalar()
    weighted = binned(train, features, borders).withColumn("weight", F.when(F.col("y") == 1, ratio).otherwise(1.0))
    return weighted.select("y", "weight", *[f"_b{i}" for i in range(len(features))])


def fit(
    train: DataFrame, features: list[str], rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 16,
) -> Boosted:
    """Boost ``rounds`` trees of ``depth`` levels on ``train`` (y, nullable features).

    Rows are reduced to small bin numbers and written once; margins are written every
    few rounds, so plans stay short and a lost executor repeats few rounds. A level
    reads the rows once and shuffles sums by node, feature and bin only.
    """
    check_trainable(train)
    model = Boosted(features, bin_borders(train, features, bins))
    rows = cut(training_rows(train, features, model.borders).withColumn("margin", F.lit(0.0)), "binned")
    fresh: list[Split | float] = []
    for number in range(1, rounds + 1):
        margin = reduce(add, [value_of(t) for t in fresh], F.col("margin"))
        tree = _grow(with_gradients(rows, margin), len(features), depth, rate)
        model.trees.append(tree)
        fresh.append(tree)
        if tree == 0.0:
            break
        if number % WRITTEN == 0 and number < rounds:
            rows = cut(rows.withColumn("margin", reduce(add, [value_of(t) for t in fresh], F.col("margin"))), "margins")
            fresh = []
    return model


def predictions(model: Boosted, test: DataFrame) -> DataFrame:
    """(id, y, score, pred) of rows that may miss cells."""
    margin = reduce(add, [value_of(t) for t in model.trees], F.lit(0.0))
    scored = binned(test, model.features, model.borders).select("id", "y", F.round(sigmoid(margin), 9).alias("score"))
    return cut(scored.withColumn("pred", (F.col("score") > 0.5).cast("int")), "predictions")
