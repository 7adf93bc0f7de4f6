"""Rebalancing: detectors by negative selection, and SMOTE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from bedside.functions.hashing import hash_text, hash_uniform
from bedside.operators.evaluation import classification_metrics, confusion_matrix
from bedside.operators.neighbours import box_tree, hand_back, nearest, radius_anti_join, radius_flag
from bedside.operators.ranking import take_quota
from bedside.session import cut


def feature_bounds(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, lo, hi) over all rows of both classes, in one pass."""
    wide = train.agg(
        *[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]
    )
    rows = [
        F.struct(F.lit(f).alias("feature"), F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi"))
        for f in features
    ]
    return wide.select(F.inline(F.array(*rows)))


def candidates(
    bounds: list[tuple[str, float, float]], spark, start: int, count: int, seed: str
) -> DataFrame:
    """``count`` uniform points inside the bounds; point ``i`` is the same in any run."""
    ids = spark.range(start, start + count).withColumnRenamed("id", "det_id")
    return ids.withColumns(
        {f: F.round(F.lit(lo) + hash_uniform(seed, F.col("det_id"), F.lit(f)) * F.lit(hi - lo), 6)
         for f, lo, hi in bounds}
    )


def accepted_in_order(kept: DataFrame, num_detectors: int, max_trials: int) -> DataFrame:
    """Apply the stopping rule to accepted candidate ids: keep the first
    ``num_detectors``, and none after ``max_trials`` failures in a row.

    ``kept`` holds no more rows than detectors asked for plus one round.
    """
    in_order = Window.orderBy("det_id")
    gap = F.col("det_id") - F.coalesce(F.lag("det_id").over(in_order), F.lit(-1))
    return (
        kept.withColumns({"_n": F.row_number().over(in_order), "_gap": gap})
        .withColumn("_worst", F.max("_gap").over(in_order))
        .filter((F.col("_worst") <= max_trials) & (F.col("_n") <= num_detectors))
        .drop("_n", "_gap", "_worst")
    )


def nsa_detectors(
    train: DataFrame,
    features: list[str],
    radius: float = 1.0,
    num_detectors: int = 10000,
    max_trials: int = 1000,
    seed: str = "42",
    round_size: int = 16384,
) -> DataFrame:
    """Points inside the training bounds farther than ``radius`` from every
    label-0 row: (det_id, features). The tree of label-0 rows is made once.
    Candidates are drawn and tested a round at a time until enough are accepted
    or a run of ``max_trials`` fails; without label-0 rows there are none.
    """
    spark = train.sparkSession
    bounds = [(r["feature"], r["lo"], r["hi"]) for r in feature_bounds(train, features).collect()]
    normal = train.filter("y = 0")
    if bounds[0][1] is None or normal.isEmpty():
        return spark.range(0).select(
            F.col("id").alias("det_id"), *[F.lit(0.0).alias(f) for f in features]
        )
    bounds.sort(key=lambda b: features.index(b[0]))
    tree = box_tree(normal.select(*features).distinct(), features)
    rounds, start, size = [], 0, round_size
    while True:
        drawn = candidates(bounds, spark, start, size, seed)
        rounds.append(cut(radius_anti_join(drawn, tree, features, radius), "detectors"))
        start += size
        kept = reduce(DataFrame.unionByName, rounds)
        found = cut(accepted_in_order(kept, num_detectors, max_trials), "accepted")
        seen = found.agg(F.count(F.lit(1)).alias("n"), F.max("det_id").alias("last")).first()
        last = -1 if seen["last"] is None else seen["last"]
        if seen["n"] >= num_detectors or start - 1 - last >= max_trials:
            return found
        # As many as the share accepted so far lets expect, within bounds.
        wanted = (num_detectors - seen["n"]) * start // max(seen["n"], 1)
        size = min(max(round_size, wanted + wanted // 8), 64 * round_size)


def augment_union(train: DataFrame, detectors: DataFrame, features: list[str]) -> DataFrame:
    """Training rows plus the detectors as rows of class 1, keyed ``detector:<n>``."""
    extra = detectors.select(
        F.concat(F.lit("detector:"), F.col("det_id").cast("string")).alias("id"), F.lit(1).alias("y"), *features
    )
    return train.select(F.col("id").cast("string").alias("id"), "y", *features).unionByName(extra)


def nsa_classify(
    train: DataFrame, test: DataFrame, features: list[str], radius: float = 1.0, **options,
) -> tuple[DataFrame, DataFrame]:
    """Metrics and confusion matrix of flagging test rows near a detector."""
    detectors = nsa_detectors(train, features, radius, **options)
    flagged = radius_flag(test, detectors, features, radius, "pred")
    named = flagged.withColumn("model", F.lit("negative selection"))
    return classification_metrics(named, ["model"]), confusion_matrix(named)


def smote(
    train: DataFrame, features: list[str], k: int = 5, seed: str = "42",
) -> DataFrame:
    """Synthetic rows of the smaller class until both classes are equal.

    Every minority row gets the same number of copies, and the first rows in
    hash order one more, so the total is exact. A copy lies at a random place
    between its row and one of the row's ``k`` nearest minority rows. Rows are
    (parent, copy, neighbour, y, features). A smaller class of fewer than two rows has
    no neighbours to go to and is refused.
    """
    sizes = train.agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("ones"), F.count(F.when(F.col("y") == 0, 1)).alias("zeros")
    ).first()
    few, many = sorted((sizes["ones"], sizes["zeros"]))
    label = int(sizes["ones"] <= sizes["zeros"])
    if few < 2 and many > few:
        raise ValueError(f"class {label} has {few} rows: none has a neighbour to make rows from")
    need = many - few
    minority = train.filter(F.col("y") == label).select("id", "y", *features)
    near = nearest(minority, minority, features, k + 1)
    order = hash_text(seed, F.col("id"), F.lit("copy"))
    flagged = take_quota(minority, "y", order, F.lit(need % max(few, 1)), "_one_more")
    copies = F.lit(need // max(few, 1)) + F.col("_one_more").cast("int")
    spread = (
        hand_back(flagged.withColumn("_copies", copies).filter("_copies > 0"), near, features)
        .withColumn("_near", F.slice(F.filter("neighbours", lambda n: n["id"] != F.col("id")), 1, k))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    )
    pick = F.floor(hash_uniform(seed, F.col("id"), F.col("copy"), F.lit("pick")) * F.size("_near"))
    chosen = spread.withColumn("_other", F.get("_near", pick.cast("int")))
    share = hash_uniform(seed, F.col("id"), F.col("copy"), F.lit("gap"))
    return chosen.select(
        F.col("id").alias("parent"),
        "copy",
        F.col("_other.id").alias("neighbour"),
        F.lit(label).alias("y"),
        *[(F.col(f) + share * (F.col("_other.v")[i] - F.col(f))).alias(f)
          for i, f in enumerate(features)],
    )


def balanced(train: DataFrame, features: list[str], **options) -> DataFrame:
    """Training rows and their synthetic rows: (id, y, features). Synthetic rows
    are keyed ``made:<parent>:<copy>``."""
    made = smote(train, features, **options)
    key = F.concat_ws(":", F.lit("made"), F.col("parent").cast("string"), F.col("copy").cast("string"))
    extra = made.select(key.alias("id"), "y", *features)
    return train.select(F.col("id").cast("string").alias("id"), "y", *features).unionByName(extra)
