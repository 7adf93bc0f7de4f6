"""Radius and nearest-neighbour joins over scaled points, by a tree of boxes.

A box holds points and the bounds of their values in all features. Boxes are split
at quantiles of their widest feature until they are small, and joins go down the
tree level by level: a box is dropped, taken whole or opened by the distance of its
nearest and farthest corner. No step compares all points with all points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.functions.mixture import squared_distance
from bedside.session import cut

LEAF = 8  # points up to which a box is not split
NEAR_LEAF = 64  # the same for nearest neighbours, where a query needs ``k`` points of one leaf
FAN = 8  # parts a box is split into, about; a power of two
NEAR_FAN = 16  # the same for nearest neighbours: fewer levels, each a scan of all points
SMALL = 4096  # boxes up to which a level is sent to every task
STEPS = 2  # levels a radius join, or one row per query, goes down before it is written
ACCURACY = 256  # of the quantiles boxes are split at


@dataclass
class BoxTree:
    """``levels`` holds per level the boxes (``_box``, ``_parent``, ``_n``, ``_leaf``,
    bounds) and their number; ``points`` has the points with the leaf they lie in."""

    levels: list[tuple[DataFrame, int]]
    points: DataFrame


def _bounds(features: list[str]) -> list[str]:
    return [f"{side}_{f}" for f in features for side in ("lo", "hi")]


def _level(boxes: DataFrame, number: int) -> DataFrame:
    """A level small enough by count is sent to every task, a larger one shuffled."""
    return F.broadcast(boxes) if number <= SMALL else boxes


def box_tree(points: DataFrame, features: list[str], leaf: int = LEAF, fan: int = FAN) -> BoxTree:
    """Split ``points`` into boxes of at most ``leaf`` rows; a box of equal vectors
    cannot be split, so equal points should be reduced before.

    Every level is one aggregate over boxes, with partial sums and quantile sketches
    per task, and one join that moves points to their parts, so neither the root nor
    a clump is gathered. Parts lie between quantiles of the widest feature; a value
    that is several quantiles, as imputation makes them, gets a part of its own. Any
    split leaves two parts occupied.
    """
    steps = [i / fan for i in range(1, fan)]
    placed = cut(points.withColumns({"_box": F.lit("0"), "_open": F.lit(True)}), "placed")
    levels = []
    while True:
        found = placed.filter("_open").groupBy("_box").agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features],
            *[F.percentile_approx(f, steps, ACCURACY).alias(f"_q_{f}") for f in features],
        )
        widths = F.array(*[F.col(f"hi_{f}") - F.col(f"lo_{f}") for f in features])
        widest = F.array_position(widths, F.array_max(widths)).cast("int")

        def of_widest(columns: list[str]) -> Column:
            return F.element_at(F.array(*columns), F.col("_w"))

        low, high = of_widest([f"lo_{f}" for f in features]), of_widest([f"hi_{f}" for f in features])
        middle = (low + high) / 2
        # Nearly small enough boxes are split into fewer parts.
        stride = F.lit(fan) / F.least(F.lit(fan), F.pow(2.0, F.ceil(F.log2(F.col("_n") / leaf))))
        chosen = F.filter(of_widest([f"_q_{f}" for f in features]), lambda q, i: (i + 1) % stride.cast("int") == 0)
        often = F.filter(F.col("_q"), lambda q: (q > low) & ((q == high) | (F.size(F.filter("_q", lambda o: o == q)) > 1)))
        boxes = cut(
            found.withColumn("_w", widest)
            .withColumn("_q", chosen)
            .withColumn("_above", F.array_distinct(F.filter("_q", lambda q: q < high)))
            .withColumn("_from", F.array_distinct(often))
            .withColumn("_leaf", (F.col("_n") <= leaf) | (low >= high))
            .withColumn("_parent", F.regexp_replace("_box", r"\.?[^.]*$", ""))
            .select("_box", "_parent", "_n", "_leaf", *_bounds(features), "_w", "_above", "_from"),
            "boxes",
        )
        number, whole = boxes.agg(F.count(F.lit(1)), F.count(F.when(~F.col("_leaf"), 1))).first()
        levels.append((boxes.drop("_w", "_above", "_from"), number))
        split = boxes.filter("NOT _leaf").select("_box", "_w", "_above", "_from")
        if not whole:
            return BoxTree(levels, placed.drop("_open"))
        value = F.element_at(F.array(*features), F.col("_w"))
        part = F.size(F.filter("_above", lambda c: value > c)) + F.size(F.filter("_from", lambda c: value >= c))
        moved = placed.join(_level(split, number), "_box", "left")
        placed = cut(
            moved.withColumn("_open", F.col("_w").isNotNull())
            .withColumn("_box", F.when(F.col("_open"), F.concat_ws(".", "_box", part.cast("string"))).otherwise(F.col("_box")))
            .drop("_w", "_above", "_from"),
            "placed",
        )


def _corners(features: list[str], bound=F.col) -> tuple[Column, Column]:
    """Squared distance of the nearest and of the farthest corner of a box. Rounding
    is monotone, so they bound the distances to its points as computed."""
    inner, outer = F.lit(0.0), F.lit(0.0)
    for f in features:
        below, above = bound(f"lo_{f}") - F.col(f), F.col(f) - bound(f"hi_{f}")
        gap, far = F.greatest(below, above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))
        inner, outer = inner + gap * gap, outer + far * far
    return inner, outer


def _met(open_: DataFrame, level: tuple[DataFrame, int], keys: list[str], features: list[str], done: Column) -> DataFrame:
    """Rows (``keys``, features, box, its number of points, corners): the children of
    the boxes each open row still has; leaves, which have none, and rows that are
    ``done`` stay."""
    inner, outer = _corners(features)
    boxes, number = level
    children = _level(boxes.select(
        "_parent", F.col("_box").alias("_child"), F.col("_n").alias("_child_n"), F.col("_leaf").alias("_child_leaf"), *_bounds(features)
    ), number)
    asked = open_.withColumn("_parent", F.when(~done, F.col("_box")))
    met = asked.join(children, "_parent", "left")
    opened = F.col("_child").isNotNull()
    return met.select(
        *keys, *features,
        F.coalesce("_child", "_box").alias("_box"), F.coalesce("_child_n", "_n").alias("_n"),
        F.coalesce("_child_leaf", "_leaf").alias("_leaf"),
        F.when(opened, inner).otherwise(F.col("_inner")).alias("_inner"),
        F.when(opened, outer).otherwise(F.col("_outer")).alias("_outer"),
    )


def _at_root(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rows above the root, written: as constants the box would be no key to join on."""
    start = {"_box": F.lit(""), "_n": F.lit(0).cast("long"), "_leaf": F.lit(False), "_inner": F.lit(0.0), "_outer": F.lit(float("inf"))}
    return cut(rows.select(*keys, *features).withColumns(start), "start")


def radius_leaves(candidates: DataFrame, tree: BoxTree, features: list[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """(leaves, inside): the boxes in which points within ``radius`` of a candidate
    (``det_id``) may lie, and the candidates that hold a whole box in their ball."""
    limit = radius * radius
    open_, inside = _at_root(candidates, ["det_id"], features), None
    for number, level in enumerate(tree.levels, 1):
        open_ = _met(open_, level, ["det_id"], features, F.col("_outer") <= limit).filter(F.col("_inner") <= limit)
        if number % STEPS == 0 or number == len(tree.levels):
            met = cut(open_, "met")
            sure = met.filter(F.col("_outer") <= limit).select("det_id").distinct()
            open_ = met.join(sure, "det_id", "left_anti")
            inside = sure if inside is None else inside.unionByName(sure)
    # A tree without points has one level without boxes, and its root is no leaf.
    return open_.filter("_leaf"), inside


def radius_anti_join(candidates: DataFrame, points: DataFrame | BoxTree, features: list[str], radius: float) -> DataFrame:
    """Candidates (``det_id``, ``features``) farther than ``radius`` from every point.

    Candidates go down the tree; one whose ball holds a whole box is rejected there.
    Of the leaves that are left, a candidate's nearest is looked into first, the
    others only if that holds no point close enough. ``points`` may be a tree over
    distinct vectors, so that several calls share it.
    """
    tree = points if isinstance(points, BoxTree) else box_tree(points.select(*features).distinct(), features)
    leaves, inside = radius_leaves(candidates, tree, features, radius)
    leaves = cut(leaves, "leaves")
    nearest_leaf = leaves.groupBy("det_id").agg(F.min_by("_box", F.struct("_inner", "_outer", "_box")).alias("_box"))
    asked = cut(nearest_leaf, "nearest-leaf")
    limit = radius * radius
    here = tree.points.select("_box", *[F.col(f).alias(f"p_{f}") for f in features])
    near = squared_distance([(F.col(f), F.col(f"p_{f}")) for f in features]) <= limit

    def hits(rows: DataFrame) -> DataFrame:
        return cut(rows.join(here, "_box").filter(near).select("det_id").distinct(), "hits")

    first = hits(leaves.join(asked, ["det_id", "_box"], "left_semi"))
    rest = leaves.join(asked, ["det_id", "_box"], "left_anti").join(first, "det_id", "left_anti")
    found = inside.unionByName(first).unionByName(hits(rest))
    return candidates.join(found, "det_id", "left_anti")


def radius_flag(df: DataFrame, detectors: DataFrame, features: list[str], radius: float, out: str = "flag") -> DataFrame:
    """1 if any detector is within ``radius`` (inclusive), else 0.

    Distinct row vectors are asked once, as in :func:`radius_anti_join`; the answer
    goes back to all rows of a vector.
    """
    asked = cut(df.select(*features).distinct().withColumn("det_id", F.monotonically_increasing_id()), "asked")
    far = radius_anti_join(asked, detectors, features, radius).select(*features).withColumn("_far", F.lit(1))
    return hand_back(df, asked.drop("det_id").join(far, features, "left"), features).withColumn(
        out, F.when(F.col("_far").isNull(), 1).otherwise(0)
    ).drop("_far")


def home_leaves(queries: DataFrame, tree: BoxTree, features: list[str], k: int) -> DataFrame:
    """(``_query``, features, ``_box``, ``_limit``): a leaf near each query and a squared
    distance within which ``k`` points are certain, NULL if there are fewer points.

    A query goes to the nearest child of ``k`` points or more, and stays one row: the
    children of a box, a few, lie in one row. The farthest corners on the way and the
    kth distance in the leaf are such distances.
    """
    start = {"_box": F.lit(""), "_limit": F.lit(None).cast("double")}
    at = cut(queries.select("_query", *features).withColumns(start), "start")

    def met(box: Column) -> Column:
        inner, outer = _corners(features, lambda name: box[name])
        return F.struct((box["_n"] < k).alias("few"), inner.alias("inner"), outer.alias("outer"), box["_box"].alias("box"))

    for number, (boxes, count) in enumerate(tree.levels, 1):
        children = boxes.groupBy("_parent").agg(F.collect_list(F.struct("_box", "_n", *_bounds(features))).alias("_children"))
        asked = at.withColumnRenamed("_box", "_parent").join(_level(children, count), "_parent", "left")
        at = asked.withColumn("_next", F.array_min(F.transform("_children", met))).select(
            "_query", *features, F.coalesce("_next.box", "_parent").alias("_box"),
            F.least("_limit", F.when(~F.col("_next.few"), F.col("_next.outer"))).alias("_limit"),
        )
        if number % STEPS == 0 or number == len(tree.levels):
            at = cut(at, "home")
    held = tree.points.groupBy("_box").agg(F.collect_list(F.array(*features)).alias("_held"))
    distances = F.transform("_held", lambda v: squared_distance([(F.col(f), v[i]) for i, f in enumerate(features)]))
    kth = F.get(F.array_sort(distances), F.lit(k - 1))
    return at.join(held, "_box", "left").select("_query", *features, "_box", F.least("_limit", kth).alias("_limit"))


def nearest_leaves(queries: DataFrame, tree: BoxTree, features: list[str], k: int) -> DataFrame:
    """The leaves that can hold one of the ``k`` nearest points of each query
    (``_query``, features), with ``_limit``: the squared distance within which ``k``
    points are certain. It is known before the query opens its first box, so
    that few boxes are open at any level."""
    keys = ["_query", "_limit"]
    open_ = _at_root(home_leaves(queries, tree, features, k), keys, features)
    # Written at each level: the code of two levels in one stage is too long to be compiled.
    for level in tree.levels:
        met = _met(open_, level, keys, features, F.lit(False))
        open_ = cut(met.filter(F.col("_limit").isNull() | (F.col("_inner") <= F.col("_limit"))), "met")
    return open_


def nearest(
    queries: DataFrame, points: DataFrame, features: list[str], k: int, payload: str = "y", leaf: int = NEAR_LEAF,
) -> DataFrame:
    """(features, ``neighbours``) per distinct query vector: its ``k`` nearest
    points as sorted structs (d2, id, payload, v), ties by id. Exact.

    A query looks into one leaf near it, which bounds the distance of its ``k`` nearest
    points. Then it goes down the tree of boxes, drops those beyond the bound and looks
    into the leaves that are left. Of equal points only the first ``k`` ids are kept,
    equal queries are asked once. Levels are written to the shared folder, so a lost
    executor repeats part of one or two.
    """
    first = Window.partitionBy(*features).orderBy("id")
    usable = (
        points.select("id", payload, *features)
        .withColumn("_copy", F.row_number().over(first))
        .filter(F.col("_copy") <= k)
        .drop("_copy")
    )
    tree = box_tree(usable, features, max(leaf, k), NEAR_FAN)
    asked = cut(queries.select(*features).distinct().withColumn("_query", F.monotonically_increasing_id()), "queries")
    if not tree.levels[0][1]:
        kind = points.schema["id"].dataType.simpleString()
        return asked.drop("_query").withColumn("neighbours", F.expr(
            f"cast(null as array<struct<d2:double,id:{kind},{payload}:int,v:array<double>>>)"))
    leaves = nearest_leaves(asked, tree, features, k)
    here = tree.points.select("_box", "id", payload, F.array(*features).alias("v"), *[F.col(f).alias(f"p_{f}") for f in features])
    d2 = squared_distance([(F.col(f), F.col(f"p_{f}")) for f in features])
    best = Window.partitionBy("_query").orderBy("d2", "id")
    measured = leaves.join(here, "_box").withColumn("d2", d2)
    inside = measured.filter(F.col("_limit").isNull() | (F.col("d2") <= F.col("_limit"))).select("_query", "d2", "id", payload, "v")
    ranked = inside.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    found = ranked.groupBy("_query").agg(F.array_sort(F.collect_list(F.struct("d2", "id", payload, "v"))).alias("neighbours"))
    return asked.join(cut(found, "found"), "_query").drop("_query")


def hand_back(
    rows: DataFrame, answers: DataFrame, keys: list[str], hot_rows: int = 1_000_000
) -> DataFrame:
    """Join answers, one per key, to all rows of their key.

    Keys of more than ``hot_rows`` rows are joined apart: the rows are not shuffled
    as long as Spark's own size check lets it broadcast the answers of those
    keys, and beyond it skewed partitions are split. The rest is a plain join
    whose keys are all small.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut(counted.filter(F.col("_n") > hot_rows).select(*keys), "hot")
    if hot.isEmpty():
        return rows.join(answers, keys)
    many = rows.join(cut(answers.join(hot, keys, "left_semi"), "hot"), keys)
    few = rows.join(hot, keys, "left_anti").join(answers, keys)
    return many.unionByName(few)


def knn_classify(
    test: DataFrame, train: DataFrame, features: list[str], k: int = 5, hot_rows: int = 1_000_000,
) -> DataFrame:
    """Share of positives among the ``k`` nearest training rows and the majority
    vote. Equal test vectors are looked up once."""
    votes = nearest(test, train, features, k).select(
        *features,
        (F.aggregate("neighbours", F.lit(0.0), lambda acc, n: acc + n["y"]) / F.size("neighbours"))
        .alias("score"),
    )
    return hand_back(test, votes, features, hot_rows).withColumn(
        "pred", (F.col("score") > 0.5).cast("int")
    )
