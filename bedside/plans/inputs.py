"""Charts and other inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bedside.operators.blocks import block_window, in_blocks, number_rows, own_rows
from bedside.operators.tabular import mean_impute, standard_scale, stratified_split
from bedside.session import cut, stored

STAY_FEATURES = ["click", "engage", "signup", "anyv", "refund"]
POINT_FEATURES = ["click", "engage", "signup", "anyv"]
CATEGORIES = {"VITAL": ["anyv", "engage"], "LAB": ["click", "signup", "refund"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_stay(events: DataFrame) -> DataFrame:
    """Hourly chart per user. Events are averaged per hour before any row of a
    user meets another; rows are numbered month by month. The hours are written
    once, since numbering reads them twice."""
    kind, value = F.col("event_type"), F.col("value")
    hours = events.groupBy(
        F.col("user_id").cast("long").alias("pid"), F.date_trunc("hour", "ts").alias("h")
    ).agg(
        F.avg(F.when(kind == "click", value)).alias("click"),
        F.avg(F.when(kind.isin("view", "purchase"), value)).alias("engage"),
        F.avg(F.when(kind == "signup", value)).alias("signup"),
        F.avg(value).alias("anyv"),
        F.avg(F.when(kind == "refund", value)).alias("refund"),
        F.max(F.when((kind == "error") & (value > 150), 1).otherwise(0)).alias("hit"),
    )
    chart = number_rows(cut(hours, "hours"), ["pid"], ["h"], [F.date_trunc("month", "h")])
    recent = block_window().rowsBetween(-5, Window.currentRow)
    labelled = in_blocks(chart, back=5).withColumn("y", F.max("hit").over(recent))
    return own_rows(labelled).select("pid", "t", *STAY_FEATURES, F.col("y").cast("int").alias("y"))


def stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart is ingested once to Parquet; every analysis scans the columns it needs."""
    return stored(spark, f"stay:{sf_dir}", lambda: build_stay(table(spark, sf_dir, "events")))


ITEM_COLUMNS = ["qty", "price", "disc", "tax", "qf", "y"]


def build_items(lineitem: DataFrame, orders: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Line items of a customer as one long chart, numbered by ship date and by
    range of order keys within a date. The join is written once, since numbering
    reads it twice. ``columns`` are made before the join, so it and the numbering carry
    these and the order alone."""
    made = {
        "qty": F.col("l_quantity"),
        "price": F.col("l_extendedprice"),
        "disc": F.expr("nullif(l_discount, 0)"),
        "tax": F.expr("nullif(l_tax, 0)"),
        "qf": F.when(F.col("l_linestatus") == "F", F.col("l_quantity")),
        "y": F.when(F.col("l_returnflag") == "R", 1).otherwise(0),
    }
    columns = columns or ITEM_COLUMNS
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    narrow = lineitem.select(*order, *[made[c].alias(c) for c in columns])
    lines = narrow.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("long").alias("pid"), *order, *columns
    )
    blocks = [F.col("l_shipdate"), F.floor(F.col("l_orderkey") / (1 << 20))]
    return number_rows(cut(lines, "lines"), ["pid"], order, blocks).select("pid", "t", *columns)


def items(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The chart of line items, or a narrower one with the ``columns`` asked for."""
    return stored(
        spark,
        f"items:{sf_dir}:{','.join(columns or ITEM_COLUMNS)}",
        lambda: build_items(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), columns),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture outputs: three fixed weights; the logits are means over the thirds of
    the vector, so that every dimension counts."""
    vector = F.col("embedding").cast("array<double>")

    def third(i: int) -> Column:
        part = F.slice(vector, 21 * i + 1, 21 if i < 2 else 22)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) * 4.0

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("pis"),
        F.array(*[third(i) for i in range(3)]).alias("mus"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
    )


def row_key() -> Column:
    """One text per row of a chart, whatever the length of a patient."""
    return F.concat_ws(":", F.col("pid").cast("string"), F.col("t").cast("string"))


def build_points(chart: DataFrame) -> DataFrame:
    """Scaled vectors: imputed on all rows, split by class, scaled on the training
    rows. Rounded, so that equal distances are equal in any engine."""
    ids = row_key().alias("id")
    filled = mean_impute(chart.select(ids, "pid", "t", "y", *POINT_FEATURES), POINT_FEATURES)
    split = cut(stratified_split(filled, "y", [F.col("pid"), F.col("t")]), "split")
    scaled = standard_scale(split, POINT_FEATURES, split.filter("NOT is_test"))
    return scaled.select(
        "id", "y", "is_test", *[F.round(f, 6).alias(f) for f in POINT_FEATURES]
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"points:{sf_dir}", lambda: build_points(stay(spark, sf_dir)))


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = points(spark, sf_dir)
    return rows.filter("NOT is_test").drop("is_test"), rows.filter("is_test").drop("is_test")


def categories(spark: SparkSession) -> DataFrame:
    """(category, category_ord, feature, feature_ord) of the ``stay`` chart."""
    rows = [
        (category, i, feature, j)
        for i, (category, features) in enumerate(CATEGORIES.items())
        for j, feature in enumerate(features)
    ]
    return spark.createDataFrame(
        rows, "category string, category_ord int, feature string, feature_ord int"
    )
