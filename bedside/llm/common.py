"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bedside.session import cut

#: ASCII white space as the contracts name it, for Java patterns.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True for the fold that no label is learned from; a null id is held out."""
    crc = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))
    return F.coalesce(crc % folds == 0, F.lit(True))


def one_row(df: DataFrame) -> dict:
    """The single row of an aggregate."""
    return df.first().asDict()


def prefix_sums(df: DataFrame, order: list[Column], weight: str, name: str) -> DataFrame:
    """Add ``rank`` (from 0) and ``before`` (sum of ``weight`` over all earlier rows).

    Rows are range-partitioned by ``order`` and written once with their
    partition; only one total per partition meets in a single task. ``order``
    must tell rows apart, or tied rows must be alike.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()), name)
    totals = placed.groupBy("_part").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    rows_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range shuffle: its number is a setting, not data.
    return (
        placed.withColumn("_in", F.coalesce(F.sum(weight).over(rows_before), F.lit(0)))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_n0") + F.col("_row"))
        .withColumn("before", F.col("_w0") + F.col("_in"))
        .drop("_part", "_w0", "_n0", "_in", "_row")
    )
