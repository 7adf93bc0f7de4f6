"""Outputs: patient files, cohort extracts, result tables, keyed tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bedside.functions.hashing import content_keys
from bedside.operators.blocks import BLOCK, block_of
from bedside.session import cut
from bedside.sources.patient_files import (
    INDEX, PACKED, PLACE, SECTION_END, bare_name, positive_files, section_index,
)


def write_packed(lines: DataFrame, path: str) -> None:
    """Write (file, chunk, split, at, value) as packed patient files, replacing earlier
    ones, and an index beside them.

    A section holds the lines of one (file, chunk, split) in the order of ``at``; many
    sections share a text file, so files and folders depend on the bytes and not on the
    patients. Callers keep sections to at most some 65536 lines.
    """
    spark = lines.sparkSession
    texts = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"])
    head = F.concat(
        F.lit("file="), "file", F.lit("/chunk="), F.col("chunk").cast("string"),
        F.lit("/split="), F.col("split").cast("string"),
    )
    sections = lines.groupBy(*PLACE).agg(texts.alias("texts"))
    (
        sections.sortWithinPartitions(*PLACE)
        .select(F.concat(head, F.lit("\n"), F.array_join("texts", "\n")).alias("value"))
        .write.mode("overwrite").option("lineSep", SECTION_END).text(f"{path}/{PACKED}")
    )
    section_index(spark, path).write.mode("overwrite").parquet(f"{path}/{INDEX}")


def write_patient_files(
    chart: DataFrame, path: str, columns: dict[str, str], name: Column, delimiter: Column | str = "|",
    size: int = BLOCK,
) -> None:
    """Write a chart as packed delimited text, a section per patient and block of rows,
    the header on top of a patient's first. ``columns`` maps chart columns to header
    names; ``name`` is the patient's file name."""
    mark = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in columns]
    line = F.call_function("concat_ws", mark, *cells)
    header = F.call_function("concat_ws", mark, *[F.lit(c) for c in columns.values()])
    text = F.when(F.col("t") == 0, F.concat(header, F.lit("\n"), line)).otherwise(line)
    rows = chart.select(
        name.alias("file"), block_of(size=size).cast("long").alias("chunk"), F.lit(0).cast("long").alias("split"),
        F.col("t").alias("at"), text.alias("value"),
    )
    write_packed(rows, path)


def extract_positive_cohort(
    lines: DataFrame, path: str, label: str, expected: int | None = None
) -> DataFrame:
    """Copy out positive patients as packed files that the readers read again,
    replacing earlier output, and return one row (found, expected, as_expected).

    A split of a long file becomes sections of at most 65536 lines; they are numbered
    by the split's place in the file and their own in the split, which keeps the order.
    """
    ids = cut(positive_files(lines, label), "positive")
    starts = lines.groupBy(*PLACE).agg(F.min("pos").alias("first")).join(ids, "file", "left_semi")
    rows = lines.join(starts, PLACE).select(
        bare_name().alias("file"), (F.col("chunk") * F.lit(1 << 40) + F.col("split")).alias("chunk"),
        F.floor((F.col("pos") - F.col("first")) / BLOCK).alias("split"), F.col("pos").alias("at"), "value",
    )
    write_packed(rows, path)
    return ids.agg(F.count(F.lit(1)).alias("found")).withColumns(
        {
            "expected": F.lit(expected).cast("long"),
            "as_expected": F.coalesce(F.col("found") == F.lit(expected), F.lit(True)),
        }
    )


def write_results_csv(df: DataFrame, path: str) -> DataFrame:
    """Write with a header and no index; return the table as read back."""
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.schema(df.schema).csv(path, header=True)


def save_stats(stats: DataFrame, path: str) -> DataFrame:
    """Write (feature, mean, std) for later jobs; one row per feature."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)
    return load_stats(stats.sparkSession, path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("feature", "mean", "std")


def write_reports(reports: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write each analysis under one folder; return them as read back."""
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: report.sparkSession.read.parquet(f"{path}/{name}") for name, report in reports.items()}


def content_digest(df: DataFrame, column: str) -> str:
    """One md5 over the distinct strings of a column, whatever their order."""
    keys = content_keys(df.select(F.lit(0).alias("_all"), column), ["_all"], column).first()
    return keys["key"] if keys else ""


def keyed_table(
    spark: SparkSession, folder: str, key: str, metadata: dict[str, str], build: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """The table stored under ``key`` and whether it was reused, by this application
    or an earlier one. It is built if absent, or if its metadata, written after
    the table and so last, is absent or differs."""
    table, about = f"{folder}/key={key}/table", f"{folder}/key={key}/about"
    wanted = json.dumps(metadata, sort_keys=True)
    try:
        if [r["value"] for r in spark.read.text(about).collect()] == [wanted]:
            return spark.read.parquet(table), True
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(table)
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(about)
    return spark.read.parquet(table), False
