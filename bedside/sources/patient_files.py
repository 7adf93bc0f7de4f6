"""Per-patient delimited files as one table of numbered lines.

Files are read line by line and may be split, so one huge file is read by many
tasks. The lines are ingested once to Parquet with their place (file, chunk,
split, order in the split); numbering and header lookup then work per split.

A patient is a file ``p1.psv`` of the folder, or sections of the packed files that
:func:`bedside.sources.sinks.write_packed` writes into the folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bedside.functions.cells import cell_present, label_is_one, split_line, to_number, trimmed
from bedside.operators.blocks import number_rows, prefix_sums
from bedside.session import cut
from bedside.sources.quoted import quoted_records, split_cells

PLACE = ["file", "chunk", "split"]


PLAIN = r"^([^/=]+\.(?:psv|csv))$"  # a file of the folder itself

# Packed files: subfolder, index beside it, what ends a section, and its first line.
PACKED, INDEX, SECTION_END = "packed", "packed-index", "\x1e"
SECTION_HEAD = r"^file=([^\n]*)/chunk=(\d+)/split=(\d+)\n"


def ingest_lines(spark: SparkSession, path: str | list[str], pattern: str = r"^p.*\.psv$") -> DataFrame:
    """The placed lines, written once so that all later steps see the same splits."""
    return cut(placed_lines(spark, path, pattern), "lines")


def ingest_records(spark: SparkSession, path: str | list[str], pattern: str = r"\.(psv|csv)$") -> DataFrame:
    """The same with records of quoted cells over several lines as one line each."""
    return cut(quoted_records(ingest_lines(spark, path, pattern)), "records")


def placed_lines(spark: SparkSession, path: str | list[str], pattern: str = r"^p.*\.psv$") -> DataFrame:
    """(file, chunk, split, pos, value) of the files whose name matches.

    Only files of the folder itself are read, besides packed ones of our own writer,
    so a name is met once and is the key ``file``. Of several folders the key is
    ``<folder>/<name>``: equal names stay apart.
    Rows of one split come from one task in file order, so
    ``monotonically_increasing_id`` orders them there; it is compared within a
    split only.
    """
    if isinstance(path, str):
        return _folder_lines(spark, path, pattern)
    each = [
        _folder_lines(spark, p, pattern).withColumn("file", F.concat(F.lit(p.rstrip("/") + "/"), F.col("file")))
        for p in path
    ]
    return reduce(DataFrame.unionByName, each)


def _folder_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = system.makeQualified(folder).toUri().getRawPath().rstrip("/") + "/"
    full = F.regexp_extract(F.col("_metadata.file_path"), r"^[^:/]+:(?://[^/]*)?(/.*)$", 1)
    inside = F.when(full.startswith(root), F.substring(full, len(root) + 1, 1 << 20)).otherwise("")
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.{psv,csv}"}
    lines = spark.read.options(**options).text(path).select(
        F.regexp_extract(inside, PLAIN, 1).alias("file"),
        F.lit(0).cast("long").alias("chunk"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )
    found = lines.filter(F.col("file").rlike(pattern))
    packed = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{PACKED}")
    if not system.exists(packed):
        return found
    return found.unionByName(_section_lines(_sections(spark, path).filter(F.col("file").rlike(pattern))))


def _sections(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """(file, chunk, split, part, block, value): the packed sections, each read whole by
    one task; files may be split between sections."""
    folder = f"{path.rstrip('/')}/{PACKED}"
    raw = spark.read.option("lineSep", SECTION_END).text(
        folder if parts is None else [f"{folder}/{part}" for part in parts]
    )
    number = [F.regexp_extract("value", SECTION_HEAD, i).try_cast("long") for i in (2, 3)]
    return raw.select(
        F.regexp_extract("value", SECTION_HEAD, 1).alias("file"), number[0].alias("chunk"), number[1].alias("split"),
        F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), "value",
    )


def _section_lines(sections: DataFrame) -> DataFrame:
    texts = F.split("value", "\n", -1)
    body = F.slice(texts, F.lit(2), F.size(texts) - 1)
    return sections.select(*PLACE, F.posexplode(body).alias("pos", "value")).select(
        *PLACE, F.col("pos").cast("long").alias("pos"), "value"
    )


def section_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, split, part, offset, length): where each section's bytes lie in
    the packed file ``part``. Only sizes are sorted, those of one file together."""
    rows = _sections(spark, path).select(
        *PLACE, "part", "block", F.monotonically_increasing_id().alias("_i"),
        F.octet_length("value").cast("long").alias("length"),
    )
    earlier = Window.partitionBy("part").orderBy("block", "_i").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") + 1).over(earlier), F.lit(0))
    return rows.withColumn("offset", offset).select(*PLACE, "part", "offset", "length")


def patient_lines(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """The placed lines of the packed patients listed in ``names`` (``file``): the index
    tells which packed files hold them, and no other is opened. The names of those
    files, of which a folder holds one per some 100 MB, come to the driver."""
    wanted = names.select("file").distinct()
    index = spark.read.parquet(f"{path.rstrip('/')}/{INDEX}").join(wanted, "file", "left_semi")
    parts = sorted(r["part"] for r in index.select("part").distinct().collect())
    if not parts:
        return _section_lines(_sections(spark, path).limit(0))
    return _section_lines(_sections(spark, path, parts).join(wanted, "file", "left_semi"))


def bare_name(file: str = "file") -> Column:
    """The name of a file without its folder."""
    return F.regexp_extract(file, r"([^/]+)$", 1)


def scan_patient_files(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Files sorted by key with their line counts, the first ``limit`` if given
    (0 and None mean all)."""
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    return files.orderBy("file").limit(limit) if limit else files


def limit_files(lines: DataFrame, limit: int | None) -> DataFrame:
    """Lines of the first ``limit`` files by name: each line is compared with the
    last kept name, so no file's lines have to meet."""
    if not limit:
        return lines
    names = lines.select("file").distinct().orderBy("file").limit(limit)
    return lines.filter(F.col("file") <= names.agg(F.max("file")).scalar())


def delimiter_split(line: Column) -> Column:
    """Split by the file's kind: ``|`` for .psv, a comma outside quoted cells for .csv."""
    plain = F.when(F.contains(line, F.lit('"')), split_cells(trimmed(line))).otherwise(split_line(line, ","))
    return F.when(F.col("file").endswith(".psv"), split_line(line)).otherwise(plain)


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split with the number of lines before it in its file."""
    sizes = lines.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(sizes, ["file"], ["chunk", "split"], ["n"]).drop("n")


def _first_lines(lines: DataFrame) -> DataFrame:
    """First line of each file, looked for in its first split only."""
    start = lines.filter("chunk = 0 AND split = 0")
    return start.groupBy("file").agg(F.min_by("value", "pos").alias("first_line"))


def headers(lines: DataFrame) -> DataFrame:
    """(file, header) with the header as an array of names."""
    return _first_lines(lines).select("file", delimiter_split(F.col("first_line")).alias("header"))


def discover_headers(lines: DataFrame) -> DataFrame:
    """All column names of all files."""
    return headers(lines).select("header").distinct().select(F.explode("header").alias("name")).distinct()


def data_lines(lines: DataFrame) -> DataFrame:
    """(PLACE, pos, line_no, values, blank, header) without header lines.

    Numbering and the joined split table share one shuffle by split. The header
    is the first line of the file's first split, which lies in the same task;
    only for files read in several splits is it looked up and handed to the
    other splits.
    """
    splits = _splits(lines)
    later = splits.filter("before_n > 0").select("file").distinct()
    handed = _first_lines(lines.join(later, "file", "left_semi"))
    table = splits.join(handed, "file", "left")
    inside = Window.partitionBy(*PLACE).orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("before_n") == 0, F.col("_top")).otherwise(F.col("first_line"))
    return (
        lines.withColumns({"_r": F.row_number().over(inside), "_top": F.first("value").over(upto)})
        .join(table, PLACE)
        .withColumn("line_no", F.col("before_n") + F.col("_r") - 1)
        .filter("line_no > 0")
        .select(
            *PLACE, "pos", "line_no",
            delimiter_split(F.col("value")).alias("values"),
            (trimmed(F.col("value")) == "").alias("blank"),
            delimiter_split(own).alias("header"),
        )
    )


def _named(name: str) -> Column:
    """Value of a column by the file's own header; NULL if absent or cut short."""
    return F.get("values", F.array_position("header", name).cast("int") - 1)


def read_by_name(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """(file, t, wanted...): columns matched by each file's own header, absent
    ones NULL, text that is no number NULL. Blank lines are skipped before rows
    are numbered."""
    rows = data_lines(lines).filter("NOT blank").select(
        *PLACE, "pos", *[to_number(_named(c)).alias(c) for c in wanted]
    )
    return number_rows(rows, ["file"], ["chunk", "split", "pos"], [F.col("chunk"), F.col("split")]).select(
        "file", "t", *wanted
    )


def read_positional(lines: DataFrame, header: list[str]) -> DataFrame:
    """(file, t, header...) as text: one header applied to all files by position.
    Short lines lack their tail and blank lines count as rows."""
    return data_lines(lines).select(
        "file", (F.col("line_no") - 1).cast("int").alias("t"),
        *[F.get("values", F.lit(i)).alias(name) for i, name in enumerate(header)],
    )


def read_text_by_name(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """(file, t, wanted...) as text, matched by each file's own header; blank
    lines count as rows."""
    return data_lines(lines).select(
        "file", (F.col("line_no") - 1).cast("int").alias("t"), *[_named(c).alias(c) for c in wanted]
    )


def presence_chart(text: DataFrame, features: list[str], label: str) -> DataFrame:
    """A chart of text rows for the frequency analyses: 1 where a cell counts as
    present, ``y`` by the label's text, NULL on rows too short to have one."""
    seen = {f: F.when(cell_present(F.col(f)), 1.0) for f in features}
    y = F.when(F.col(label).isNotNull(), label_is_one(F.col(label)).cast("int"))
    return text.select(
        F.col("file").alias("pid"), "t", *[c.alias(f) for f, c in seen.items()], y.alias("y")
    )


def read_union(lines: DataFrame) -> DataFrame:
    """:func:`read_by_name` for the union of all headers, in name order. Only the
    column names come to the driver."""
    names = sorted(r["name"] for r in discover_headers(lines).collect())
    return read_by_name(lines, names)


def positive_files(lines: DataFrame, label: str) -> DataFrame:
    """Files with any label text ``1``; files without the label column have none."""
    return data_lines(lines).filter(_named(label) == "1").select("file").distinct()
