"""A prepared table that follows its patient files: only parts with new, changed or
removed files are built again.

Files are dealt to a fixed number of parts by a hash of their name. A refresh writes the
changed parts under a new version, then a manifest that names the version of each part
and the digest of each file. Readers go by the last finished manifest, so a refresh that
is killed leaves the earlier table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bedside.operators.blocks import prefix_sums
from bedside.session import cut
from bedside.sources.patient_files import PLACE

MANIFESTS, DATA = "manifest", "data"


def file_digests(lines: DataFrame) -> DataFrame:
    """(file, lines, digest): sums of hashes of the numbered lines, so that no file is
    gathered and the splits it was read in do not matter."""
    sizes = lines.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
    starts = prefix_sums(sizes, ["file"], ["chunk", "split"], ["n"]).drop("n")
    inside = Window.partitionBy(*PLACE).orderBy("pos")
    numbered = lines.withColumn("_r", F.row_number().over(inside)).join(starts, PLACE)
    mark = F.md5(F.concat_ws("|", (F.col("before_n") + F.col("_r")).cast("string"), "value"))

    def part(at: int) -> Column:
        return F.sum(F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")

    return numbered.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.concat_ws("-", part(1), part(16)).alias("digest")
    )


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("file"), F.lit(parts)).cast("int")


def _last_manifest(spark: SparkSession, folder: str) -> int:
    """The number of the last finished manifest, 0 without any."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFESTS}")
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(root):
        return 0
    found = [int(f.getPath().getName()) for f in system.listStatus(root)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return max([n for n in found if system.exists(done(f"{folder}/{MANIFESTS}/{n}/parts/_SUCCESS"))], default=0)


def current_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table by the last finished manifest; None before the first refresh or if no
    part has a row. The manifest has one row per part."""
    last = _last_manifest(spark, folder)
    if not last:
        return None
    rows = spark.read.parquet(f"{folder}/{MANIFESTS}/{last}/parts").filter("version IS NOT NULL").collect()
    paths = [f"{folder}/{DATA}/{r['version']}/part={r['part']}" for r in rows]
    return spark.read.parquet(*paths) if paths else None


def refresh(
    lines: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame], settings: dict[str, str], parts: int = 64
) -> list[int]:
    """Bring the table under ``folder`` up to date with ``lines`` and return the parts
    that were built.

    ``build`` makes rows with a column ``file`` from the lines of some files, each file
    by itself. Other ``settings``, or another number of parts, rebuild everything. One
    refresh runs at a time.
    """
    spark = lines.sparkSession
    wanted = cut(file_digests(lines).select("file", "digest", part_of(parts).alias("part")), "digests")
    about = json.dumps(settings | {"parts": str(parts)}, sort_keys=True)
    last, versions, same = _last_manifest(spark, folder), {}, False
    if last:
        rows = spark.read.parquet(f"{folder}/{MANIFESTS}/{last}/parts").collect()
        same = all(r["about"] == about for r in rows)
    if same:
        versions = {r["part"]: r["version"] for r in rows}
        known = spark.read.parquet(f"{folder}/{MANIFESTS}/{last}/files").select(
            "file", F.col("digest").alias("_old"), F.col("part").alias("_part")
        )
        off = wanted.join(known, "file", "full").filter(~F.col("digest").eqNullSafe(F.col("_old")))
        changed = off.select(F.coalesce("part", "_part").alias("part"))
    else:
        changed = wanted.select("part")
    changed = sorted(r["part"] for r in changed.distinct().collect())  # at most ``parts``
    if same and not changed:
        return []
    version = uuid.uuid4().hex
    rows = build(lines.filter(part_of(parts).isin(changed))).withColumn("part", part_of(parts))
    path = f"{folder}/{DATA}/{version}"
    rows.hint("rebalance", "part").write.partitionBy("part").parquet(path)
    filled = {r["part"] for r in spark.read.schema("part int").parquet(path).select("part").distinct().collect()}
    versions |= {p: version if p in filled else None for p in changed}
    manifest = f"{folder}/{MANIFESTS}/{last + 1}"
    wanted.write.mode("overwrite").parquet(f"{manifest}/files")
    listed = [(p, versions.get(p), about) for p in range(parts)]
    spark.createDataFrame(listed, "part int, version string, about string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{manifest}/parts")
    return changed
