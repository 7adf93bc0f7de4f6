"""Spark session for scripts and tests, and the folder tables are cut to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_TABLES: dict[tuple[str, str], str] = {}


def build_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster use the session the cluster provides."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bedside")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a fresh folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _LOCAL_DIRS:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        _LOCAL_DIRS[sc.applicationId] = path
    return _LOCAL_DIRS[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path; all paths of one application lie in one folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/bedside-{app}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def stored(spark: SparkSession, key: str, build) -> DataFrame:
    """The table ``key`` of this application, built and written on first use."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _TABLES:
        path = new_path(spark, "table")
        build().write.parquet(path)
        _TABLES[slot] = path
    return spark.read.parquet(_TABLES[slot])
