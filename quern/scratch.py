"""Whole tables in the folder that driver and executors share.

Iterative operators cut their lineage here: a written table survives lost
executors and freezes what one execution decided.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_shared: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where there is none and all of
    Spark runs in one process (tests) is a local folder made and set."""
    global _own_shared
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_shared is None:
        _own_shared = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.sparkContext.setCheckpointDir(_own_shared)
    return _own_shared


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quern/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
