"""Incremental jobs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """A folder of files as a stream; schemas are stated, never inferred."""
    return spark.readStream.format(fmt).options(**options).schema(schema).load(path)


def debounced(changes: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of changes of a path (path, ts): a burst ends after
    a silent gap."""
    return (
        changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), "path")
        .agg(F.count(F.lit(1)).alias("changes"))
        .select("path", F.col("burst.start").alias("first"), F.col("burst.end").alias("settled"), "changes")
    )


def windowed(vitals: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and largest value by metric and window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = vitals.withWatermark("ts", late).groupBy(w.alias("w"), "metric")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return out.select("metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "most")


def first_of_key(rows: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Insert-or-ignore over a stream: the first row of a key, state kept for
    as long as rows may be late."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def running(stream_df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a query that hands each batch to the sink. With `once` it takes
    what is there and ends; a batch that is repeated after a failure has the
    same number, so sinks key on it or replace what they wrote."""
    writer = stream_df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replace_sessions(path: str, key: str = "session_id") -> Callable[[DataFrame, int], None]:
    """A sink that replaces the whole sessions of a batch: late and grown
    sessions are derived anew, and a repeated batch changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        merge.write_partitions(batch, path, [key])

    return sink


def changed_sessions(batch: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows of the sessions whose digest (session_id, digest) is new."""
    return merge.missing_from(batch, digests, ["session_id", "digest"])


def alarms(vitals: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Vitals above their metric's limit."""
    limit = F.lit(None).cast("double")
    for metric, most in limits.items():
        limit = F.when(F.col("metric") == metric, most).otherwise(limit)
    return vitals.withColumn("limit", limit).where(F.col("value") > F.col("limit"))


def expired(staged: DataFrame, now: str, tick: int) -> DataFrame:
    """Staged rows with those whose time to live has passed tombstoned at a
    fresh tick; the first stamp stays."""
    gone = F.col("ttl_wall").isNotNull() & (F.to_timestamp("ttl_wall") <= F.to_timestamp(F.lit(now)))
    return merge.tombstone_staged(staged, gone, tick)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n, value): bursts of a user's events."""
    out = events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")


def new_versions(path: str, checkpoint_schema: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends versions (doc_id, digest, at) after the ones that
    the folder has; a batch that was landed before is skipped."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.schema(f"{checkpoint_schema}, batch LONG").parquet(path)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = spark.createDataFrame([], f"{checkpoint_schema}, batch LONG")
        if have.where(F.col("batch") == number).isEmpty():
            old = have.drop("batch")
            fresh = merge.next_versions(old, batch, ["at", "digest"])
            fresh = merge.missing_from(fresh, old, ["doc_id", "version_seq"])
            fresh.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    return sink
