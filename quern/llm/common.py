"""What the training-data operators share: words, sizes and exact running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import partitions, write_table

#: ASCII white space, as `[\x20\x09-\x0D]`, for trim() and in patterns.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def fold_ascii(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, UPPER.lower())


def words_count(col: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8_size(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def running_totals(
    df: DataFrame, value: str, order: list[str], by: list[str] | None = None, tag: str = "run"
) -> DataFrame:
    """df with `before` and `upto`: the exact sums of `value` over the rows
    that stand before each row (and up to it) in `order`, within `by`.

    A plain window over `by` would put a hot group, or all rows, into one
    task. Here rows are dealt by range of (by, order), each range sums its
    own rows, and the ranges' totals (one row per range and group) give the
    offsets. Nulls sort first. Rows that are equal in `by` and `order` must
    be interchangeable.
    """
    by = by or []
    spark = df.sparkSession
    keys = [F.col(c) for c in by + order]
    dealt = df.repartitionByRange(partitions(spark), *keys).withColumn("__q_range", F.spark_partition_id())
    # Read again, each range goes to a task of its own; the windows need no
    # other shuffle.
    dealt = write_table(dealt, tag).repartitionById(partitions(spark), "__q_range")
    inside = Window.partitionBy("__q_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("__q_sum", F.sum(value).over(inside))
    ranges = dealt.groupBy("__q_range", *by).agg(F.sum(value).alias("__q_total"))
    earlier = Window.partitionBy(*[F.col(c) for c in by]).orderBy("__q_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__q_offset", F.coalesce(F.sum("__q_total").over(earlier), F.lit(0)))
    ranges = ranges.select(
        F.col("__q_range").alias("__q_r"), *[F.col(c).alias(f"__q_b{i}") for i, c in enumerate(by)], "__q_offset"
    )
    cond = F.col("__q_range") == F.col("__q_r")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__q_b{i}"))
    joined = rows.join(ranges, cond)
    upto = F.col("__q_offset") + F.col("__q_sum")
    return joined.select(*df.columns, (upto - F.col(value)).alias("before"), upto.alias("upto"))
