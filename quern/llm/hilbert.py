"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import running_totals, utf8_size


def rank_levels(df: DataFrame, col: str, bits: int) -> DataFrame:
    """(value, level): values of `col` in order, null first, each at the share
    of rows that come before it, in 2**bits levels. Counts are combined map-side;
    one row per value goes into the running totals."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, "n", ["value"], tag="levels")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))
    level = F.floor(F.col("before") * (1 << bits) / F.col("total")).cast("long")
    return placed.crossJoin(total).select("value", level.alias("level"))


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str = "curve") -> DataFrame:
    """df with the Hilbert curve index of its integer columns `dims`, each in
    0 .. 2**bits - 1 (Skilling's transform, as DataFrame expressions)."""
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p = q - 1
        set_ = F.get(x, i).bitwiseAND(q) != 0
        t = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, i)).bitwiseAND(p)
        swapped = F.transform(x, lambda v, j: F.when((j == 0) != (j == i), v.bitwiseXOR(t)).otherwise(v))
        turned = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(p)).otherwise(v))
        return F.when(set_, turned).otherwise(swapped)

    axes = F.array(*[F.col(d).cast("long") for d in dims])
    out = df.withColumn("__q_x", F.aggregate(steps, axes, undo) if bits > 1 else axes)
    gray = [reduce(Column.bitwiseXOR, [F.get("__q_x", F.lit(j)) for j in range(i + 1)]) for i in range(n)]
    out = out.withColumn("__q_g", F.array(*gray))
    last = F.get("__q_g", F.lit(n - 1))
    flips = [F.when(last.bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)) for q in range(1, bits)]
    t = reduce(Column.bitwiseXOR, flips, F.lit(0)).cast("long")
    out = out.withColumn("__q_t", t)
    index = F.lit(0).cast("long")
    for q in range(bits):
        for i in range(n):
            bit = F.shiftright(F.get("__q_g", F.lit(i)).bitwiseXOR(F.col("__q_t")), q).bitwiseAND(F.lit(1))
            index = index + F.shiftleft(bit.cast("long"), q * n + (n - 1 - i))
    return out.withColumn(name, index).drop("__q_x", "__q_g", "__q_t")


def hilbert_shards(
    docs: DataFrame,
    n_shards: int = 24,
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null), curve and the levels `dim_*`.

    The dimensions are the columns `dims` and the text's size, each by rank
    (the share of rows with a lesser value) in 2**bits levels. Rows are range-sorted by curve index,
    text hash and id, so copies under the same metadata stay together, and
    the run is cut into n_shards of row counts at most one apart (law rows).
    Positions come from exact running totals over ranges; no task holds more
    than its range, and a hot value or text spreads over as many as it fills.

    Null metadata is a level of its own (first); a null text has size 8 and
    crc32 0; repeated rows take slots one by one; an empty table gives an
    empty one. Other columns are left out; join them by id.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (utf8_size(F.col(text_col)) + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *[F.col(d).alias(f"__q_{i}") for i, d in enumerate(dims)],
    ).withColumn(f"__q_{len(dims)}", F.col("size"))
    base = write_table(base, "hilbert")
    out = base
    for i in range(len(dims) + 1):
        levels = rank_levels(base.select(f"__q_{i}"), f"__q_{i}", bits).withColumnsRenamed({"value": "__q_v", "level": f"dim_{i}"})
        levels = write_table(levels, "levels")  # a side of its own, so that a hot value's rows can be split
        out = out.join(levels, F.col(f"__q_{i}").eqNullSafe(F.col("__q_v")), "left").drop("__q_v", f"__q_{i}")
    names = [f"dim_{i}" for i in range(len(dims) + 1)]
    placed = running_totals(
        hilbert_index(out, names, bits).withColumn("one", F.lit(1)), "one", ["curve", "text_hash", "doc_id"], tag="curve"
    )
    total = F.broadcast(base.agg(F.count(F.lit(1)).alias("total")))
    placed = placed.crossJoin(total)
    placed = placed.withColumn("shard", F.expr(f"cast(before * {n_shards} div total as int)"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", *names,
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> None:
    """docs as Parquet under path/shard=N, each shard one curve run: files
    with narrow ranges in every dimension, which readers prune."""
    shards = hilbert_shards(docs, id_col=id_col, **options).select(F.col("doc_id").alias("__q_id"), "shard", "slot")
    rows = docs.drop("shard").join(shards, F.col(id_col).eqNullSafe(F.col("__q_id"))).drop("__q_id")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
    rows.write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame) -> DataFrame:
    return hilbert_shards(docs.select("doc_id", "text", "lang", "source"))
