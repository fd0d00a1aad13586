"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import running_totals, words_count

#: The weights that sources take in turn, by code point, null last.
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    All sizes are shared by weight; a source's target stops at max_epochs
    times its size and the excess is reshared by weight. The fixed point has
    a closed form: with sources in the order of cap / weight, the first ones
    are at their cap and the rest split what is left, at one rate. Sizes are
    summed with map-side combine first; the ranking then runs over one row
    per source, by exact running totals in ranges, so many sources are no
    single task either.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sums.select("source", "source_size", F.col("source").isNull().cast("int").alias("last"), F.lit(1).alias("one"))
    ranked = running_totals(named, "one", ["last", "source"], tag="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    w = ranked.select("source", "source_size", weight.alias("weight"))
    w = w.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = running_totals(w, "cap", ["ratio", "source"], tag="cap").withColumnsRenamed({"before": "caps", "upto": "caps_upto"})
    w = running_totals(w, "weight", ["ratio", "source"], tag="weight")
    w = w.withColumnRenamed("before", "weights").drop("upto", "caps_upto")
    w = write_table(w, "sources")
    total = w.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("all_weights"))
    # The rate is (total - caps before) / (weights not before) at the first
    # source whose ratio reaches it; later ones would give a smaller rate.
    rate = w.crossJoin(F.broadcast(total)).select(
        "ratio", ((F.col("total") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))).alias("rate")
    )
    rate = rate.where("ratio >= rate").agg(F.max("rate").alias("rate"))
    target = F.least("cap", F.col("weight") * F.col("rate"))
    return w.crossJoin(F.broadcast(rate)).select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    max_epochs: int = 3,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "",
    order_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of docs, with size, source_size, target and taken.

    Within its source each document stands at a place given by a hash of its
    id; its virtual finish time is the source's cumulative size up to it
    divided by the source's target, and an epoch later the same plus the
    source's size. All copies are range-sorted by finish time and taken as
    long as their running size stays within the budget, the sum of all sizes.
    `taken` is the size of the copies taken, at most max_epochs times size.

    Null sources are a source of their own; null or empty texts have size 0
    and take nothing. Rows that repeat an id are queued one by one; equal
    finish times go by source, id, epoch. Input columns named like the new
    ones are replaced. An empty table gives an empty one.
    """
    extra = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in extra and c not in (id_col, source_col)]
    base = docs.select(
        F.col(id_col).alias("__q_doc"), F.col(source_col).alias("source"), size.cast("long").alias("size"), *keep
    ).withColumn("__q_rid", F.monotonically_increasing_id())
    base = write_table(base, "mix")
    slim = base.select("__q_rid", "__q_doc", "source", "size", *[F.col(c).alias(f"__q_o{i}") for i, c in enumerate(order_cols)])
    targets = write_table(source_targets(slim, max_epochs, weights), "targets")
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("__q_doc").cast("string"), F.lit("null"))).cast("binary"))
    queued = running_totals(
        slim.withColumn("place", place), "size", ["place", "__q_doc", *[f"__q_o{i}" for i in range(len(order_cols))], "__q_rid"], ["source"], tag="queue"
    )
    right = targets.select(F.col("source").alias("__q_source"), "source_size", "target")
    queued = queued.where("size > 0").join(right, F.col("source").eqNullSafe(F.col("__q_source")))
    copies = queued.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = copies.select("__q_rid", "__q_doc", "source", "size", "epoch", finish.alias("finish"))
    line = running_totals(copies, "size", ["finish", "source", "__q_doc", "epoch", "__q_rid"], tag="line")
    budget = targets.agg(F.sum("source_size").alias("budget"))
    taken = line.crossJoin(F.broadcast(budget)).where("upto <= budget")
    taken = taken.groupBy("__q_rid").agg(F.sum("size").alias("taken"))
    right = right.withColumnRenamed("source_size", "__q_ss").withColumnRenamed("target", "__q_t")
    out = base.join(right, F.col("source").eqNullSafe(F.col("__q_source")), "left").join(taken, "__q_rid", "left")
    return out.select(
        F.col("__q_doc").alias(id_col), F.col("source").alias(source_col), *keep, "size",
        F.col("__q_ss").alias("source_size"), F.col("__q_t").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    out = mix_sources(docs.select("doc_id", "source", words_count(F.col("text")).alias("n")), F.col("n"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight,
         (3 * source_size)::DOUBLE AS cap
  FROM s
), c AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights,
         sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weights
  FROM r
), l AS (
  SELECT max((total - caps) / (all_weights - weights)) AS rate FROM c WHERE ratio >= (total - caps) / (all_weights - weights)
), t AS (
  SELECT source, source_size, coalesce(least(cap, weight * rate), 0.0) AS target FROM c, l
), q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), e AS (
  SELECT doc_id, source, size, epoch, (epoch * source_size + upto)::DOUBLE / target AS finish
  FROM q, range(3) AS g(epoch) WHERE size > 0
), f AS (
  SELECT doc_id, size,
         sum(size) OVER (ORDER BY finish, source NULLS FIRST, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS upto
  FROM e
), k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM f WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k USING (doc_id)
"""
