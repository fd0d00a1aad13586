"""Guarded projections and point-in-time views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MIRROR, refuse


def scan(table: DataFrame, provenances: tuple[str, ...] | None, order: list[str] | None = None) -> DataFrame:
    """Rows of the provenances: None is all, an empty set is none."""
    if provenances is not None:
        table = table.where(F.col("provenance").isin(*provenances)) if provenances else table.where(F.lit(False))
    return table.orderBy(*order) if order else table


@dataclass(frozen=True)
class GuardedView:
    """Rows of a closed set of provenances; `rows` has no other."""

    rows: DataFrame
    allowed: tuple[str, ...] = MIRROR

    @classmethod
    def project(cls, source: DataFrame, allowed: tuple[str, ...] = MIRROR) -> GuardedView:
        return cls(scan(source, allowed), allowed)

    @classmethod
    def of(cls, rows: DataFrame, allowed: tuple[str, ...] = MIRROR) -> GuardedView:
        """Rows that claim to be clean already: one that is not raises."""
        refuse(rows, ~F.col("provenance").isin(*allowed), "a row of another provenance")
        return cls(rows, allowed)


def visible_at(staged: DataFrame, generation: int | Column) -> DataFrame:
    """Rows staged by a generation and not yet tombstoned at it."""
    g = F.lit(generation) if isinstance(generation, int) else generation
    return staged.where((F.col("generation") <= g) & (F.col("tombstoned_at_gen").isNull() | (F.col("tombstoned_at_gen") > g)))


def latest_per(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value that is last in `order`."""
    return table.groupBy(key).agg(F.max_by(value, order).alias(value))


def retracted(verdicts: DataFrame) -> DataFrame:
    """Subjects whose latest disposition is a retraction."""
    return latest_per(verdicts, "subject_id", "effect", "verdict_seq").where("effect = 'RETRACT'").select("subject_id")


def active(table: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """Rows that nothing supersedes or retracts."""
    marks = gone.select(F.col(gone_key).alias("__gone"))
    return table.join(marks, F.col(key) == F.col("__gone"), "left_anti")


def references(edges: DataFrame, commit: str | None = None, to: str | None = None, of: str | None = None, direction: str | None = None) -> DataFrame:
    """Reference edges that meet all the conditions given."""
    out = edges.withColumn("direction", F.concat_ws("_to_", "source_kind", "target_kind"))
    for col, value in (("commit_sha", commit), ("target_ref", to), ("source_ref", of), ("direction", direction)):
        if value is not None:
            out = out.where(F.col(col) == value)
    return out


def trajectory(snapshots: DataFrame, metric: str, allowed: tuple[str, ...]) -> DataFrame:
    """(taken_at, value) of one of the allowed metrics, in time order."""
    if metric not in allowed:
        raise ValueError(f"unknown metric {metric}")
    return snapshots.where(F.col(metric).isNotNull()).select("taken_at", F.col(metric).alias("value")).orderBy("taken_at")


def version_history(versions: DataFrame) -> DataFrame:
    """versions with `current` (the last of its document) and the digest
    that supersedes each."""
    w = Window.partitionBy("doc_id").orderBy("version_seq")
    after = F.lead("digest").over(w)
    return versions.withColumns({"superseded_by": after, "current": after.isNull()})


def sequence_gaps(table: DataFrame, seq: str, by: list[str] | None = None) -> DataFrame:
    """Missing numbers between the least and the largest, by group."""
    by = by or []
    nxt = F.lead(seq).over(Window.partitionBy(*by).orderBy(seq)) if by else None
    if nxt is None:
        from ..functions.ranks import global_rank

        ranked = global_rank(table.select(seq).distinct(), [seq], "__i")
        after = ranked.select((F.col("__i") - 1).alias("__i"), F.col(seq).alias("__next"))
        rows = ranked.join(after, "__i")
    else:
        rows = table.select(*by, seq).distinct().withColumn("__next", nxt)
    gaps = rows.where(F.col("__next") - F.col(seq) > 1)
    return gaps.select(*by, F.explode(F.sequence(F.col(seq) + 1, F.col("__next") - 1)).alias("missing"))
