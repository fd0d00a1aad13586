"""Lifecycles as append-only event tables: the state is the latest event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed steps; states without one are final.
PROPOSAL_STEPS = {
    ("proposed", "approved"), ("proposed", "denied"), ("approved", "executed"), ("executed", "validated"), ("executed", "rolled_back"),
}
# What a verdict does, and how far an effect reaches.
VERDICT_EFFECT = {"wrong": "RETRACT", "noise": "RETRACT", "novel_useful": "ENDORSE"}
REACH = {"reversible": 0, "recoverable": 1, "irreversible": 2}
APPROVAL = {0: "none", 1: "owner", 2: "owner-confirmed"}


def states(events: DataFrame, key: str = "id") -> DataFrame:
    """(id, state): the state after the last event."""
    return events.groupBy(key).agg(F.max_by("state", "seq").alias("state"))


def step(events: DataFrame, batch: DataFrame, steps: set[tuple[str, str]] = PROPOSAL_STEPS, first: str = "proposed") -> DataFrame:
    """events with the batch (id, seq, state); an unlisted step is refused."""
    now = states(events)
    rows = batch.join(now.withColumnRenamed("state", "__was"), "id", "left")
    allowed = F.concat_ws(">", F.coalesce("__was", F.lit("")), "state").isin(*[f"{a}>{b}" for a, b in steps], f">{first}")
    bad = rows.where(~allowed).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['id']} may not go from {bad[0]['__was']} to {bad[0]['state']}")
    return events.unionByName(batch.select(*events.columns))


def mapped(col: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def verdict_effect(verdict: Column) -> Column:
    return mapped(verdict, VERDICT_EFFECT, "RECORD")


def blast_radius(kind: Column) -> Column:
    """How far an effect reaches; unknown kinds reach farthest."""
    return mapped(kind, REACH, max(REACH.values()))


def required_approval(kind: Column) -> Column:
    return mapped(blast_radius(kind), APPROVAL, APPROVAL[max(APPROVAL)])


def admitted(effects: DataFrame, ceiling: int) -> DataFrame:
    return effects.withColumn("admitted", blast_radius(F.col("reversibility")) <= ceiling)


def gate(decisions: DataFrame, theta: float) -> DataFrame:
    """decisions with admits: approved, not regressing, drift within theta."""
    return decisions.withColumn("admits", F.coalesce(F.col("approved") & ~F.col("regressing") & (F.col("drift") <= theta), F.lit(False)))


def reach_summary(effects: DataFrame) -> DataFrame:
    r = blast_radius(F.col("reversibility"))
    return effects.agg(F.avg(r).alias("mean_reach"), F.avg((r == 2).cast("double")).alias("frac_irreversible"), F.max(r).alias("max_reach"))


def effective_priority(jobs: DataFrame, now: Column, floor: int = 10, step_s: int = 900, gain: int = 10) -> DataFrame:
    """jobs with effective priority (smaller is sooner): waiting lifts it, but
    never above the floor; what is at the floor or above stays."""
    waited = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    aged = F.greatest(F.lit(floor), F.col("priority") - gain * F.floor(F.greatest(waited, F.lit(0)) / step_s))
    return jobs.withColumn("effective", F.when(F.col("priority") <= floor, F.col("priority")).otherwise(aged))


def next_jobs(jobs: DataFrame, now: Column, loaded: str | None = None, blocked: tuple[str, ...] = (), n: int = 1) -> DataFrame:
    """The n jobs to run next: least effective priority, then those of the
    loaded model, then the oldest; blocked tiers wait."""
    rows = effective_priority(jobs.where("state = 'queued'"), now)
    if blocked:
        rows = rows.where(~F.col("tier").isin(*blocked))
    other = [F.when(F.col("tier") == loaded, 0).otherwise(1)] if loaded else []
    return rows.orderBy("effective", *other, "created_at", "id").limit(n)


def reclaim(jobs: DataFrame, run: str, now: Column, idempotent: tuple[str, ...]) -> DataFrame:
    """Running jobs of other runs or with an expired lease: queued again if
    their kind may run twice, else failed. No lease never expires."""
    lost = (F.col("state") == "running") & (~F.col("claimed_by_run").eqNullSafe(F.lit(run)) | F.coalesce(F.col("lease_expires_at") < now, F.lit(False)))
    return jobs.withColumn("state", F.when(lost & F.col("kind").isin(*idempotent), "queued").when(lost, "failed").otherwise(F.col("state")))


def coalesce_jobs(jobs: DataFrame) -> DataFrame:
    """Queued jobs of the same kind, payload, tier and context are one: the
    oldest, at the best priority any of them had; checkpointed ones stay."""
    same = (F.col("state") == "queued") & F.col("checkpoint").isNull()
    key = ["kind", "payload", "tier", "num_ctx"]
    one = jobs.where(same).groupBy(*key).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.min("priority").alias("__p"), F.count(F.lit(1)).alias("merged"))
    kept = jobs.where(same).drop(*key).join(one, "id").withColumn("priority", F.col("__p")).drop("__p")
    rest = jobs.where(~same).withColumn("merged", F.lit(1).cast("long"))
    return kept.select(*jobs.columns, "merged").unionByName(rest.select(*jobs.columns, "merged"))


def last_runs(runs: DataFrame, by: str = "pipeline", recent: int = 5) -> DataFrame:
    """(by, run_id, finished_at, clean, recent_clean, recent): the last run of
    each pipeline (run_id, finished_at, failed), whether it was clean, and how
    many of its `recent` last ones were; ties to the larger id."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("finished_at"), F.desc("run_id")))
    rows = runs.withColumn("__n", place).where(F.col("__n") <= recent)
    top = F.max_by(F.struct("run_id", "finished_at", (F.col("failed") == 0).alias("clean")), -F.col("__n"))
    out = rows.groupBy(by).agg(top.alias("t"), F.count_if(F.col("failed") == 0).alias("recent_clean"), F.count(F.lit(1)).alias("recent"))
    return out.select(by, "t.run_id", "t.finished_at", "t.clean", "recent_clean", "recent")
