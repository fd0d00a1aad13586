"""Reports over notes, runs, queues, pairs and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

_BLANK_ENDS = r"(?U)^\s+|\s+$"


def snippets(chunks: DataFrame, limit: int = 600, by: str = "digest", order: str = "chunk_index", text: str = "text") -> DataFrame:
    """(digest, snippet): each note's texts in order, joined by blanks and cut
    to `limit` characters. Only the chunks that reach into the limit are
    gathered, so a note of any length is a short list."""
    rows = chunks.select(by, order, F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK_ENDS, "").alias("t"), F.coalesce(text, F.lit("")).alias("full"))
    before = Window.partitionBy(by).orderBy(order, "full").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("so_far", F.coalesce(F.sum(F.char_length("t")).over(before), F.lit(0))).where(F.col("so_far") < limit)
    parts = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "full"))).alias("parts"))
    add = lambda acc, p: F.when(F.char_length(acc) < limit, F.regexp_replace(F.concat(acc, F.lit(" "), p["full"]), _BLANK_ENDS, "")).otherwise(acc)
    return parts.select(by, F.substring(F.aggregate("parts", F.lit(""), add), 1, limit).alias("snippet"))


def regressions(report: DataFrame, baseline: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(.., metric) for each row of a golden report and metric that fell
    behind the baseline: recall_at_k and overlap may not drop, mean_distance
    may rise by the tolerance (or the baseline's own distance_tol)."""
    slack = baseline.get("distance_tol", tolerance)
    worse = [
        F.when(F.col("recall_at_k") + 1e-9 < baseline["recall_at_k"], "recall_at_k"),
        F.when(F.col("overlap") + 1e-9 < baseline["overlap"], "overlap"),
        F.when(F.col("mean_distance") > baseline["mean_distance"] + slack, "mean_distance"),
    ]
    keep = [c for c in report.columns if c not in ("recall_at_k", "overlap", "mean_distance")]
    return report.select(*keep, F.explode(F.array_compact(F.array(*worse))).alias("metric"))


def queue_overview(jobs: DataFrame, now: Column) -> DataFrame:
    """(kind, state, tier, priority, n, oldest, age_seconds) of the jobs that
    have not ended."""
    live = jobs.where(F.col("state").isin("queued", "running", "deferred"))
    out = live.groupBy("kind", "state", "tier", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))
    return out.withColumn("age_seconds", F.timestamp_diff("SECOND", F.col("oldest"), now))


def oldest_per_kind(jobs: DataFrame, kinds: int = 6) -> DataFrame:
    """(kind, waiting, oldest) of the queued jobs, the longest waiting kinds."""
    out = jobs.where("state = 'queued'").groupBy("kind").agg(F.count(F.lit(1)).alias("waiting"), F.min("created_at").alias("oldest"))
    return out.orderBy("oldest", "kind").limit(kinds)


def pair_distribution(pairs: DataFrame, value: str) -> DataFrame:
    """One row: n_pairs, frac_connected (0 of none), and mean, p50 and max
    over the connected pairs, those with a value (null without any)."""
    connected = F.count(value) / F.count(F.lit(1))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.when(F.count(F.lit(1)) > 0, connected), F.lit(0.0)).alias("frac_connected"),
        F.avg(value).alias("mean"), F.median(value).alias("p50"), F.max(value).cast("double").alias("max"),
    )


def frac_connected(pairs: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """(sigma, frac): the share of all pairs whose value reaches each floor."""
    out = pairs.agg(*[F.coalesce(F.avg(F.coalesce(F.col(value) >= g - 1e-12, F.lit(False)).cast("double")), F.lit(0.0)).alias(f"g{i}") for i, g in enumerate(grid)])
    return out.select(F.explode(F.array(*[F.struct(F.lit(float(g)).alias("sigma"), F.col(f"g{i}").alias("frac")) for i, g in enumerate(grid)])).alias("x")).select("x.*")


def grid_connectivity(components: DataFrame, n_nodes: int) -> DataFrame:
    """(sigma, frac) from (sigma, id, component), without a row per pair: of a
    component of s nodes all s * (s - 1) / 2 pairs are connected."""
    sizes = components.groupBy("sigma", "component").agg(F.count(F.lit(1)).alias("s"))
    pairs = sizes.groupBy("sigma").agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("connected"))
    return pairs.select("sigma", (F.col("connected") / F.lit(max(1, n_nodes * (n_nodes - 1) / 2))).alias("frac"))


def degree_correlation(pairs: DataFrame, edges: DataFrame, value: str = "resistance") -> DataFrame:
    """One row, `correlation`: of the value of connected pairs (a, b, value)
    with 1 / degree a + 1 / degree b, weighted degrees; 0 for fewer than two
    pairs or without variance. Near 1, the value says no more than degrees do."""
    d = graph.ends(edges.select("u", "v", "w")).groupBy("node").agg(F.sum("w").alias("d")).where("d > 1e-12")
    both = pairs.where(F.col(value).isNotNull()).join(d.withColumnsRenamed({"node": "a", "d": "da"}), "a").join(d.withColumnsRenamed({"node": "b", "d": "db"}), "b")
    x, y = F.col(value), 1 / F.col("da") + 1 / F.col("db")
    fine = (F.count(F.lit(1)) >= 2) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return both.agg(F.coalesce(F.when(fine, F.corr(x, y)), F.lit(0.0)).alias("correlation"))


def pipelines_compared(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """(pipeline, runs, claims, novel): the A/B table of the run ledger."""
    own = claims.join(runs.select("run_id", "pipeline"), "run_id")
    per = own.groupBy("pipeline").agg(F.count(F.lit(1)).alias("claims"), F.count_if("novel").alias("novel"))
    out = runs.groupBy("pipeline").agg(F.count(F.lit(1)).alias("runs")).join(per, "pipeline", "left")
    return out.select("pipeline", "runs", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("novel", F.lit(0)).alias("novel"))


def costs_of_runs(costs: DataFrame, runs: DataFrame) -> DataFrame:
    """Cost rows with their run's corpus and configuration, `unknown` where
    the ledger has no such run."""
    named = runs.select("run_id", "corpus_digest", "config_fingerprint").dropDuplicates(["run_id"])
    out = costs.join(named, "run_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("corpus_digest", "config_fingerprint")})


def cost_totals(costs: DataFrame) -> DataFrame:
    return costs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("wall_clock_s", "cells_completed", "cells_skipped")])


def compare_ranks(ranks: DataFrame, k: int) -> DataFrame:
    """One row from (probe, lane, baseline) ranks, null for a miss: wins of
    either, ties, both mean reciprocal ranks, the catastrophic cases (in the
    baseline's first k, missed by the lane), and the verdict."""
    far = F.lit(1 << 60)
    lane, base = F.coalesce("lane", far), F.coalesce("baseline", far)
    lost = F.coalesce(F.col("baseline") <= k, F.lit(False)) & F.col("lane").isNull()
    out = ranks.agg(
        F.count_if(lane < base).alias("lane_wins"), F.count_if(base < lane).alias("baseline_wins"), F.count_if(lane == base).alias("ties"), F.count_if(lost).alias("catastrophic"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("lane"), F.lit(0.0))), F.lit(0.0)).alias("lane_mrr"), F.coalesce(F.avg(F.coalesce(1.0 / F.col("baseline"), F.lit(0.0))), F.lit(0.0)).alias("baseline_mrr"),
    )
    beats = (F.col("lane_wins") > F.col("baseline_wins")) & (F.col("catastrophic") == 0)
    return out.withColumn("verdict", F.when(beats, "lane-beats-baseline").otherwise("no-signal"))


def accounted(rows: DataFrame, bucket: Column, buckets: tuple[str, ...]) -> DataFrame:
    """(bucket, n) for each of the closed set of buckets, and a row `total`
    with `complete`: whether the buckets hold every row, once."""
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    known = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_and(F.coalesce(F.col("bucket").isin(*buckets), F.lit(False))), F.lit(True)).alias("complete"))
    return known.select("bucket", "n", F.lit(None).cast("boolean").alias("complete")).unionAll(total.select(F.lit("total"), "n", "complete"))


def keepers(papers: DataFrame) -> DataFrame:
    """Papers that may be kept whole: open access and with a text; their
    source_path is a marker, never a path of notes."""
    fine = F.coalesce(F.col("open_access"), F.lit(False)) & (F.coalesce(F.char_length("full_text"), F.lit(0)) > 0)
    return papers.where(fine).withColumns({"source_path": F.concat(F.lit("reference:"), "source", F.lit(":"), "id"), "digest": F.sha2(F.col("full_text").cast("binary"), 256)})


def clock_ticks(events: DataFrame, clock: str, ticks: DataFrame | None = None) -> DataFrame:
    """(event, tick): each event's place on a clock: `event` (itself),
    `stratum` (its store with itself), `write` (its store's last positions),
    or `given` (from a table of ticks; events without one have none). Wall
    time orders nothing and is no clock."""
    if clock == "wall":
        raise ValueError("wall time is no clock of events")
    if clock == "event":
        return events.select("event", F.col("event").alias("tick"))
    if clock == "stratum":
        return events.select("event", F.concat_ws("|", "store", "event").alias("tick"))
    if clock == "write":
        return events.select("event", F.col("store").alias("tick"))
    if clock == "given" and ticks is not None:
        return events.select("event").join(ticks.select("event", F.col("tick").cast("string").alias("tick")), "event")
    raise ValueError(f"no ticks for the clock {clock}")


def gaps_in_fibres(ticks: DataFrame, order: DataFrame) -> DataFrame:
    """(tick, event): the events outside a tick's fibre that lie between two
    of its events in the order (a closure); a clock without any has convex
    fibres only."""
    t = lambda at, name: ticks.select(F.col("event").alias(at), F.col("tick").alias(name))
    after = order.join(t("source", "tick"), "source").select("tick", F.col("target").alias("event")).distinct()
    before = order.join(t("target", "tick"), "target").select("tick", F.col("source").alias("event")).distinct()
    return after.join(before, ["tick", "event"]).join(ticks.select("tick", "event"), ["tick", "event"], "left_anti")


def atlas_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events (event, ..) of both charts of an atlas."""
    return a.join(b.select("event"), "event", "left_semi")

