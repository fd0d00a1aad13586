"""Retrieval metrics, drift, sweeps, fibres, tiers and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def recall_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Share of the distinct expected found in the first k; 1 if none is."""
    want = F.array_distinct(expected)
    hits = F.size(F.array_intersect(want, F.slice(retrieved, 1, k)))
    return F.when(F.size(want) == 0, 1.0).otherwise(hits / F.size(want))


def overlap_at_k(a: Column, b: Column, k: int) -> Column:
    """Jaccard of the first k of two lists; 1 for two empty ones."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def golden_report(results: DataFrame, k: int) -> DataFrame:
    """One row of macro means, rounded to 4: recall_at_k, overlap,
    mean_distance, from rows (expected, retrieved, distances)."""
    per = results.select(
        recall_at_k(F.col("expected"), F.col("retrieved"), k).alias("r"),
        overlap_at_k(F.col("expected"), F.col("retrieved"), k).alias("o"),
        F.when(F.size("distances") > 0, F.aggregate("distances", F.lit(0.0), lambda a, x: a + x) / F.size("distances")).otherwise(0.0).alias("d"),
    )
    return per.agg(F.round(F.avg("r"), 4).alias("recall_at_k"), F.round(F.avg("o"), 4).alias("overlap"), F.round(F.avg("d"), 4).alias("mean_distance"))


def reciprocal_ranks(ranks: DataFrame, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Mean reciprocal rank; a null rank counts 0."""
    return ranks.groupBy(*(by or [])).agg(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))


# The axes of drift (tolerance, whether higher is better).
AXES = {"recall_at_k": (0.10, True), "overlap": (0.10, True), "mean_distance": (0.05, False)}
EXTRA_AXES = {"frustration": (0.25, False), "min_conductance": (0.10, True)}


def drift(profile: DataFrame, baseline: dict[str, float], theta: float = 1.0) -> DataFrame:
    """profile with drift and within_tolerance: the length of the vector of
    one-sided deteriorations. Axes without a baseline or column do not count;
    a row that is not `intact` has infinite drift."""
    axes = {a: t for a, t in {**AXES, **EXTRA_AXES}.items() if a in baseline and a in profile.columns}
    total: Column = F.lit(0.0)
    for a, (tol, up) in axes.items():
        d = scoring.deterioration(F.col(a), F.lit(float(baseline[a])), F.lit(tol), up)
        total = total + F.coalesce(d * d, F.lit(0.0))
    d = F.sqrt(total)
    if "intact" in profile.columns:
        d = F.when(F.col("intact"), d).otherwise(float("inf"))
    return profile.withColumn("drift", d).withColumn("within_tolerance", F.col("drift") <= theta)


def fibers(cells: DataFrame, grid_size: int, seeds: int = 1, claim: str = "claim_id") -> DataFrame:
    """Per claim: the grid cells where a majority of seeds found it, their
    share of the grid, hull and whether the hull has gaps. A claim that no
    cell holds has no row."""
    held = cells.groupBy(claim, "cell").agg(F.countDistinct("seed").alias("n")).where(F.col("n") >= (seeds + 1) // 2)
    out = held.groupBy(claim).agg(F.count("cell").alias("n_cells"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    return out.select(claim, (F.col("n_cells") / grid_size).alias("persistence"), "lo", "hi", (F.col("hi") - F.col("lo") + 1 > F.col("n_cells")).alias("gapped"), "n_cells")


def fiber_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.avg("persistence").alias("mean"), F.median("persistence").alias("p50"), F.max("persistence").alias("max"),
        F.avg((F.col("persistence") >= 0.5).cast("double")).alias("frac_half"), F.count(F.lit(1)).alias("n"),
    )


# Tier thresholds.
THETA_STRONG, THETA_WEAK_CELLS = 0.5, 2


def tier_thresholds(grid_size: int, strong: float = THETA_STRONG, weak_cells: int = THETA_WEAK_CELLS) -> tuple[float, float]:
    if grid_size < 1:
        raise ValueError("the grid is empty")
    weak = weak_cells / grid_size
    if not 0 < weak < strong <= 1:
        raise ValueError("the grid is too coarse to tell tiers apart")
    return weak, strong


def assign_tiers(rows: DataFrame, grid_size: int, **thresholds) -> DataFrame:
    """rows with tier, by persistence alone; order is by tier, then
    confidence, then id: the two never multiply."""
    weak, strong = tier_thresholds(grid_size, **thresholds)
    tier = F.when(F.col("persistence") >= strong, "SETTLED").when(F.col("persistence") >= weak, "HUNCH").otherwise("RETAINED")
    return rows.withColumn("tier", tier)


def tier_order() -> list[Column]:
    place = F.when(F.col("tier") == "SETTLED", 0).when(F.col("tier") == "HUNCH", 1).otherwise(2)
    return [place, F.desc("confidence"), F.col("claim_id")]


def occupancy(tiered: DataFrame) -> DataFrame:
    tiers = tiered.sparkSession.createDataFrame([("SETTLED",), ("HUNCH",), ("RETAINED",)], "tier string")
    counts = tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def tier_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of common claims in the same tier; 1 without common claims."""
    both = a.select("claim_id", F.col("tier").alias("ta")).join(b.select("claim_id", F.col("tier").alias("tb")), "claim_id")
    return both.agg(F.coalesce(F.avg((F.col("ta") == F.col("tb")).cast("double")), F.lit(1.0)).alias("stability"), F.count(F.lit(1)).alias("shared"))


def plateau(points: DataFrame, by: list[str], current: float, epsilon: float, minimize: bool = False) -> DataFrame:
    """Per group the value in the middle of the widest run of neighbouring
    grid points whose mean is within epsilon of the best admissible one; ties
    go to the value nearest to `current`, then the smaller. On grids of three
    points and fewer the best point itself."""
    sign = -1.0 if minimize else 1.0
    rows = points.where("admissible").withColumn("__s", F.col("mean") * sign)
    best = rows.groupBy(*by).agg(F.max("__s").alias("__best"), F.max("grid_size").alias("__g")) if by else None
    rows = rows.join(best, by) if by else rows.crossJoin(F.broadcast(rows.agg(F.max("__s").alias("__best"), F.max("grid_size").alias("__g"))))
    near = rows.where(F.col("__s") >= F.col("__best") - F.when(F.col("__g") <= 3, 1e-12).otherwise(epsilon))
    island = F.col("grid_index") - F.row_number().over(Window.partitionBy(*by).orderBy("grid_index"))
    near = near.withColumn("__run", F.when(F.col("__g") <= 3, F.col("grid_index")).otherwise(island))
    runs = near.groupBy(*by, "__run").agg(F.count(F.lit(1)).alias("width"), F.array_sort(F.collect_list(F.struct("grid_index", "value"))).alias("p"))
    centre = F.get("p", (F.col("width") / 2).cast("int"))["value"]
    runs = runs.withColumn("value", centre)
    key = F.struct((-F.col("width")).alias("w"), F.abs(F.col("value") - current).alias("d"), F.col("value").alias("v"))
    return runs.groupBy(*by).agg(F.min(key).alias("k")).select(*by, F.col("k.v").alias("value"), (-F.col("k.w")).alias("width"))


def sweep_curve(readings: DataFrame, metric: str, guard: str, floor: float) -> DataFrame:
    """Per grid value: mean and half range of the metric over seeds, and
    whether every seed's guard metric holds the floor."""
    m = F.when(F.col("metric_name") == metric, F.col("value"))
    g = F.when(F.col("metric_name") == guard, F.col("value") >= floor)
    return readings.groupBy("grid_index", "grid_value").agg(
        F.avg(m).alias("mean"), ((F.max(m) - F.min(m)) / 2).alias("half_range"), F.coalesce(F.bool_and(g), F.lit(False)).alias("admissible")
    )


def histogram_overlap(rows: DataFrame, value: str, within: str, bins: int = 20) -> DataFrame:
    """Overlap of two distributions on -1..1 in equal bins, and their medians;
    `within` tells the two apart."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) + 1) / 2 * bins))).alias("bin")
    counts = rows.groupBy(b).agg(F.count_if(within).alias("x"), F.count_if(~F.col(within)).alias("y"))
    totals = counts.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    shares = counts.crossJoin(F.broadcast(totals))  # one row of totals
    overlap = shares.agg(F.coalesce(F.sum(F.least(F.col("x") / F.col("nx"), F.col("y") / F.col("ny"))), F.lit(0.0)).alias("overlap"))
    medians = rows.agg(F.median(F.when(F.col(within), F.col(value))).alias("median_within"), F.median(F.when(~F.col(within), F.col(value))).alias("median_cross"))
    return overlap.crossJoin(medians)


def queue_rates(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """One row: counts by state, arrivals and ends in the window, rates per
    minute, and whether the queue is stalled (work waits, none ends) or
    wedged (work runs, none ends)."""
    since = now - F.make_interval(mins=F.lit(minutes))
    recent = lambda c: F.col(c) > since
    out = jobs.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "done", "failed")],
        F.count_if(recent("created_at")).alias("enqueued_window"),
        F.count_if((F.col("state") == "done") & recent("finished_at")).alias("done_window"),
        F.count_if((F.col("state") == "failed") & recent("finished_at")).alias("failed_window"),
        F.max_by("kind", F.when(F.col("state") == "failed", F.col("finished_at"))).alias("last_failed_kind"),
    )
    net = (F.col("enqueued_window") - F.col("done_window") - F.col("failed_window")) / minutes
    return out.withColumns({"net_rate": net, "stalled": (F.col("queued") > 0) & (F.col("done_window") == 0), "wedged": (F.col("running") > 0) & (F.col("done_window") == 0)})


def stratified_sample(tiered: DataFrame, cap: int, seed: str, tiers: int = 3, key: str = "claim_id") -> DataFrame:
    """At most cap / tiers claims of each tier, by a seeded hash, shuffled."""
    place = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")).cast("binary"), 256)
    rows = tiered.withColumn("__p", place)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("tier").orderBy("__p", key)))
    return ranked.where(F.col("__n") <= cap // tiers).orderBy("__p", key).drop("__p", "__n")


def round_robin(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Rows of all groups in turns, each group in its order; `turn` is the
    place within the group."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).orderBy("turn", by)


def budget_cut(parts: DataFrame, by: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The first rows of each group whose running cost stays in the budget."""
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("spent", spent).where(F.col("spent") <= budget)


def context_size(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """A context size: the 95th percentile and a quarter, up to the next
    1024, 2048 at least."""
    p = F.percentile(col, 0.95)
    return tokens.agg(F.greatest(F.lit(2048), F.ceil(p * 1.25 / 1024) * 1024).cast("long").alias("num_ctx"))


def prompt_budget(parts: DataFrame, budget: int, overhead: int = 4) -> DataFrame:
    """parts (request, kind, rank, tokens) with kept_tokens, and escalate:
    what of a request's prompt fits into the budget, `overhead` tokens a part.

    The frame always stays. What is retrieved goes first, the lowest ranked
    before the others; then history, the oldest (lowest rank) first; then the
    outputs of tools from the last on, the last one kept being cut to what is
    left. Dropped parts have null. A request whose frame alone is too long
    escalates. Running sums within a request say all of it."""
    cost = F.col("tokens") + overhead
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, cost).otherwise(0)).over(Window.partitionBy("request"))
    up = F.sum(cost).over(Window.partitionBy("request", "kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum(cost).over(Window.partitionBy("request", "kind").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumns({"__f": of("frame"), "__h": of("history"), "__t": of("tool"), "__up": up, "__down": down})
    left = F.lit(budget) - F.col("__f") - F.col("__up") + cost - overhead  # for a tool's output, after those before it
    tool = F.when((F.col("__f") + F.col("__t") <= budget) | (F.col("__f") + F.col("__up") <= budget), F.col("tokens")).when(left > 0, left)
    kept = (
        F.when(F.col("kind") == "frame", F.col("tokens"))
        .when((F.col("kind") == "retrieved") & (F.col("__f") + F.col("__h") + F.col("__t") + F.col("__up") <= budget), F.col("tokens"))
        .when((F.col("kind") == "history") & (F.col("__f") + F.col("__t") + F.col("__down") <= budget), F.col("tokens"))
        .when(F.col("kind") == "tool", tool)
    )
    return rows.select(*parts.columns, kept.cast("long").alias("kept_tokens"), (F.col("__f") > budget).alias("escalate"))


def mismatch_density(pairs: DataFrame, notes: DataFrame, floor: float) -> DataFrame:
    """One row for pairs (a, b) of another class of edges against notes (id,
    vector): pairs_total, pairs_scored (both ends have a vector), below_floor,
    mismatch_density, mean_cos, and ambient_mean_cos over all pairs of notes,
    which follows from the sum of the unit vectors without a row a pair."""
    from ..functions.vectors import dot, doubles, unit

    u = notes.select("id", unit(doubles(F.col("vector"))).alias("x")).where(F.exists("x", lambda c: c != 0))
    side = lambda c: u.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"))
    scored = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("cos", dot(F.col("xa"), F.col("xb")))
    one = scored.agg(
        F.count(F.lit(1)).alias("pairs_total"), F.count("cos").alias("pairs_scored"), F.count_if(F.col("cos") < floor).alias("below_floor"), F.avg("cos").alias("mean_cos")
    )
    one = one.withColumn("mismatch_density", F.when(F.col("pairs_scored") > 0, F.col("below_floor") / F.col("pairs_scored")))
    parts = u.select("id", F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"))
    n = u.agg(F.count(F.lit(1)).alias("n"))
    ambient = parts.agg(F.sum(F.col("s") * F.col("s")).alias("q")).crossJoin(n)
    return one.crossJoin(ambient.select(F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("ambient_mean_cos")))
