"""Planted and noise controls for the tiers: grid and seeds are columns of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge_tree, metrics
from ..operators.components import connected_components
from ..scratch import write_table


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that follows from its parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / (1 << 30)


def control_edges(nodes: DataFrame, seeds: int, size: int = 4, noise: float = 0.95, planted: float = 0.97) -> DataFrame:
    """(world, seed, u, v, w) for nodes (id, place), place counting from 0: in
    the world `noise` each node is tied to the next three places by weights
    below `noise`, high ones being rare (the sixth power of a draw); in
    `planted` the same by another draw, and every second run of `size` places
    is a clique of weight `planted`."""
    worlds = F.explode(F.array(F.lit("noise"), F.lit("planted"))).alias("world")
    rows = nodes.select("id", "place", worlds).select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    ahead = rows.select("world", "seed", F.col("id").alias("u"), F.col("place").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(max(3, size - 1)))).alias("step"))
    ahead = ahead.withColumn("place", F.col("p") + F.col("step"))
    pair = ahead.join(rows.select("world", "seed", F.col("id").alias("v"), "place"), ["world", "seed", "place"])
    run = F.floor(F.col("p") / size)
    same = (F.col("world") == "planted") & (run % 2 == 0) & (run == F.floor(F.col("place") / size))
    w = F.when(same, F.lit(planted)).when(F.col("step") <= 3, _draw(F.col("world"), F.col("seed"), F.col("u"), F.col("v")) ** 6 * noise)
    return pair.select("world", "seed", "u", "v", w.alias("w")).where("w IS NOT NULL")


def control_claims(edges: DataFrame, grid: list[float], least: int = 3) -> DataFrame:
    """(world, seed, cell, claim_id, members, floor): the components of at
    least `least` nodes at every grid value. A claim is named by what it
    holds, whatever the order: its number of members and two sums of their
    hashes. All worlds, seeds and grid values are parts of one graph: one
    forest, whose edges are joined to the values that they reach, and one
    call of connected components."""
    name = lambda c: F.concat_ws("|", "world", F.col("seed").cast("string"), F.col(c).cast("string"))
    tree = write_table(merge_tree.merge_tree(edges.select(name("u").alias("u"), name("v").alias("v"), "w")), "tree")
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(float(g)).alias("floor")) for i, g in enumerate(grid)])
    held = merge_tree.forest_of(tree).select("u", "v", "w", F.explode(cells).alias("c")).where("w >= c.floor")
    at = lambda c: F.concat_ws("|", F.col("c.cell").cast("string"), F.col(c))
    comp = connected_components(held.select(at("u").alias("u"), at("v").alias("v")), "u", "v")
    part = F.split("id", r"\|", 4)
    rows = comp.select("component", part[0].cast("int").alias("cell"), part[1].alias("world"), part[2].cast("int").alias("seed"), part[3].alias("node"))
    sums = [F.sum(F.xxhash64(F.lit(k), "node") % (1 << 40)).alias(f"s{k}") for k in (0, 1)]
    out = rows.groupBy("world", "seed", "cell", "component").agg(F.count(F.lit(1)).alias("members"), *sums, F.min("node").alias("first")).where(F.col("members") >= least)
    floor = F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col("cell") + 1)
    return out.select("world", "seed", "cell", F.concat_ws("-", F.col("members").cast("string"), F.col("s0").cast("string"), F.col("s1").cast("string")).alias("claim_id"), "members", floor.alias("floor"), "first")


def control_battery(nodes: DataFrame, grid: list[float], seeds: int = 3, size: int = 4) -> DataFrame:
    """One row: noise_settled_rate (claims of the noise world that settle),
    planted_settled (planted claims that do), tiered_precision (planted among
    those surfaced), baseline_precision (the best that one grid value alone
    reaches), ships (no noise settles, two planted claims do, and tiers beat
    every single value). A claim is planted if it holds the members of a
    planted run and no others."""
    edges = write_table(control_edges(nodes, seeds, size), "controls")
    claims = write_table(control_claims(edges, grid), "claims")
    full = nodes.select("id", F.floor(F.col("place") / size).alias("run")).where("run % 2 = 0")
    sums = [F.sum(F.xxhash64(F.lit(k), F.col("id").cast("string")) % (1 << 40)).alias(f"s{k}") for k in (0, 1)]
    known = full.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= 3)
    known = known.select(F.concat_ws("-", F.col("n").cast("string"), F.col("s0").cast("string"), F.col("s1").cast("string")).alias("claim_id"), F.lit(True).alias("planted")).distinct()
    keyed = claims.withColumn("key", F.concat_ws("|", "world", "claim_id"))
    tiers = metrics.assign_tiers(metrics.fibers(keyed, len(grid), seeds, "key"), len(grid))
    tiers = tiers.select(F.split("key", r"\|")[0].alias("world"), F.split("key", r"\|")[1].alias("claim_id"), "tier")
    tiers = tiers.join(known, "claim_id", "left").withColumn("planted", F.coalesce("planted", F.lit(False)) & (F.col("world") == "planted"))
    surfaced = F.col("tier").isin("SETTLED", "HUNCH") & (F.col("world") == "planted")
    one = tiers.agg(
        F.coalesce(F.avg(F.when(F.col("world") == "noise", (F.col("tier") == "SETTLED").cast("double"))), F.lit(0.0)).alias("noise_settled_rate"),
        F.count_if(F.col("planted") & (F.col("tier") == "SETTLED")).alias("planted_settled"),
        F.coalesce(F.avg(F.when(surfaced, F.col("planted").cast("double"))), F.lit(0.0)).alias("tiered_precision"),
    )
    cell = claims.where("world = 'planted'").join(known, "claim_id", "left").groupBy("cell").agg(F.avg(F.coalesce("planted", F.lit(False)).cast("double")).alias("p"))
    out = one.crossJoin(cell.agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("baseline_precision")))
    ships = (F.col("noise_settled_rate") == 0) & (F.col("planted_settled") >= 2) & (F.col("tiered_precision") > F.col("baseline_precision"))
    return out.withColumn("ships", ships)


def sweep_cells(grid: list[float], seeds: list[int], readings: DataFrame) -> DataFrame:
    """(cell, value, seed) of grid x seeds that readings (value, seed) lack,
    as rows to join to, in place of a plan for each."""
    spark = readings.sparkSession
    want = spark.createDataFrame([(i, float(g), int(s)) for i, g in enumerate(grid) for s in seeds], "cell int, value double, seed int")
    return want.join(readings.select("value", "seed").distinct(), ["value", "seed"], "left_anti").select("cell", "value", "seed")
