"""The census of directed influence: loops, revision asymmetries, reach-backs;
and what staged arcs add to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from . import graph

#: Kinds of claims; fixed values.
LOOP, ASYMMETRY, REACH_BACK = "influence_loop", "revision_asymmetry", "reach_back"


def _claims(loops: DataFrame, uneven: DataFrame, back: DataFrame) -> DataFrame:
    parts = [
        loops.select(F.lit(LOOP).alias("kind"), F.col("nodes").alias("members"), "witness"),
        uneven.select(F.lit(ASYMMETRY).alias("kind"), F.array_sort(F.array_union("short_path", "long_path")).alias("members"), "witness"),
        back.select(F.lit(REACH_BACK).alias("kind"), F.array("citing", "cited").alias("members"), F.concat(F.array("witness"), "evidence").alias("witness")),
    ]
    return reduce(DataFrame.unionAll, parts)


def census(arcs: DataFrame, authorship: DataFrame, max_len: int = 12) -> DataFrame:
    """(kind, members, witness) of arcs (source, target, kind, witness) and
    first authorships (ref, rank, evidence), all families in one table. Of
    arcs between the same two ends that of the least witness counts."""
    a = write_table(one_arc(arcs), "arcs")
    return _claims(graph.loops(a, max_len), graph.revision_asymmetries(a, max_len), graph.reach_backs(arcs, authorship))


def one_arc(arcs: DataFrame) -> DataFrame:
    return arcs.where("source <> target").groupBy("source", "target").agg(F.min("witness").alias("witness"))


def _grown(starts: DataFrame, arcs: DataFrame, most: int, forward: bool) -> list[DataFrame]:
    """Simple paths of 0 .. most arcs from each start (arc, node), forward or
    back: (arc, end, nodes, witness) by length, the start's node included,
    nodes and witnesses in the direction of the arcs."""
    near, far = ("source", "target") if forward else ("target", "source")
    step = arcs.select(F.col(near).alias("end"), F.col(far).alias("__to"), F.col("witness").alias("__w"))
    paths = starts.select("arc", F.col("node").alias("end"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("witness"))
    out = [paths]
    put = lambda c, x: F.concat(c, F.array(x)) if forward else F.concat(F.array(x), c)
    for _ in range(most):
        nxt = out[-1].join(step, "end").where(~F.array_contains("nodes", F.col("__to")))
        nxt = nxt.select("arc", F.col("__to").alias("end"), put("nodes", "__to").alias("nodes"), put("witness", "__w").alias("witness"))
        out.append(write_table(nxt, "halves"))
    return out


def _loops_through(all_arcs: DataFrame, staged: DataFrame, max_len: int) -> DataFrame:
    """Elementary cycles with a staged arc: the way from its target back to its
    source is a forward half and a backward half that meet in one node and
    share no other; a cycle of n arcs has one such cut. Each is turned to its
    least node and given once."""
    ahead = _grown(staged.select(F.col("witness").alias("arc"), F.col("target").alias("node")), all_arcs, max_len // 2, True)
    behind = _grown(staged.select(F.col("witness").alias("arc"), F.col("source").alias("node")), all_arcs, (max_len - 1) // 2, False)
    found = []
    for n in range(2, max_len + 1):
        x = ahead[n // 2].toDF("arc", "end", "xn", "xw")
        y = behind[(n - 1) // 2].toDF("arc", "end", "yn", "yw")
        inner = F.slice("yn", F.lit(2), F.greatest(F.lit(0), F.size("yn") - 1))  # without the node where they meet
        both = x.join(y, ["arc", "end"]).where(~F.arrays_overlap("xn", inner))
        found.append(both.select(F.concat("xn", inner).alias("nodes"), F.concat("xw", "yw", F.array("arc")).alias("witness")))
    loops = reduce(DataFrame.unionAll, found)
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turn = lambda c: F.concat(F.slice(c, at, F.size("nodes") - at + 1), F.slice(c, F.lit(1), at - 1))
    return loops.select(turn("nodes").alias("nodes"), turn("witness").alias("witness")).distinct()


def _paths_through(all_arcs: DataFrame, staged: DataFrame, max_len: int) -> DataFrame:
    """(source, sink, nodes, witness): simple paths with a staged arc, each
    once: a way up to its source and one on from its target."""
    ahead = _grown(staged.select(F.col("witness").alias("arc"), F.col("target").alias("node")), all_arcs, max_len - 1, True)
    behind = _grown(staged.select(F.col("witness").alias("arc"), F.col("source").alias("node")), all_arcs, max_len - 1, False)
    found = []
    for i in range(max_len):
        x = behind[i].toDF("arc", "source", "xn", "xw")
        for j in range(max_len - i):
            y = ahead[j].toDF("arc", "sink", "yn", "yw")
            both = x.join(y, "arc").where(~F.arrays_overlap("xn", "yn"))
            found.append(both.select("source", "sink", F.concat("xn", "yn").alias("nodes"), F.concat("xw", F.array("arc"), "yw").alias("witness")))
    return reduce(DataFrame.unionAll, found).distinct()


def census_influence(base: DataFrame, staged: DataFrame, authorship: DataFrame, max_len: int = 12) -> DataFrame:
    """(kind, members, witness, attributed): the claims that staged arcs add to
    the census of the base arcs, with the staged arcs (their witnesses) that
    each falls without: those that it is made of.

    Only what passes a staged arc is enumerated: loops from two halves, paths
    likewise; of the base, only paths between the ends of such paths are
    looked at, as the new pair of the largest gap may have one of them. Staged
    arcs between ends that a base arc joins already add nothing but reach-backs."""
    old = write_table(one_arc(base), "arcs")
    new = one_arc(staged).join(old.select("source", "target"), ["source", "target"], "left_anti")
    new = write_table(new.select("source", "target", "witness"), "staged")
    arcs = write_table(old.unionByName(new), "arcs")
    loops = write_table(_loops_through(arcs, new, max_len), "loops")
    fresh = write_table(_paths_through(arcs, new, max_len), "fresh")
    asked = fresh.select("source", "sink").distinct()
    kept = _paths_between(old, asked, max_len)
    uneven = graph.widest_asymmetries(fresh.unionByName(kept))
    uneven = uneven.join(new.select(F.col("witness").alias("__w")), F.array_contains("witness", F.col("__w")), "left_semi")
    back = graph.reach_backs(staged, authorship)
    back = back.join(base.where("kind = 'citation'").select(F.col("source").alias("citing"), F.col("target").alias("cited"), "witness"), ["citing", "cited", "witness"], "left_anti")
    claims = _claims(loops, uneven, back.distinct()).select("kind", "members", "witness", F.explode("witness").alias("__w"))
    hit = claims.join(staged.select(F.col("witness").alias("__w")).distinct(), "__w", "left_semi")
    return hit.groupBy("kind", "members", "witness").agg(F.array_sort(F.collect_set("__w")).alias("attributed"))


def _paths_between(arcs: DataFrame, asked: DataFrame, max_len: int) -> DataFrame:
    """Simple paths of the asked (source, sink) pairs, grown from their
    sources only."""
    starts = asked.select("source").distinct().select(F.col("source").alias("arc"), F.col("source").alias("node"))
    grown = _grown(starts, arcs, max_len, True)[1:]
    parts = [g.select(F.col("arc").alias("source"), F.col("end").alias("sink"), "nodes", "witness") for g in grown]
    return reduce(DataFrame.unionAll, parts).join(asked, ["source", "sink"], "left_semi")
