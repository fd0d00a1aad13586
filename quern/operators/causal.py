"""Causal order of events: generator edges, closure, cuts, transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import write_table
from . import graph


def event_id(store: str, chain: Column, position: Column) -> Column:
    return F.concat_ws(":", F.lit(store), F.coalesce(chain.cast("string"), F.lit("-")), F.coalesce(position.cast("string"), F.lit("-")))


def chain_edges(events: DataFrame) -> DataFrame:
    """(source, target): each event of a chain (store, chain, position) and
    its next. Wall time takes no part."""
    nxt = F.lead("event").over(Window.partitionBy("store", "chain").orderBy("position"))
    return events.where("chain IS NOT NULL").select(F.col("event").alias("source"), nxt.alias("target")).where("target IS NOT NULL")


def spine(events: DataFrame, produced: DataFrame | None = None, consumed: DataFrame | None = None) -> DataFrame:
    """Generator edges of the order: chains, and consumers after producers.
    A cycle is an error."""
    from .reconcile import reads_from

    edges = chain_edges(events)
    if produced is not None and consumed is not None:
        edges = edges.unionAll(reads_from(produced, consumed)[0])
    edges = write_table(edges.distinct(), "spine")
    graph.longest_chain(edges)
    return edges


def relation(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """pairs (a, b) with before, after, same or concurrent under a closure."""
    fwd = order.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias("f"))
    back = order.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit(True).alias("g"))
    out = pairs.join(fwd, ["a", "b"], "left").join(back, ["a", "b"], "left")
    what = F.when(F.col("a") == F.col("b"), "same").when(F.col("f"), "before").when(F.col("g"), "after").otherwise("concurrent")
    return out.select("a", "b", what.alias("relation"))


def proper_time(edges: DataFrame, order: DataFrame, a: str, b: str) -> DataFrame:
    """One row (proper_time, total): the number of steps on the longest chain
    from a to b, null if b is not after a, and whether the interval is a chain."""
    inner = order.where(F.col("source") == a).select(F.col("target").alias("node")).join(order.where(F.col("target") == b).select(F.col("source").alias("node")), "node")
    ends = inner.sparkSession.createDataFrame([(a,), (b,)], "node string")
    nodes = write_table(inner.unionAll(ends).distinct(), "interval")
    if order.where((F.col("source") == a) & (F.col("target") == b)).isEmpty():
        return nodes.sparkSession.createDataFrame([(None, False)], "proper_time int, total boolean")
    own = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    levels = graph.longest_chain(own)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = levels.agg((F.max("level") - 1).cast("int").alias("proper_time")).crossJoin(n)
    return out.select("proper_time", (F.col("proper_time") + 1 == F.col("n")).alias("total"))


def frontier(events: DataFrame) -> DataFrame:
    """(store, chain, position): the last event of each chain."""
    return events.groupBy("store", "chain").agg(F.max("position").alias("position"))


def downset(events: DataFrame, cut: DataFrame) -> DataFrame:
    """Events at or before the cut (store, chain, position)."""
    c = cut.select("store", F.col("chain").alias("__c"), F.col("position").alias("__p"))
    hit = events.alias("e").join(c.alias("c"), (F.col("e.store") == F.col("c.store")) & F.col("e.chain").eqNullSafe(F.col("c.__c")))
    return hit.where("e.position <= c.__p").select("e.*")


def crossing(edges: DataFrame, down: DataFrame) -> DataFrame:
    """Edges that lead from outside into the down-set: a sound cut has none."""
    inside = down.select(F.col("event").alias("target"))
    out = edges.join(inside, "target", "left_semi")
    return out.join(down.select(F.col("event").alias("source")), "source", "left_anti")


def chi(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(store, chi): the longest chain of a stratum over its events."""
    out = None
    for s in sorted(r[0] for r in events.select("store").distinct().collect()):  # strata are a closed set
        own = events.where(F.col("store") == s)
        e = edges.join(own.select(F.col("event").alias("source")), "source", "left_semi").join(own.select(F.col("event").alias("target")), "target", "left_semi")
        top = graph.longest_chain(e).agg(F.coalesce(F.max("level"), F.lit(1)).alias("top"))
        part = own.agg(F.count(F.lit(1)).alias("n")).crossJoin(top).select(F.lit(s).alias("store"), (F.col("top") / F.col("n")).alias("chi"))
        out = part if out is None else out.unionAll(part)
    return out


def poset_from_chains(versions: DataFrame) -> DataFrame:
    """(source, target) of all comparable pairs of version chains (doc_id,
    version_seq, digest): the closure of chains is their order."""
    v = versions.select("doc_id", "version_seq", "digest")
    # A pair can only come twice if one of its digests does: the others, which
    # are as many as there are pairs of positions, are not shuffled to be told apart.
    often = v.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("often"))
    v = write_table(v.join(often, "digest", "left").withColumn("often", F.coalesce("often", F.lit(False))), "versions")
    pairs = v.select("doc_id", F.col("version_seq").alias("i"), F.col("digest").alias("source"), F.col("often").alias("x")).join(
        v.select("doc_id", F.col("version_seq").alias("j"), F.col("digest").alias("target"), F.col("often").alias("y")), "doc_id"
    ).where("i < j AND source <> target")
    once = pairs.where("NOT (x OR y)").select("source", "target")
    if v.where("often").isEmpty():
        return once
    return once.unionAll(pairs.where("x OR y").select("source", "target").distinct())


def coboundary_squared(order: DataFrame) -> DataFrame:
    """Comparable triples whose long side the order lacks: none for a
    transitive order."""
    two = order.select("source", F.col("target").alias("mid")).join(order.select(F.col("source").alias("mid"), "target"), "mid")
    return two.join(order, ["source", "target"], "left_anti").select("source", "mid", "target")


def citation_complex(references: DataFrame, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): documents that cite or are cited, and undirected edges
    between different ones, at a commit if given."""
    rows = references.where("source_kind = 'doc' AND target_kind = 'doc'")
    if commit is not None:
        rows = rows.where(F.col("commit_sha") == commit)
    nodes = rows.select(F.explode(F.array("source_ref", "target_ref")).alias("node")).distinct()
    return nodes, graph.canonical(rows.select("source_ref", "target_ref"), "source_ref", "target_ref")


def node_map(before: DataFrame, after: DataFrame, successors: DataFrame) -> DataFrame:
    """(node, image): each node of the earlier snapshot in the later one:
    itself if it is still there, else its successor; two nodes with one image
    are an error, nodes without image are left out."""
    own = before.select("node").join(after.select("node"), "node", "left_semi").withColumn("image", F.col("node"))
    moved = before.select("node").join(after.select("node"), "node", "left_anti")
    moved = moved.join(successors.select(F.col("superseded").alias("node"), F.col("superseding").alias("image")), "node")
    out = write_table(own.unionAll(moved.join(after.select(F.col("node").alias("image")), "image", "left_semi").select("node", "image")).distinct(), "images")
    if not out.groupBy("image").count().where("count > 1").isEmpty():
        raise ValueError("two nodes have one image")
    return out


def push_edges(edges: DataFrame, images: DataFrame) -> DataFrame:
    """Edges under the node map; an edge with an end without image goes."""
    m = images
    out = edges.join(m.select(F.col("node").alias("u"), F.col("image").alias("x")), "u").join(m.select(F.col("node").alias("v"), F.col("image").alias("y")), "v")
    return graph.canonical(out.select("x", "y"), "x", "y")


def transport_loss(edges_before: DataFrame, edges_after: DataFrame, images: DataFrame) -> DataFrame:
    """One row, `severed`: images of edges that the later snapshot lacks; the
    transport is flat at 0."""
    pushed = push_edges(edges_before, images)
    return pushed.join(edges_after.select("u", "v"), ["u", "v"], "left_anti").agg(F.count(F.lit(1)).alias("severed"))


def depths(derived_from: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, depth): a leaf that is no artifact has 0, an artifact without
    parents 1, any other one more than its deepest parent."""
    arcs = derived_from.select(F.col("parent").alias("source"), F.col("id").alias("target"))
    level = graph.longest_chain(arcs)
    made = nodes.select(F.col("id").alias("node")).withColumn("made", F.lit(1))
    roots_made = arcs.select("source").distinct().join(arcs.select(F.col("target").alias("source")).distinct(), "source", "left_anti")
    # a chain that starts at an artifact counts one more than one that starts at a leaf
    starts = roots_made.select(F.col("source").alias("node")).join(made, "node", "left_semi")
    if starts.isEmpty():
        deep = level.select("node", (F.col("level") - 1).alias("depth"))
    else:
        extra = starts.select(F.concat(F.lit("leaf of "), "node").alias("source"), F.col("node").alias("target"))
        deep = graph.longest_chain(arcs.unionAll(extra)).where(~F.startswith("node", F.lit("leaf of "))).select("node", (F.col("level") - 1).alias("depth"))
    out = made.join(deep, "node", "full").select(F.col("node").alias("id"), F.coalesce("depth", F.lit(1)).cast("int").alias("depth"))
    return out


def leaves(derived_from: DataFrame) -> DataFrame:
    """(id, leaf): the refs without parents that an artifact rests on."""
    arcs = derived_from.select(F.col("parent").alias("source"), F.col("id").alias("target"))
    order = graph.closure(arcs)
    inner = derived_from.select(F.col("id").alias("source")).distinct()
    return order.join(inner, "source", "left_anti").select(F.col("target").alias("id"), F.col("source").alias("leaf"))


def lineage(attestations: DataFrame, start: str) -> DataFrame:
    """(id, missing): all parents of an attestation, at any remove; missing
    ones are named by a child but not there."""
    links = attestations.select("id", F.explode("derived_from_ids").alias("parent"))
    seen = attestations.sparkSession.createDataFrame([(start,)], "id string")
    frontier = seen
    while True:
        frontier = links.join(frontier, "id", "left_semi").select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = write_table(frontier, "lineage")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    known = attestations.select("id", F.lit(False).alias("missing"))
    return seen.where(F.col("id") != start).join(known, "id", "left").select("id", F.coalesce("missing", F.lit(True)).alias("missing"))
