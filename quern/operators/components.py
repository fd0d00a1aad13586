"""Connected components by contraction, on tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table


#: So few edges are joined by one task.
SMALL = 20_000


def joined(edges: Iterable[tuple]) -> dict:
    """node -> the least node that the edges reach."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _join_few(left: DataFrame) -> DataFrame:
    """(id, to) of at most SMALL edges (hi, lo), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = [], None
        for b in batches:
            kind = b.column(0).type
            table += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        found = joined(table)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), kind)], ["id", "to"])

    kind = left.schema["hi"].dataType.simpleString()
    return left.select("hi", "lo").coalesce(1).mapInArrow(run, f"id {kind}, to {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that has an edge; component is the
    smallest id that links reach.

    Each round maps every node to that of itself and its neighbours whose
    hash of (id, round) is least, rewrites the edges by that map and drops
    loops and repeats. The hash is another one in every round, so about half
    of the nodes go in a round whatever the order of the ids: an ordered
    chain takes log2(links) rounds, a star one. The last SMALL edges are
    joined by one task. The maps, each about half as long as the one before,
    are written, then applied to each other from the last to the first.
    Edges, maps and labels stay in Spark; only the number of edges left comes
    to the driver. Rows with a null end are no edges; an empty table gives an
    empty result.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    left = write_table(pairs.where("hi > lo").distinct(), "edges")
    maps: list[DataFrame] = []
    while n := left.count():
        if n <= SMALL:
            maps.append(write_table(_join_few(left), "step"))
            break
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        ends = left.select(F.col("hi").alias("id"), ranked("lo").alias("other")).unionAll(left.select(F.col("lo").alias("id"), ranked("hi").alias("other")))
        step = ends.groupBy("id").agg(F.min("other").alias("first"))
        maps.append(write_table(step.select("id", F.least("first", ranked("id"))["id"].alias("to")), "step"))
        hi = maps[-1].select(F.col("id").alias("hi"), F.col("to").alias("x"))
        lo = maps[-1].select(F.col("id").alias("lo"), F.col("to").alias("y"))
        moved = left.join(hi, "hi").join(lo, "lo")
        left = write_table(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi > lo").distinct(), "edges")
    if not maps:
        return left.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    found = maps.pop()
    if not maps:  # one task has found the least ids
        return found.select("id", F.col("to").alias("component"))
    while maps:
        last = found.select(F.col("id").alias("to"), F.col("to").alias("end"))
        found = write_table(maps.pop().join(last, "to", "left").select("id", F.coalesce("end", "to").alias("to")), "labels")
    least = found.groupBy("to").agg(F.min("id").alias("component"))
    return found.join(least, "to").select("id", "component")
