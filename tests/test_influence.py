"""Product paths and the census of staged arcs, against plain enumeration."""

import heapq
import math
import random
import re

import pytest

from quern.operators import census, graph, merge_tree, paths

from .test_connectivity import forest, graph_of
from .test_connectivity import path as forest_path


def dijkstra(edges, a, b):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, -math.log(min(w, 1.0)) + 1e-12))
        near.setdefault(v, []).append((u, -math.log(min(w, 1.0)) + 1e-12))
    dist, prev, heap = {a: 0.0}, {}, [(0.0, a)]
    while heap:
        d, x = heapq.heappop(heap)
        if d > dist[x]:
            continue
        for y, c in near.get(x, ()):
            if d + c < dist.get(y, math.inf):
                dist[y], prev[y] = d + c, x
                heapq.heappush(heap, (d + c, y))
    if b not in dist:
        return None
    out = [b]
    while out[-1] != a:
        out.append(prev[out[-1]])
    return out[::-1]


def test_product_paths_and_where_chains_part(spark):
    rng = random.Random(2)
    edges = [(u, v, 0.2 + 0.7 * rng.random()) for u, v, _ in graph_of(3)]  # no ties
    df = spark.createDataFrame(edges, "u long, v long, w double")
    near = forest(edges)
    nodes = sorted(near)
    pairs = [tuple(rng.sample(nodes, 2)) for _ in range(60)] + [(100, 124), (0, 100), (999, 0)]
    asked = spark.createDataFrame([*pairs, (5, 5), pairs[0]], "a long, b long")
    got = {}
    for r in sorted(paths.product_paths(df, asked).collect()):
        assert r.step == len(got.setdefault((r.a, r.b), []))
        got[r.a, r.b].append(r.node)
    want = {(a, b): p for a, b in pairs if (p := dijkstra(edges, a, b))}
    assert got == want
    row = paths.bottleneck_vs_product(df, merge_tree.write_table(merge_tree.merge_tree(df), "tree"), asked).first()
    parted = sum(forest_path(near, a, b) != p for (a, b), p in want.items())
    assert 0 < parted < len(want) and tuple(row) == (len(want), parted, pytest.approx(parted / len(want), abs=1e-6))
    assert tuple(paths.bottleneck_vs_product(df, merge_tree.merge_tree(df), asked.limit(0)).first()) == (0, 0, None)


def arcs_of(rng, n, m, tag):
    out = {}
    while len(out) < m:
        s, t = rng.sample(range(n), 2)
        out[f"n{s:02}", f"n{t:02}"] = (f"n{s:02}", f"n{t:02}", rng.choice(["citation", "supersession"]), f"{tag}{len(out):02}")
    return list(out.values())


def test_census_influence_is_the_difference_of_two_censuses(spark):
    rng = random.Random(1)
    base = arcs_of(rng, 14, 20, "b")
    ends = {a[:2] for a in base}
    staged = [a for a in arcs_of(rng, 14, 6, "s") if a[:2] not in ends][:2] + [next((f"n{i:02}", f"n{i + 1:02}", "citation", "s99") for i in range(0, 12, 2) if (f"n{i:02}", f"n{i + 1:02}") not in ends)]
    schema = "source string, target string, kind string, witness string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    ranks = spark.createDataFrame([(f"n{i:02}", (i * 7) % 14, [f"e{i}"]) for i in range(13)], "ref string, rank int, evidence array<string>")
    claims = lambda rows: {(r.kind, tuple(r.members), tuple(r.witness)) for r in census.census(frame(rows), ranks, 4).collect()}
    before, after = claims(base), claims(base + staged)
    without = [claims(base + staged[:k] + staged[k + 1 :]) for k in range(len(staged))]
    want = {c: [s[3] for s, w in zip(staged, without, strict=True) if c not in w] for c in after - before}
    got = census.census_influence(frame(base), frame(staged), ranks, 4).collect()
    assert {(r.kind, tuple(r.members), tuple(r.witness)): r.attributed for r in got} == want and len(got) == len(want)
    assert {c[0] for c in want} == {census.LOOP, census.ASYMMETRY, census.REACH_BACK}
    assert not census.census_influence(frame(base), frame(staged).limit(0), ranks, 4).collect()
    assert graph.loops  # the full enumeration stays for whole censuses


def test_rows_of_one_source_do_not_meet_in_one_task(spark, monkeypatch):
    plans = []
    write = paths.write_table
    monkeypatch.setattr(paths, "write_table", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if tag == "front" else None, write(df, tag))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.5), (2, 3, 0.7)], "u long, v long, w double")
        got = sorted(map(tuple, paths.product_paths(e, spark.createDataFrame([(0, 2), (0, 3)], "a long, b long")).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(0, 2, 0, 0), (0, 2, 1, 1), (0, 2, 2, 2), (0, 3, 0, 0), (0, 3, 1, 1), (0, 3, 2, 2), (0, 3, 3, 3)]
    assert plans and not any(re.search(r"SortMergeJoin \[source#\d+L?\]", p) for p in plans)
