"""What one task or round holds does not follow the size of the tables."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from quern.linalg import components as dense
from quern.operators import causal, graph, reconcile
from quern.sources import notes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_commit_files_are_read_by_blocks(spark, tmp_path):
    rng = random.Random(3)
    want, text = [], []
    for c in range(300):
        sha = f"{c:040x}"
        text.append(sha)
        for p in range(rng.choice([0, 1, 2, 40])):
            text.append(f":100644 100644 {'0' * 40} {p + 1:040x} A\tp {p}.md")
            want.append((sha, f"p {p}.md", None, f"{p + 1:040x}"))
    (tmp_path / "one").write_text("\n".join(text) + "\n")
    (tmp_path / "two").write_text("\n".join(text[:7]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = notes.commit_diffs(spark, str(tmp_path))
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    few = len([x for x in text[:7] if x.startswith(":")])
    assert sorted(rows, key=str) == sorted(want + want[:few], key=str)
    lines = [p for p in plan(spark.read.text(str(tmp_path), lineSep="\n")).splitlines() if "FileScan" in p]
    assert lines and "wholetext" not in plan(got)


def test_grounding_of_a_component_beyond_the_dense_ceiling(spark):
    """25,000 artifacts on two of forty places each, these on one authored root."""
    own = spark.range(25_000)
    arcs = own.select((F.col("id") + 1000).alias("id"), (F.col("id") % 40).alias("parent")).unionAll(own.select(F.col("id") + 1000, (F.col("id") * 7 + 1) % 40))
    arcs = arcs.unionAll(spark.range(40).select("id", F.lit(-1).cast("long")))
    got = dense.grounding_cut(arcs, spark.createDataFrame([(-1,)], "id long"))
    want = arcs.distinct().groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("want"))
    assert got.count() == 25_040 and got.join(want, "id").where("strength <> want").isEmpty()


def test_grounding_cuts_where_ways_meet(spark):
    arcs = [("m", "a"), ("m", "b"), ("a", "c"), ("b", "c"), ("c", "g"), ("c", "h"), ("n", "c"), ("n", "h"), ("h", "x"), ("x", "x2"), ("x2", "x"), ("z", "nothing")]
    got = dense.grounding_cut(spark.createDataFrame(arcs, "id string, parent string"), spark.createDataFrame([("g",), ("h",)], "id string"))
    assert dict(tuple(r) for r in got.collect()) == {"m": 2.0, "a": 1.0, "b": 1.0, "c": 2.0, "n": 2.0, "h": float("inf"), "x": 0.0, "x2": 0.0, "z": 0.0}


def test_brackets_are_carried_not_summed_anew(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rng = random.Random(4)
    ticks = [(at(rng.randrange(2000)), rng.randrange(500)) for _ in range(800)]
    walls = sorted({at(rng.randrange(2000)) for _ in range(200)})
    got = reconcile.generation_bracket(spark.createDataFrame(ticks, "at timestamp_ntz, generation int"), spark.createDataFrame([(w,) for w in walls], "wall timestamp_ntz"))
    for r in got.collect():
        lo = max((g for t, g in ticks if t <= r.wall), default=None)
        hi = min((g for t, g in ticks if t > r.wall), default=None)
        odd = lo is not None and hi is not None and (lo > hi or hi - lo > 1)
        assert (r.lo, r.hi, r.widened) == ((min(lo, hi), max(lo, hi), True) if odd else (lo, hi, False))
    assert "__r" in plan(got) and "UNBOUNDED FOLLOWING" not in plan(got).upper().replace("UNBOUNDEDFOLLOWING$()", "UNBOUNDED FOLLOWING").split("BROADCASTEXCHANGE")[0]


def test_pairs_of_versions_that_come_once_are_not_shuffled(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z"), ("c", 1, "p"), ("c", 2, "q")]
    v = spark.createDataFrame(rows, "doc_id string, version_seq int, digest string")
    got = sorted(tuple(r) for r in causal.poset_from_chains(v).collect())
    assert got == sorted({(s, t) for d, i, s in rows for e, j, t in rows if d == e and i < j and s != t})
    once = causal.poset_from_chains(v.where("doc_id = 'c'"))
    assert [tuple(r) for r in once.collect()] == [("p", "q")] and "HashAggregate" not in plan(once)


def test_coproduction_deals_its_pairs_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "GROUPED_ROWS", 10)
    m = spark.range(200).select((F.col("id") % 50).alias("g"), (F.col("id") % 7).alias("i"))
    got = graph.coproduction(m, "g", "i")
    assert got.rdd.getNumPartitions() >= 1 and ", 20)" in plan(got)
    groups = {}
    for r in m.collect():
        groups.setdefault(r.g, set()).add(r.i)
    want = {}
    for s in groups.values():
        for u in s:
            for v in s:
                if u < v:
                    want[u, v] = want.get((u, v), 0) + 1
    assert {(r.u, r.v): r.w for r in got.collect()} == want


def test_edges_are_sent_packed_and_counts_come_back_packed(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    monkeypatch.setattr(graph, "PACKED_EDGES", 25)  # several rows for each two colours
    rng = random.Random(8)
    edges = [(f"n{u:02}", f"n{v:02}") for u in range(30) for v in range(u + 1, 30) if rng.random() < 0.4 or v < 8] + [("x", "y")]
    df = spark.createDataFrame(edges, "u string, v string").repartition(3)
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = graph.forman(df)
    assert sorted(map(tuple, out.collect())) == sorted((u, v, 4 - len(near[u]) - len(near[v]) + 3 * len(near[u] & near[v])) for u, v in edges)
    sent = graph._in_thirds(df, lambda third: pa.table({"n": [len(third.code)]}), "n long")
    assert "MapInArrow" in plan(sent) and "hashpartitioning(u" not in plan(graph._on_edges(df))


def test_triangles_are_found_where_three_colours_meet(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 150)
    monkeypatch.setattr(graph, "TASK_WEDGES", 40)
    rng = random.Random(6)
    edges = {(u, v): rng.choice([-1, 1]) for u in range(40) for v in range(u + 1, 40) if rng.random() < 0.5 or v < 12}
    df = spark.createDataFrame([(u, v, s) for (u, v), s in edges.items()], "u long, v long, sign int")
    want = {(a, b, c): edges[a, b] * edges[a, c] * edges[b, c] < 0 for a, b in edges for c in range(b + 1, 40) if (a, c) in edges and (b, c) in edges}
    got = [tuple(r) for r in graph.triangles(df).collect()]
    assert len(got) == len(want) and set(got) == set(want)
    signed = graph.frustrated(df).collect()
    assert len(signed) == len(want) and {(r.a, r.b, r.c): r.frustrated for r in signed} == want
    per = {r.node: r.triangles for r in graph.clustering(df).collect()}
    assert per == {n: sum(n in t for t in want) for n in {x for e in edges for x in e}}
    words = df.select(F.col("u").cast("string").alias("x"), F.col("v").cast("string").alias("y"))
    words = words.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    assert graph.triangles(words).where("a < b AND b < c").count() == len(want)
    bent = {(r.u, r.v): r.curvature for r in graph.forman(df).collect()}
    deg = {n: sum(n in e for e in edges) for n in per}
    assert bent == {(u, v): 4 - deg[u] - deg[v] + 3 * sum(u in t and v in t for t in want) for u, v in edges}
    assert "Join" not in plan(graph.triangles(df))
