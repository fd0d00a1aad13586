import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import ids, text
from quern.linalg import kernels
from quern.operators import graph, pairs, reports
from quern.operators.components import connected_components, joined


def test_batch_hash_is_the_digest_of_the_canonical_json(spark):
    rows = [("c1", "b.py", "f", 'a "doc" é', ["x", "y"], 3), ("c1", "a.py", "g", None, [], -1), ("c1", "a.py", "g", None, [], -1), ("c2", "é.py", "h", "\\ / \n", None, 0)]
    df = spark.createDataFrame(rows, "commit_sha string, path string, qualname string, docstring string, refs array<string>, line int")
    cols = df.columns
    want = {}
    for commit in ("c1", "c2"):
        own = sorted((dict(zip(cols, r, strict=True)) for r in rows if r[0] == commit), key=lambda r: (r["commit_sha"], r["path"], r["qualname"]))
        want[commit] = hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = ids.batch_hash(df, cols, ["commit_sha", "path", "qualname"], ["commit_sha"]).collect()
    assert {r.commit_sha: r.content_hash for r in got} == want


def test_probe_hash_is_that_of_sorted_fields(spark):
    probes = [("p2", "why é", ["b", "a"]), ("p1", "how", [])]
    h = hashlib.sha256()
    for i, q, paths in sorted(probes):
        h.update(f"{i}\0{q}\0".encode() + b"".join(p.encode() + b"\0" for p in sorted(paths)) + b"\x01")
    df = spark.createDataFrame(probes, "probe_id string, query string, answer_paths array<string>")
    assert ids.probe_set_hash(df).first().probe_hash == h.hexdigest()


def test_secret_patterns_have_their_names():
    assert [n for n, _ in text.SECRETS] == ["aws-access-key-id", "aws-secret-access-key", "pem-private-key", "sk-api-key", "keyword-bound-secret"]


def cliques(*groups):
    found = sorted({(a, b) for g in groups for a in g for b in g if a < b})
    return np.array([e[0] for e in found]), np.array([e[1] for e in found])


def test_sparse_hodge_kernels_equal_dense_algebra():
    rng = np.random.default_rng(2)
    for n, p in ((6, 0.5), (12, 0.35), (9, 0.9)):
        i, j = (x for x in np.triu_indices(n, 1))
        keep = rng.random(len(i)) < p
        i, j = i[keep], j[keep]
        d1, d2 = kernels.boundaries(n, i, j)
        assert not (d1 @ d2).any()
        rank = lambda m: int(np.linalg.matrix_rank(m)) if m.size else 0
        assert kernels.betti_1(n, i, j) == len(i) - rank(d1) - rank(d2)
        flow = rng.normal(size=len(i))
        grad, curl, rest = kernels.hodge_split(n, i, j, flow)
        assert np.allclose(grad, d1.T @ np.linalg.lstsq(d1.T, flow, rcond=None)[0], atol=1e-9)
        if d2.size:
            assert np.allclose(curl, d2 @ np.linalg.lstsq(d2, flow, rcond=None)[0], atol=1e-9)
        assert np.allclose(grad + curl + rest, flow) and abs(grad @ curl) < 1e-9


def test_a_clique_of_two_hundred_fits(monkeypatch):
    i, j = cliques(range(200))
    assert kernels.betti_1(200, i, j) == 0  # 1.3 million triangles, no dense matrix
    monkeypatch.setattr(kernels, "MAX_TRIANGLES", 1000)
    with pytest.raises(ValueError, match="triangles"):
        kernels.betti_1(200, i, j)


def test_few_and_many_edges_give_the_same_components_and_forest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), round(float(w), 2)) for a, b, w in zip(rng.integers(0, 60, 90), rng.integers(0, 60, 90), rng.random(90), strict=True) if a < b]
    rows = list({(a, b): (a, b, w) for a, b, w in rows}.values())
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    few = sorted(connected_components(edges, "u", "v").collect()), sorted(graph.spanning_forest(edges).collect())
    for module in (graph, __import__("quern.operators.components", fromlist=["x"])):
        monkeypatch.setattr(module, "SMALL", 3)
    assert few == (sorted(connected_components(edges, "u", "v").collect()), sorted(graph.spanning_forest(edges).collect()))
    assert joined([(1, 2), (3, 2), (7, 9)]) == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}


def test_cosine_pairs_and_overlap_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)] + [(150, [0.0] * 5, 1), (151, None, 2)], "id long, vector array<double>, label int")
    u = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((1, 5))])
    sims, label = u @ u.T, np.array([i % 3 for i in range(150)] + [1])
    i, j = np.triu_indices(151, 1)
    for block in (8192, 40):
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "TILE", 16)
        got = {(r.a, r.b): r.sim for r in pairs.cosine_pairs(df, 0.5).collect()}
        assert got.keys() == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if sims[a, b] >= 0.5}
        out = pairs.cosine_overlap(df, "label").first()
        same = label[i] == label[j]
        assert out.median_within == pytest.approx(np.median(sims[i, j][same]), abs=1e-10)
        assert out.median_cross == pytest.approx(np.median(sims[i, j][~same]), abs=1e-10)


def test_snippets_stop_at_the_limit(spark):
    rows = [("a", 0, " one "), ("a", 1, ""), ("a", 2, "two  "), ("a", 3, "x" * 50), ("a", 4, "never"), ("b", 0, None), ("b", 1, "z")]
    got = {r.digest: r.snippet for r in reports.snippets(spark.createDataFrame(rows, "digest string, chunk_index int, text string"), 20).collect()}
    assert got == {"a": ("one two " + "x" * 50)[:20], "b": "z"}


def test_fibres_and_accounts(spark):
    events = spark.createDataFrame([(e, "s") for e in "abcd"], "event string, store string")
    order = spark.createDataFrame([(x, y) for x in "abcd" for y in "abcd" if x < y], "source string, target string")
    ticks = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")], "event string, tick string")
    gaps = sorted(map(tuple, reports.gaps_in_fibres(reports.clock_ticks(events, "given", ticks), order).collect()))
    assert gaps == [("1", "b"), ("2", "c")]
    assert reports.gaps_in_fibres(reports.clock_ticks(events, "event"), order).count() == 0
    with pytest.raises(ValueError, match="no clock"):
        reports.clock_ticks(events, "wall")
    rows = reports.accounted(events, F.when(F.col("event") == "a", "new").otherwise("odd"), ("new", "same")).collect()
    assert {r.bucket: (r.n, r.complete) for r in rows} == {"new": (1, None), "same": (0, None), "total": (4, False)}


def test_cosine_pairs_of_string_ids_with_empty_tiles(spark):
    """1,500 directions are more than a tile; two of them are one."""
    turn = [(f"n{i}", np.pi * (i or 7) / 1500) for i in range(1500)]
    df = spark.createDataFrame([(n, [float(np.cos(t)), float(np.sin(t))]) for n, t in turn], "id string, vector array<double>")
    assert [(r.a, r.b) for r in pairs.cosine_pairs(df, 1 - 1e-7).collect()] == [("n0", "n7")]


def test_forests_and_label_sums_of_pairs_in_blocks(spark, monkeypatch):
    """A pair of blocks gives its forest, or its sums; what is made of these is that of all pairs."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(120, 3)), 1)
    v[60:70] = v[50]  # copies: ties of weight
    df = spark.createDataFrame([(i, x.tolist(), None if i % 7 == 0 else f"g{i % 4}") for i, x in enumerate(v)], "id long, vector array<double>, label string")
    monkeypatch.setattr(pairs, "BLOCK", 40)
    named = lambda t: t.select(F.col("a").alias("u"), F.col("b").alias("v"), F.round("sim", 9).alias("w"))
    full = pairs.cosine_pairs(df, 0.6)
    thin = pairs.cosine_pairs(df, 0.6, forest=True)
    assert thin.count() < full.count() / 3
    weight = lambda t: (t.count(), round(t.agg(F.sum("w")).first()[0], 6))
    assert weight(graph.spanning_forest(named(thin))) == weight(graph.spanning_forest(named(full)))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims, label = u @ u.T, [None if i % 7 == 0 else f"g{i % 4}" for i in range(120)]
    want = {}
    for i in range(120):
        for j in range(i + 1, 120):
            if sims[i, j] >= 0.6:
                k = frozenset([label[i], label[j]])
                want[k] = want.get(k, 0) + sims[i, j]
    got = {}
    for r in pairs.cosine_between(df, "label", 0.6).collect():
        got[frozenset([r.u, r.v])] = got.get(frozenset([r.u, r.v]), 0) + r.w
    assert got == pytest.approx(want)
    e = [(0, 1, 0.5), (0, 2, 0.5), (1, 2, 0.5), (2, 3, 0.9), (0, 3, 0.4)]
    assert sorted(pairs.forest_places(*map(np.array, zip(*e, strict=True))).tolist()) == [0, 1, 3]
