"""Components, merge trees and what is asked of them, against plain Python."""

import random

import pytest

from quern.operators import components, merge_tree
from quern.operators.components import connected_components, joined


@pytest.fixture
def few(monkeypatch):
    """Rounds that connected_components takes when one task joins four edges."""
    rounds = []
    written = components.write_table

    def counted(df, tag):
        if tag == "step":
            rounds.append(tag)
        return written(df, tag)

    monkeypatch.setattr(components, "SMALL", 4)
    monkeypatch.setattr(components, "write_table", counted)
    return rounds


def chain(n, order):
    ids = {"rising": range(n), "falling": range(n, 0, -1), "zigzag": [i // 2 if i % 2 else n - i // 2 for i in range(n)]}[order]
    ids = list(ids)
    return list(zip(ids[:-1], ids[1:], strict=True))


@pytest.mark.parametrize("order", ["rising", "falling", "zigzag"])
def test_a_chain_takes_rounds_as_the_logarithm_of_its_links(spark, few, order):
    edges = chain(1200, order)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == joined(edges)
    assert len(few) <= 14  # 1,200 links to 4, about half going a round


def test_components_of_chains_stars_and_rings_in_several_rounds(spark, few):
    rng = random.Random(3)
    edges = chain(40, "zigzag") + [(1000, 1001 + i) for i in range(60)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    edges += [(3000 + rng.randrange(50), 3000 + rng.randrange(50)) for _ in range(40)]
    df = spark.createDataFrame([*edges, edges[0], (None, 5), (7, None)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == joined((a, b) for a, b in edges if a != b)
    assert len(few) > 1
    text = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")
    got = {r.id: r.component for r in connected_components(text).collect()}
    assert got == joined((f"n{a}", f"n{b}") for a, b in edges if a != b)


def forest(edges):
    """Kruskal, heaviest first, ties to the smaller pair: node -> {neighbour: weight}."""
    near, up = {}, {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v, w in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        if root(u) != root(v):
            up[root(u)] = root(v)
            near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = w
    return near


def path(near, a, b):
    stack, seen = [(a, [a])], {a}
    while stack:
        x, p = stack.pop()
        if x == b:
            return p
        for y in near.get(x, {}):
            if y not in seen:
                seen.add(y)
                stack.append((y, [*p, y]))
    return None


def bottleneck(near, a, b):
    p = path(near, a, b)
    return None if p is None or a == b else min(near[x][y] for x, y in zip(p[:-1], p[1:], strict=True))


def graph_of(seed):
    """Ties, a long chain, a dense part and parts that are apart."""
    rng = random.Random(seed)
    edges = {}
    for a, b in chain(60, "zigzag"):
        edges[min(a, b), max(a, b)] = rng.choice([0.3, 0.4, 0.5, 0.6])
    for lo, n in ((100, 25), (200, 12)):
        for _ in range(70):
            a, b = sorted(rng.sample(range(lo, lo + n), 2))
            edges[a, b] = round(rng.random(), 1)
    return [(u, v, w) for (u, v), w in edges.items()]


@pytest.mark.parametrize("small", [6, 20_000])
def test_bottlenecks_and_chains_are_those_of_the_forest(spark, monkeypatch, small):
    monkeypatch.setattr(merge_tree, "SMALL", small)
    edges = graph_of(small)
    near = forest(edges)
    df = spark.createDataFrame([*edges, (3, 3, 9.0), (edges[0][1], edges[0][0], 0.01), (1, 2, None)], "u long, v long, w double")
    tree = merge_tree.write_table(merge_tree.merge_tree(df), "tree")
    got = {(r.u, r.v): r.w for r in merge_tree.forest_of(tree).collect()}
    assert got == {(u, v): w for u in near for v, w in near[u].items() if u < v}
    rng = random.Random(1)
    nodes = sorted(near)
    pairs = [tuple(rng.sample(nodes, 2)) for _ in range(150)] + [(0, 59), (5, 5), (0, 100), (9999, 0), (9999, 9999)]
    asked = spark.createDataFrame(pairs, "a long, b long")
    found = {(r.a, r.b): r.bottleneck for r in merge_tree.bottlenecks(asked, tree).collect()}
    assert found == {(a, b): bottleneck(near, a, b) for a, b in pairs}
    ways = {}
    for r in sorted(merge_tree.chains(asked, tree).collect()):
        assert r.step == len(ways.setdefault((r.a, r.b), []))
        ways[r.a, r.b].append(r.node)
    assert ways == {(a, b): p for a, b in pairs if (p := path(near, a, b))}
    grid = [0.3, 0.45, 0.6]
    snapped = {(r.a, r.b): r.sigma_star for r in merge_tree.sigma_star(asked, tree, grid).collect()}
    assert snapped == {p: w and max((g for g in grid if g <= w), default=None) for p, w in found.items()}
    assert merge_tree.merge_tree(df.limit(0)).count() == 0


def test_influence_of_staged_edges_is_what_recomputing_gives(spark, monkeypatch):
    monkeypatch.setattr(merge_tree, "SMALL", 8)
    rng = random.Random(4)
    grid = [0.3, 0.5, 0.7]
    base = [(a, b, rng.choice([0.3, 0.5, 0.7, 0.9])) for lo in range(0, 60, 6) for a, b in [(lo + i, lo + i + 1) for i in range(5)]]
    staged = [(*sorted(rng.sample(range(60), 2)), rng.choice([0.2, 0.3, 0.5, 0.7])) for _ in range(14)] + [(0, 59, 0.7), (1, 58, 0.7)]
    nodes = range(60)
    pairs = [(a, b) for a in nodes for b in nodes if a < b][::3]

    def snapped(edges):
        best = {}
        for u, v, w in edges:
            if w >= grid[0]:
                best[u, v] = max(best.get((u, v), 0), w)
        near = forest([(*e, w) for e, w in best.items()])
        return {p: (w := bottleneck(near, *p)) and max(g for g in grid if g <= w) for p in pairs}

    before, after = snapped(base), snapped(base + staged)
    without = [snapped(base + staged[:k] + staged[k + 1 :]) for k in range(len(staged))]
    want = set()
    for p in pairs:
        if before[p] != after[p]:
            named = [staged[k][:2] for k in range(len(staged)) if without[k][p] == before[p]]
            want |= {(*p, before[p], after[p], *e) for e in named or [(None, None)]}
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long, w double")
    got = merge_tree.influence(frame(base), frame(staged), spark.createDataFrame(pairs, "a long, b long"), grid).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert any(x[4] is None for x in want) and any(x[2] is not None for x in want)
    assert not merge_tree.influence(frame(base), frame(staged).limit(0), spark.createDataFrame(pairs[:9], "a long, b long"), grid).collect()
