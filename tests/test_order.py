"""Levels, relations and convexity without a closure, against plain closures."""

import random

import pytest

from quern.operators import causal, graph, order


def closure(arcs):
    after = {}
    for s, t in arcs:
        after.setdefault(s, set()).add(t)
    out = {}

    def reach(n):
        if n not in out:
            out[n] = set()
            for t in after.get(n, ()):
                out[n] |= {t} | reach(t)
        return out[n]

    for s, _ in arcs:
        reach(s)
    return out


def longest(arcs):
    before = {}
    for s, t in arcs:
        before.setdefault(t, set()).add(s)
        before.setdefault(s, set())
    done = {}

    def level(n):
        if n not in done:
            done[n] = 1 + max((level(s) for s in before[n]), default=0)
        return done[n]

    return {n: level(n) for n in before}


def dag(seed):
    rng = random.Random(seed)
    arcs = {(i, i + 1) for i in range(0, 300) if i % 50}  # runs
    arcs |= {(a, b) for a, b in (sorted(rng.sample(range(300), 2)) for _ in range(40))}
    arcs |= {(400 + i // 2, 400 + i) for i in range(1, 60) if i // 2 != i}  # a tree
    return arcs


@pytest.mark.parametrize("small", [0, 5, 20_000])
def test_levels(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL", small)
    arcs = dag(small)
    df = spark.createDataFrame([*arcs, (7, 7), *list(arcs)[:5]], "source long, target long")
    assert {r.node: r.level for r in graph.longest_chain(df).collect()} == longest(arcs)
    assert graph.longest_chain(df.limit(0)).count() == 0
    for ring in ([(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 1)], [(1, 2), (2, 3), (3, 2), (3, 4), (5, 3)]):
        with pytest.raises(ValueError, match="cycle"):
            graph.longest_chain(spark.createDataFrame(ring, "source long, target long"))


def test_a_long_chain_takes_rounds_as_its_logarithm(spark, monkeypatch):
    monkeypatch.setattr(order, "SMALL", 0)
    rounds = []
    written = order.write_table
    monkeypatch.setattr(order, "write_table", lambda df, tag: rounds.append(tag) or written(df, tag))
    n = 12_000
    levels = graph.longest_chain(spark.range(1, n).selectExpr("id AS source", "id + 1 AS target"))
    assert levels.where("level <> node").isEmpty() and levels.count() == n
    assert rounds.count("runs") <= 16 and rounds.count("settled") <= 2


def crossed(seed, chains=6, length=14, crossings=16):
    """Chains and crossing edges without a cycle: edges only rise in time."""
    rng = random.Random(seed)
    times = {c: sorted(rng.sample(range(1000), length)) for c in range(chains)}
    cross = set()
    while len(cross) < crossings:
        c, d = rng.sample(range(chains), 2)
        i, j = rng.randrange(length), rng.randrange(length)
        if times[c][i] < times[d][j]:
            cross.add((f"c{c}", i, f"c{d}", j))
    events = [(f"c{c}:{i}", f"c{c}", i) for c in times for i in range(length)]
    arcs = [(f"c{c}:{i}", f"c{c}:{i + 1}") for c in times for i in range(length - 1)] + [(f"{c}:{i}", f"{d}:{j}") for c, i, d, j in cross]
    return events, sorted(cross), arcs


@pytest.mark.parametrize("seed", [1, 2])
def test_relations_and_fibres_by_chains(spark, seed):
    events, cross, arcs = crossed(seed)
    after = closure(arcs)
    e = spark.createDataFrame(events, "event string, chain string, position int")
    x = spark.createDataFrame(cross, "chain string, position int, to_chain string, to_position int")
    steps = order.write_table(order.closed_steps(x), "steps")
    rng = random.Random(seed)
    names = [n for n, *_ in events]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)] + [("c0:0", "no:1")]
    want = {(a, b): None if "no" in b else "same" if a == b else "before" if b in after.get(a, ()) else "after" if a in after.get(b, ()) else "concurrent" for a, b in pairs}
    assert set(want.values()) == {None, "same", "before", "after", "concurrent"}
    assert {(r.a, r.b): r.relation for r in order.relation(spark.createDataFrame(pairs, "a string, b string"), e, steps).collect()} == want
    ticks = [(n, f"t{rng.randrange(8)}") for n in names if rng.random() < 0.4]
    fibres = {}
    for n, t in ticks:
        fibres.setdefault(t, set()).add(n)
    between = {(t, n) for t, f in fibres.items() for n in names if n not in f and any(n in after.get(m, ()) for m in f) and any(m in after.get(n, ()) for m in f)}
    got = order.gaps_in_fibres(spark.createDataFrame(ticks, "event string, tick string"), e, x).collect()
    assert {tuple(r) for r in got} == between and len(got) == len(between) and between


def test_crossings_that_lead_back_are_cycles(spark):
    x = spark.createDataFrame([("a", 3, "b", 5), ("b", 6, "c", 1), ("c", 4, "a", 2)], "chain string, position int, to_chain string, to_position int")
    with pytest.raises(ValueError, match="cycle"):
        order.closed_steps(x)
    assert order.closed_steps(x.limit(0)).count() == 0
    ok = order.closed_steps(x.where("chain <> 'c'").unionAll(spark.createDataFrame([("c", 4, "a", 9)], x.schema)))
    assert sorted(map(tuple, ok.collect())) == [("a", 3, "b", 5), ("a", 3, "c", 1), ("b", 6, "a", 9), ("b", 6, "c", 1), ("c", 4, "a", 9)]
    assert causal.poset_from_chains  # the pairs of chains are still there for small ones
