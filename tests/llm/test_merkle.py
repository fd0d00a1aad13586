"""The manifest against a tree built whole, on small and awkward tables."""

import random
import zlib
from hashlib import sha256

import pytest

from quern.llm import merkle

from .cases import SCHEMA, awkward, frame


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        at //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        text = r[4]
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        trees.setdefault(r[1], []).append((r[0], leaf_of(*r), leaf_of(*r[:4], lower) if tampered else leaf_of(*r)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs.append(levels_of([x[1] for x in trees[s]]))
    top = levels_of([x[-1][0] for x in subs])
    out = []
    for i, s in enumerate(names):
        for at, (doc, leaf, other) in enumerate(trees[s]):
            path = path_of(subs[i], at) + path_of(top, i)
            folded = other
            for left, right in path:
                folded = h(left + folded + right)
            out.append((doc, leaf, subs[i][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


def found(df):
    return sorted((tuple(r) for r in merkle.manifest_digest(df).collect()), key=repr)


def test_awkward_rows_match_the_whole_tree(spark):
    rows = awkward()
    assert found(frame(spark, rows)) == sorted(brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows]), key=repr)
    assert merkle.manifest_digest(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("levels", [1, 2])
def test_trees_of_several_tiers_and_many_sources(spark, monkeypatch, levels):
    """Blocks of 16 and 256 nodes: tiers above each other, the last runs of any length."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rng = random.Random(levels)
    sources = ["hot"] * 4370 + [f"s{i}" for i in range(40) for _ in range(rng.choice([1, 2, 15, 16, 17, 33]))] + [None] * 257
    rows = [(i, f"Text {i % 7}", "en", s, i, "", "", "") for i, s in enumerate(sources)] + [(5, "Text 5", "en", "hot", 5, "", "", "")] * 20
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == sorted(brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows]), key=repr)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_the_traversal_holds_each_leafs_path(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    walk = merkle.Traversal(leaves.__getitem__, n, len(levels) - 1)
    for at in range(n):
        if at:
            walk.advance()
        assert walk.sides == path_of(levels, at)
    assert merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]


def test_the_traversal_reads_a_leaf_once_a_level_and_holds_few(monkeypatch):
    asked = []
    walk = merkle.Traversal(lambda i: asked.append(i) or h(str(i)), 4096, 3)
    for _ in range(4095):
        walk.advance()
        held = sum(map(len, walk.runs)) + sum(len(t.nodes) + sum(map(len, t.open)) for t in walk.coming)
        assert held <= 3 * (16 + 16 + 2 * 16)
    assert len(asked) == 3 * 4096
