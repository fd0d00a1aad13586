"""Ranks of stated queries among all rows, by blocks."""

import random

import numpy as np

from quern.operators import search


def brute(rows, k):
    def unit(v):
        x = np.array(v, np.float64)
        return x / (np.linalg.norm(x) or 1.0)

    want = {}
    for q, ql, qv in rows:
        if q is None or q % 5:
            continue
        near = []
        for i, label, v in rows:
            if i is not None and i != q:
                far = float("inf") if v is None or qv is None else round(1 - float(unit(v) @ unit(qv)), 9)
                near.append((far, i, label is not None and label == ql))
        near.sort()
        kin = [place for place, n in enumerate(near, 1) if n[2]]
        want[q] = (sum(place <= k for place in kin), kin[0] if kin else None)
    return want


def test_kin_ranks_equal_brute_force_and_hold_few_rows(spark, monkeypatch):
    """Copies, null and zero vectors, null and lone labels, cut into many groups."""
    rng = random.Random(5)
    spots = [[float(rng.randrange(-3, 4)) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice([0, 1, 2, 3, 3, None]), rng.choice(spots)) for i in range(260)]
    rows += [(300, 7, spots[0]), (301, 2, None), (302, 2, [0.0] * 6), (305, 1, None), (310, 0, [0.0] * 6), (None, 1, spots[1])]
    for name, size in (("QUERIES", 20), ("ROWS", 30), ("TILE", 3)):
        monkeypatch.setattr(search, name, size)
    written, write = [], search.write_table
    monkeypatch.setattr(search, "write_table", lambda df, tag: written.append(write(df, tag)) or written[-1])
    e = spark.createDataFrame(rows, "id long, label int, v array<float>")
    for k in (1, 3, 10):
        got = search.kin_ranks(e.where("id % 5 = 0").withColumnRenamed("id", "q"), e, k)
        assert {r.q: (r.hits, r.rank) for r in got.collect()} == brute(rows, k)
        assert max(t.count() for t in written) <= 56 * (k + 1) * 9  # queries, rows kept of each, slices


def test_a_query_without_other_rows_has_no_rank(spark):
    one = spark.createDataFrame([(100, 1, [1.0, 2.0])], "id long, label int, v array<float>")
    assert search.kin_ranks(one.withColumnRenamed("id", "q"), one).collect() == []
    none = one.where("id < 0")
    assert search.kin_ranks(none.withColumnRenamed("id", "q"), one).collect() == []
