import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import minhash, pivots, sketches, warc
from quern.operators.components import connected_components
from quern.llm.words import shingle_set

from .cases import awkward, frame


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {x: u.root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows, percent=85):
    u, flat = Union(), [(d, s) for d, t in rows if d is not None and (s := shingles(t))]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                u.join(a, b)
    return u


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    base = [[f"t{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(12)]
    rows = [(i, edited(rng, base[i % 12], rng.choice([0, 0, 1, 2, 3, 4, 5])), *[None] * 6) for i in range(160)]
    rows = [*rows, *((r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward())]
    # one id with unlike texts: its rows are one node and carry links on
    rows += [(501, "lone " * 9, *[None] * 6), (501, rows[3][1], *[None] * 6), (502, "lone " * 9, *[None] * 6), (503, "lone " * 8 + "x", *[None] * 6)]
    u = near_brute([(r[0], r[1]) for r in rows])
    out = minhash.near_duplicates(frame(spark, rows), percent=85)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == u.root(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    size = {r[0]: len(shingles(r[1])) for r in rows[:160]}
    assert all(r.n_shingles == size[r.doc_id] for r in got if r.doc_id in size)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    """By row: repeated and null ids, unlike texts under one id, pairs of a
    similarity between 0.80 and 0.85."""
    rng = random.Random(12)
    base = [[f"t{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(6)]
    rows = [(rng.choice([None, i, i // 3]), edited(rng, base[i % 6], rng.choice([0, 0, 1, 2, 3, 4])), None, f"s{i}", *[None] * 4) for i in range(90)]
    rows += [(7, "lone text of its own here", *[None] * 6), (7, None, *[None] * 6), (7, " ", *[None] * 6), (None, "", *[None] * 6), rows[4], rows[4]]
    rows += awkward()
    u = near_brute([(i, r[1]) for i, r in enumerate(rows)], 80)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[u.root(i) if shingles(r[1]) else (i,)].append(r)
    near = [len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[:84], rows[6:90], strict=True)]
    assert any(0.80 <= x < 0.85 for x in near)
    out = minhash.drop_near_duplicates(frame(spark, rows))
    got = Counter(tuple(r)[:2] for r in out.collect())
    assert out.columns == frame(spark, []).columns and sum(got.values()) == len(groups)
    for own in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in own)
        assert sum(got[r[:2]] for r in set(own) if (r[0] is None, r[0] or 0) == least) >= 1
    assert minhash.drop_near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("percent", "edits"), [(80, (4, 5)), (60, (9, 10))])
def test_near_duplicates_at_lower_similarities(spark, percent, edits):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(200)]
        other = list(words)
        for at in rng.sample(range(4, 196, 10), edits[g % 2]):  # apart, so that each edit takes five shingles
            other[at] = f"e{g}x{at}"
        a, b = " ".join(words), " ".join(other)
        near = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert (near >= percent / 100) == (g % 2 == 0) and near < percent / 100 + 0.05
        rows += [(2 * g, a, *[None] * 6), (2 * g + 1, b, *[None] * 6)]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + g % 2}
    got = minhash.near_duplicates(frame(spark, rows), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_bands_miss_one_pair_in_a_million_at_most():
    assert minhash.band_rows(85) == minhash.ROWS
    for percent in range(50, 100, 5):
        rows = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (2 * minhash.PERMUTATIONS // rows) <= 1e-6


def test_signature_estimates_similarity_without_bias():
    rng = random.Random(4)
    words = [f"a{i}" for i in range(400)]
    a = shingle_set(" ".join(words).encode())
    b = shingle_set(edited(rng, words, 12).encode())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    keys = minhash.minmax_bands([a, b], permutations=600, rows=1)
    assert np.mean(keys[0] == keys[1]) == pytest.approx(true, abs=0.06)


def test_fingerprints_match_brute_force(spark):
    rows = [r for r in awkward()[:-1]]
    ids = [r[0] for r in rows]
    out = sketches.version_fingerprints(frame(spark, [r for i, r in enumerate(rows) if r[0] not in ids[:i]])).collect()
    own = sorted({r[0]: r[1] or "" for r in rows}.items(), reverse=True)
    got = {r.doc_id: r for r in out}
    assert len(got) == len(out) == len(own)
    for (d, t), (_, u) in zip(own, own[1:] + own[:1], strict=True):
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        for other, near in ((e, r.near_edited), (u, r.near_next)):
            a, b = (set(sketches.paragraph_digests(x.encode()).tolist()) for x in (t, other))
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    prints = defaultdict(set)
    for d, t in own:
        prints[t].add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_with_ids_that_many_rows_repeat(spark):
    """A third of the rows without an id, a third under one id: every row has
    its successor in the ring, and no range holds a hot id whole."""
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {rng.randint(0, 150)} é " * rng.randint(1, 4), *[None] * 6) for i in range(600)]
    frame_ = frame(spark, rows).repartition(5)
    signed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    ring = sorted(((r[0] is not None, r[0] or 0, signed(r[1]) if r[0] in (None, 5) else 0, r[1]) for r in rows), reverse=True)
    want = Counter()
    for (known, d, _, t), (*_, u) in zip(ring, ring[1:] + ring[:1], strict=True):
        want[d if known else None, hashlib.sha256(sketches.edit_with_next(t, u).encode()).hexdigest()] += 1
    got = sketches.version_fingerprints(frame_).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
    hot = sketches._hot_ids(frame_.selectExpr("doc_id AS id"), 4)
    assert set(hot) == {None, 5}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_fingerprints_of_few_or_odd_rows(spark, n):
    rows = [(i, "one two three four five six", *[None] * 6) for i in range(n)]
    out = sketches.version_fingerprints(frame(spark, rows)).collect()
    assert len(out) == n
    odd = sketches.version_fingerprints(frame(spark, [*rows, (None, "x", *[None] * 6), (None, None, *[None] * 6)])).collect()
    assert len(odd) == n + 2


def test_peeling_recovers_the_differing_digests():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    pairs = [(pool[:0], pool[:0]), (pool[:5], pool[:5]), (pool[:1000], pool[3:1004]), (pool[:2000], pool[2000:]), (pool[:1], pool[:0])]
    who, key, sign = sketches.differences([p[0] for p in pairs], [p[1] for p in pairs])
    for i, (a, b) in enumerate(pairs):
        own = who == i
        assert set(key[own & (sign == 1)].tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(key[own & (sign == -1)].tolist()) == set(b.tolist()) - set(a.tolist())


def vector_rows():
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((n, (c + rng.normal(size=16) * rng.choice([0, 0.03, 0.05])).tolist(), label, "x"))
                n += 1
    odd = [None, [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [], [1e-200] * 16, [1e200] * 16, rows[0][1], [2 * x for x in rows[0][1]], [1.0, 2.0]]
    return rows + [(n + i, v, 0, "x") for i, v in enumerate(odd)] + [rows[0], (None, rows[0][1], 0, "x")]


def test_vector_links_match_brute_force(spark):
    rows = vector_rows()
    # all comparable vectors of a label in one list, and cut into many blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, pivots string")
    u, links = Union(), Counter()

    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt((v * v).sum())

    flat = [(i, unit(v), l) for i, v, l, _ in rows if i is not None and l is not None and fine(v)]
    for k, (a, v, l) in enumerate(flat):
        for b, w, m in flat[:k]:
            if l == m and len(v) == len(w) and v @ w >= 0.98:
                u.join(a, b)
                links[a] += 1
                links[b] += 1
    repeated = rows[0][0]
    for block in (512, 7):
        pivots.BLOCK, old = block, pivots.BLOCK
        try:
            got = pivots.vector_links(df, shared=1).collect()
        finally:
            pivots.BLOCK = old
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is not None:
                want = links[r.vec_id] // (2 if r.vec_id == repeated else 1)
                assert abs(r.n_links - want) <= (r.vec_id == repeated), r
                assert r.component_id == u.root(r.vec_id) and r.kept == (r.vec_id == r.component_id)
    assert pivots.vector_links(df.limit(0)).count() == 0


def test_pivot_recall(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(60):
        centre = rng.normal(size=64)
        rows += [(c * 20 + i, (centre + rng.normal(size=64) * 0.1).tolist(), 1) for i in range(20)]
    true = sum(n for n, _ in linked_by_force(rows).values())
    out = pivots.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = out.agg(F.sum("n_links")).first()[0]
    assert 0.98 * true <= found <= true


def test_recall_on_the_hot_table(spark):
    """The shipped settings against brute force over all of check_h."""
    if not Path("/root/testdata/check_h/embeddings.parquet").exists():
        pytest.skip("no check tables here")
    df = spark.read.parquet("/root/testdata/check_h/embeddings.parquet")
    true = defaultdict(int)
    for _, own in df.where("label IS NOT NULL AND embedding IS NOT NULL").toPandas().groupby("label"):
        v = np.array(own["embedding"].tolist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
        for at in range(0, len(v), 1000):
            for i, n in enumerate((v[at : at + 1000] @ v.T >= 0.98).sum(axis=1) - 1):
                true[own["vec_id"].iloc[at + i]] += int(n)
    got = {r.vec_id: r.n_links for r in pivots.vector_links(df).collect()}
    assert all(got[i] <= n for i, n in true.items())
    assert sum(got.values()) >= 0.999 * sum(true.values())


def planted(widths, seed=14):
    """Groups of near vectors among lone ones, of several lengths, as floats."""
    rng = np.random.default_rng(seed)
    rows = []
    for width, groups, lone, spread in widths:
        for _ in range(groups):
            centre = rng.normal(size=width)
            rows += [((centre + rng.normal(size=width) * spread), 1) for _ in range(rng.integers(2, 9))]
        rows += [(rng.normal(size=width), int(rng.integers(0, 2))) for _ in range(lone)]
    return [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]


def linked_by_force(rows):
    u, links = Union(), Counter()
    for width in {len(r[1]) for r in rows}:
        own = [r for r in rows if len(r[1]) == width]
        v = np.array([r[1] for r in own], np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        label = np.array([r[2] for r in own])
        for i, j in zip(*np.nonzero(np.triu((v @ v.T >= 0.98) & (label[:, None] == label), 1)), strict=True):
            a, b = own[i][0], own[j][0]
            u.join(a, b)
            links[a] += 1
            links[b] += 1
    return {r[0]: (links[r[0]], u.root(r[0])) for r in rows}


@pytest.mark.parametrize("block", [1024, 40, 6])
def test_vector_links_as_shipped_match_brute_force(spark, block):
    """Eight nearest pivots, three shared, several lengths; also with lists
    that are split by further pivots and cut into blocks."""
    rows = planted([(16, 60, 200, 0.03), (24, 25, 50, 0.02), (3, 0, 1, 0), (5, 1, 0, 0.01)])
    want = linked_by_force(rows)
    assert sum(n for n, _ in want.values()) > 800
    pivots.BLOCK, old = block, pivots.BLOCK
    try:
        got = pivots.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    finally:
        pivots.BLOCK = old
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_long_lists_are_split_where_that_helps(spark):
    """Spread rows over pivots: parts are shorter. One tight group: the parts
    would be as long as the list, so it stays whole."""
    rng = random.Random(3)
    spread = [(i, 1, 4, sorted(rng.sample(range(12), 8))) for i in range(400)]
    tight = [(1000 + i, 2, 4, list(range(8))) for i in range(400)]
    df = spark.createDataFrame(spread + tight, "id long, label int, width int, marks array<int>")
    open_ = pivots._deeper(df.selectExpr("*", "-1 AS at", "3 AS both"), 1)
    split = pivots._split(open_, 1, 20).select("label").distinct().collect()
    assert [r.label for r in split] == [1]
    deeper = pivots._deeper(pivots._deeper(open_, 2), 3)
    keys = {(r.k1, r.k2, r.k3) for r in deeper.where("id = 1000").collect()}
    assert keys == {(a, b, c) for a in range(6) for b in range(a + 1, 7) for c in range(b + 1, 8)}


def test_loser_tree_merges_any_runs():
    rng = random.Random(7)
    for k in range(9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(x for r in runs for x in r)
        assert list(warc.merge_runs([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_ranges_are_merged_from_pieces_of_runs(spark):
    """Hot URLs and repeated entries over many ranges; pieces in any order."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), f"t{rng.randint(0, 3)}", rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    entries = spark.createDataFrame(rows, "urlkey string, captured string, id long, extra int").repartition(7)
    warc.RANGE_ROWS, old = 100, warc.RANGE_ROWS
    try:
        got = sorted(warc.merged_index(entries).collect(), key=lambda r: r.position)
    finally:
        warc.RANGE_ROWS = old
    assert [r.position for r in got] == list(range(3000)) and sorted(r.extra for r in got) == list(range(3000))
    order = [(r.urlkey or "", r.captured, r.id or 0) for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("blocks", [[(0, 90)], [(60, 90), (0, 60)], [(0, 30), (60, 90), (30, 60)], [(70, 90), (30, 70), (0, 30)]])
def test_blocks_of_a_run_may_come_in_any_order(blocks):
    """Other tasks' blocks of one run, in one batch and straddling batches."""
    rng = random.Random(len(blocks))
    rows = sorted((f"u{rng.randint(0, 9)}", "t", rng.randint(0, 5)) for _ in range(90))
    other = sorted((f"u{rng.randint(0, 9)}", "t", rng.randint(0, 5)) for _ in range(40))
    came = [(*rows[i], 0, i) for lo, hi in blocks for i in range(lo, hi)]
    came[25:25] = [(*x, 1, i) for i, x in enumerate(other)]
    for size in (7, 50, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(warc.KEY, r, strict=True)) for r in came[at : at + size]]) for at in range(0, len(came), size)]
        table, order = warc.merge_range(iter(batches))
        got = [tuple(r.values()) for r in table.take(pa.array(order)).to_pylist()]
        assert got == sorted(came)


def test_the_index_says_where_records_lie(spark, tmp_path):
    out = warc.archive_pages(spark.createDataFrame(page_rows(), PAGES), str(tmp_path / "w")).collect()
    assert len({(r.file, r.offset) for r in out}) == len(out)
    for r in out:
        data = gzip.open(r.file.removeprefix("file:").replace("///", "/")).read()[r.offset :]
        record = next(iter(warc.Archive().feed(data)))
        assert data.startswith(b"WARC/1.1") and record["warc-type"] == r.record_type and record["warc-payload-digest"].endswith(r.payload_digest)
        assert record["warc-record-id"].count(":page:") == (r.page_id is not None)


def test_archives_are_read_in_pieces():
    a = warc.Archive()
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nx\r\n\r\ny\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    data = record * 3
    for n in (1, 7, 1000):
        a, got = warc.Archive(), []
        for at in range(0, len(data), n):
            got += a.feed(data[at : at + n])
        a.end()
        assert [r["block"] for r in got] == [block] * 3 and [r["offset"] for r in got] == [0, len(record), 2 * len(record)]
    with pytest.raises(ValueError, match="within a record"):
        list(a.feed(data[:-20]))
        a.end()


PAGES = "page_id long, url string, html string, payload string, id string"


def page_rows():
    evil = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nboo\r\n\r\n"
    html = [None, "", "<p>é</p>", evil, evil + "x", "y" * 300_000, "<p>é</p>", "z"]
    urls = ["http://b.example.com/x?y#z", "HTTPS://user@A.example.COM:8080", None, "", "http://x/ \r\nEvil: 1", "not a url", "http://b.example.com/x?y", "http://b.example.com/a"]
    return [(i, u, h, "p", "q") for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(7, "http://b.example.com/a", "z", None, None), (None, "http://n/", "z", None, None)]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    out = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    assert Counter(r.page_id for r in out) == Counter(r[0] for r in rows)
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    html = {r[0]: r[2] or "" for r in rows}
    for r in out:
        raw = html[r.page_id].encode()
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        whose = first[html[r.page_id]]
        if r.page_id is None or r.page_id == whose:
            assert (r.record_type, r.refers_to) == ("response", None)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", whose)
    assert sorted(r.position for r in out) == list(range(len(rows)))
    order = [(r.urlkey, r.captured) for r in sorted(out, key=lambda r: r.position)]
    assert order == sorted(order)
    back = {r.id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    for i, _, h, *_ in rows:
        if i is not None and back[str(i)].record_type == "response":
            assert bytes(back[str(i)].payload) == (h or "").encode()
    for f in (tmp_path / "w").glob("*.gz"):
        data = gzip.open(f).read()
        assert not data or data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


ODD_URLS = ["\u00a0http://x.com/a", "http://x.com/a\x0b", "http://x.com/%20 b%", "http://é.fr/ü?q=😀", "tab\there", "", " ", None, "http://x.com/\x00\x7f"]


@pytest.mark.parametrize("kind", ["large", "text"])
def test_any_ids_times_and_urls(spark, tmp_path, kind):
    """Hashed 64-bit ids or texts as ids, times that are null, odd URLs: what
    is read back is what was written."""
    ids = [2**62, -(2**63), 2**63 - 1, -1, 0, 2**31, None, 7, 8] if kind == "large" else ["a>b", "<urn:x>", "é%20", "none", "\r\n", "", None, "x", "y"]
    times = ["2020-01-01T00:00:00Z", None] * 4 + [None]
    rows = list(zip(ids, ODD_URLS, [f"p{i}" for i in range(9)], times, strict=True))
    df = spark.createDataFrame(rows, f"page_id {'long' if kind == 'large' else 'string'}, url string, html string, seen string")
    for column in (None, "seen"):
        out = warc.archive_pages(df, str(tmp_path / f"{column}"), time_col=column).collect()
        assert Counter((r.page_id, r.url) for r in out) == Counter((r[0], r[1]) for r in rows)
        assert all(len(r.captured) == 20 for r in out)
        assert sorted(r.position for r in out) == list(range(9))
    stamp = df.withColumn("seen", F.to_timestamp("seen", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    seen = {r.url: r.captured for r in warc.archive_pages(stamp, str(tmp_path / "stamp"), time_col="seen").collect()}
    assert all(seen[u] == t for _, u, _, t in rows if t)


def test_large_ids_equal_the_sql(spark, tmp_path):
    rows = [(i, u, h) for i, u, h in zip([2**62, 2**62 + 1, -5, 2**31 + 3, 3, -(2**63)], ["http://a.b/", "http://a.b/", "http://a.b/", "http://a.b/", "http://a.b/", None], ["x", "x", "y", "é", "é", None], strict=True)]
    got = warc.archive_digest(spark.createDataFrame(rows, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(warc.WARC_SQL)
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(con.fetchall(), key=repr)


def test_url_keys(spark):
    df = spark.createDataFrame([("http://www.Example.com/A?b#c",), ("https://u:p@x.org:1",), (None,), ("odd",)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example,www)/A?b", "org,x)/", "", "odd"]


def test_no_pages(spark, tmp_path):
    assert warc.archive_pages(spark.createDataFrame([], PAGES), str(tmp_path / "w")).count() == 0
