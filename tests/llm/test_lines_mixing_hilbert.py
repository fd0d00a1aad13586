import bisect
import time
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import hilbert, lines, mixing
from quern.llm.common import running_totals, words_count

from .cases import frame

SPACES = " \t\n\x0b\x0c\r"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_line_dedup_matches_brute_force(spark):
    docs = frame(spark)
    rows = docs.collect()
    seen = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if key := fold(line.strip(SPACES)):
                seen[key].add(r.doc_id)
    for least in (2, 10):
        shared = {k for k, v in seen.items() if len(v) >= least}
        want = Counter()
        for r in rows:
            own = (r.text or "").split("\n")
            kept = [x for x in own if fold(x.strip(SPACES)) not in shared]
            want[r.doc_id, len(own), len(own) - len(kept), "\n".join(kept)] += 1
        out = lines.drop_shared_lines(docs, min_docs=least)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
        assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.drop_shared_lines(frame(spark, [])).count() == 0


def test_a_text_of_many_lines_is_linear(spark):
    """A third of 300,000 lines goes: minutes, were it quadratic."""
    n = 300_000
    text = "\n".join("shared" if i % 3 == 0 else f"line {i}" for i in range(n))
    docs = frame(spark, [(0, text, *[None] * 6), *[(i, "shared\nx" + str(i), *[None] * 6) for i in range(1, 12)]])
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.drop_shared_lines(docs).collect()}
    assert time.perf_counter() - began < 60
    assert (got[0].n_lines, got[0].n_dropped) == (n, n // 3)
    assert got[0].text == "\n".join(f"line {i}" for i in range(n) if i % 3) and got[5].text == "x5"


def test_running_totals_cross_ranges_and_groups(spark):
    rows = [(g, i, (i * 7) % 5) for g in (None, "a", "b") for i in range(200 if g == "a" else 3)]
    out = running_totals(spark.createDataFrame(rows, "g string, i int, v long"), "v", ["i"], ["g"]).collect()
    sums = Counter()
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        got = next(r for r in out if (r.g, r.i) == (g, i))
        assert got.before == sums[g]
        sums[g] += v
        assert got.upto == sums[g]


def waterfill(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 10, "c": 40, None: 50}, {"a": 1, "b": 1000}, {"x": 7}, {"a": 5, "b": 0, "c": 500, "d": 9}])
def test_targets_are_the_waterfilling(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    for s, t in waterfill(sizes).items():
        assert got[s] == pytest.approx(t)


def test_mix_takes_what_the_targets_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixing.mix_digest(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = Counter(), {}, 0
    for r in out:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest = max(largest, r.size)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * largest
    assert sum(taken.values()) <= sum(r.size for r in out)
    assert sorted(out) == sorted(mixing.mix_digest(docs.repartition(7)).collect())


def test_mix_stands_awkward_rows(spark):
    docs = frame(spark)
    out = mixing.mix_sources(docs, words_count(F.col("text")))
    assert out.count() == docs.count()
    assert all(r.taken == 0 for r in out.collect() if r.size == 0)
    assert mixing.mix_sources(frame(spark, []), words_count(F.col("text"))).count() == 0


def test_hilbert_curve_is_a_bijection_with_unit_steps(spark):
    for n, bits in ((2, 3), (3, 2), (3, 1)):
        names = [f"x{i}" for i in range(n)]
        df = spark.range(1 << bits)
        grid = df.select(F.col("id").alias("x0"))
        for c in names[1:]:
            grid = grid.crossJoin(df.select(F.col("id").alias(c)))
        got = sorted(tuple(r) for r in hilbert.hilbert_index(grid, names, bits).select("curve", *names).collect())
        assert [g[0] for g in got] == list(range(1 << (bits * n)))
        for a, b in zip(got, got[1:], strict=False):
            assert sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1


def test_shards_match_brute_force(spark, sf_dir):
    """Levels, order, shards and slots from their definitions; the curve's own
    index from the query, as its orientation is free (the bijection with unit
    steps is tested above), where it is a Hilbert curve of the same cells."""
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = docs.select("doc_id", "text", "lang", "source").collect()
        raw = [(r.text or "").encode() for r in rows]
        columns = [[(x is not None, x or "") for x in c] for c in ([r.lang for r in rows], [r.source for r in rows])]
        columns.append([len(t) + 8 for t in raw])
        level = []
        for c in columns:
            before = sorted(c)
            level.append([bisect.bisect_left(before, x) * 32 // len(rows) for x in c])
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        got = hilbert.shard_digest(docs).collect()
        curve = {(r.dim_0, r.dim_1, r.dim_2): r.curve for r in got}
        assert len(set(curve.values())) == len(curve)
        order = sorted(
            (curve[dims], signed(xxhash.xxh64_intdigest(t, 42)), (r.doc_id is not None, r.doc_id or 0), len(t) + 8, zlib.crc32(t), dims)
            for r, t, dims in zip(rows, raw, zip(*level, strict=True), strict=True)
        )
        want, total, slot = [], len(rows), Counter()
        for at, (c, _, (known, doc), size, crc, dims) in enumerate(order):
            shard = at * 24 // total
            want.append((doc if known else None, size, crc, shard, slot[shard], c, *dims))
            slot[shard] += 1
        have = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.curve, r.dim_0, r.dim_1, r.dim_2) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)


def test_size_prunes_among_large_texts(spark):
    rows = [(i, "x" * (60_000 + 1000 * i), *[None] * 6) for i in range(64)]
    out = hilbert.hilbert_shards(frame(spark, rows)).collect()
    assert len({r.dim_2 for r in out}) == 32


def test_shards_are_even_gapless_and_ordered(spark):
    docs = frame(spark)
    rows = docs.collect()
    for n in (24, 5):
        out = hilbert.hilbert_shards(docs, n).collect()
        assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 8) for r in rows)
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r)
        counts = [len(by[s]) for s in range(n)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
        for s, own in by.items():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        flat = [r.curve for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
        assert flat == sorted(flat)
    assert hilbert.hilbert_shards(frame(spark, [])).count() == 0


def test_shard_files_hold_narrow_ranges(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hilbert.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    spread = back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < docs.select("lang").distinct().count()
