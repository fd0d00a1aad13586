"""Sensors over streams that stop and start again, and the file sources."""

import json
import os

import pytest

from quern.sources import notes, trees
from quern.streaming import jobs, sensors

SECRET = "AKIA" + "A" * 16


def said(*texts):
    rows = [{"type": "user", "message": {"role": "user", "content": t}} for t in texts]
    return "\n".join(json.dumps(r) for r in rows)


def test_sensor_accounts_for_every_arrival_and_restarts(spark, tmp_path):
    place, check, out = tmp_path / "in", str(tmp_path / "cp"), str(tmp_path / "out")
    place.mkdir()
    n = 0

    def land(rows, minute):
        nonlocal n
        n += 1
        lines = [json.dumps({"session_id": s, "text": t, "ts": f"2026-01-01T0{minute // 60}:{minute % 60:02}:00Z"}) for s, t in rows]
        (place / f"{n}.tmp").write_text("\n".join(lines))
        os.rename(place / f"{n}.tmp", place / f"{n}.json")

    def run():
        stream = spark.readStream.schema("session_id string, text string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(place))
        jobs.running(sensors.sense(sensors.transcript_facts(stream), lease_seconds=3600, late="0 seconds", active="now"), sensors.batch_accounts(out), check).awaitTermination()

    land([("a", said("one", "two")), ("b", said("x " + SECRET)), ("c", "{torn"), ("d", json.dumps({"type": "system"})), ("now", said("open"))], 0)
    run()
    first = spark.read.parquet(out).where("arrived > 0").collect()
    assert len(first) == 1 and first[0].accounted
    assert {b: first[0][b] for b in sensors.BUCKETS} == {"added": 1, "refused": 1, "unparseable": 1, "empty": 1, "active": 1, "unchanged": 0, "grown": 0}
    # after a restart: the same again, grown, refused with what was taken kept, and a new one
    land([("a", said("one", "two")), ("c", "{torn")], 10)
    land([("a", said("one", "two", "three")), ("b", said("clean"))], 20)
    land([("a", said("one", "two", "three", SECRET))], 30)
    run()
    rows = sorted(spark.read.parquet(out).where("arrived > 0").collect(), key=lambda r: r.batch)
    assert [r.accounted for r in rows] == [True] * 4
    assert [(r.unchanged, r.grown, r.added, r.refused, r.utterances_added) for r in rows] == [(0, 0, 1, 1, 2), (2, 0, 0, 0, 0), (0, 1, 1, 0, 2), (0, 0, 0, 1, 0)]
    # two hours on, the leases of all that fell silent have run out, once each
    land([("e", said("late"))], 180)
    land([("e", said("late"))], 181)
    run()
    assert spark.read.parquet(out).agg({"lapsed": "sum"}).first()[0] == 4  # a, b, c, d
    before = spark.read.parquet(out).agg({"lapsed": "sum", "arrived": "sum"}).first()
    run()  # nothing new: nothing counted again
    assert spark.read.parquet(out).agg({"lapsed": "sum", "arrived": "sum"}).first() == before


def test_sources_choose_files_before_they_open_them(spark, tmp_path):
    root = tmp_path / "vault"
    for i in range(12):
        (root / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 3}" / f"n{i}.md").write_text(f"note {i}")
    (root / "assets").mkdir()
    (root / "assets" / "x.md").write_text("no note")
    trees.register(spark)
    df = spark.read.format("quern_notes").option("path", str(root)).option("partitionBytes", 20).load()
    assert {(r.path, bytes(r.data)) for r in df.collect()} == {(f"d{i % 3}/n{i}.md", f"note {i}".encode()) for i in range(12)}
    assert df.rdd.getNumPartitions() == 4 or df.rdd.getNumPartitions() > 1
    one = df.where("path LIKE 'd1/%'")
    assert one.count() == 4 and one.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert df.where("path = 'd0/n3.md'").rdd.getNumPartitions() == 1 and df.where("path IN ('d0/n3.md', 'zz')").select("size").collect()[0].size == 6
    assert notes.notes(df).where("title = 'd2/n5'").count() == 1
    assert spark.read.format("quern_notes").option("path", str(tmp_path / "none")).load().count() == 0


def test_transcripts_commits_and_edges(spark, tmp_path):
    trees.register(spark)
    (tmp_path / "s1.jsonl").write_text(said("one", "two") + "\n\n{torn")
    (tmp_path / "s2.jsonl").write_text(said("three"))
    lines = spark.read.format("quern_transcripts").option("path", str(tmp_path)).load()
    blocks = notes.transcript_blocks(lines)
    assert sorted((r.session_id, r.turn_index, r.text) for r in notes.utterances(blocks).collect()) == [("s1", 0, "one"), ("s1", 1, "two"), ("s2", 0, "three")]
    assert blocks.where("kind = 'torn'").count() == 1
    assert lines.where("session_id = 's2'").count() == 1
    a, b = "a" * 40, "b" * 40
    (tmp_path / "x.log").write_text(f"{a}\n\n:100644 100644 {b} {a} M\tp q.md\n:000000 100644 {'0' * 40} {b} A\tn.md\n{b}\n:100644 100644 {b} {a} M\tp q.md\n")
    commits = spark.read.format("quern_commits").option("path", str(tmp_path)).load()
    assert sorted(tuple(r)[1:] for r in commits.collect()) == sorted([(a, "p q.md", b, a), (a, "n.md", None, b), (b, "p q.md", b, a)], key=str)
    assert sorted(map(tuple, trees.work_list(commits).collect())) == [("n.md", b, a), ("p q.md", a, a)]
    (tmp_path / "c.edges.jsonl").write_text(json.dumps({"session_id": "s", "event_order": 1, "edge_id": "e", "dst": "d", "dst_type": "doc"}))
    edges = spark.read.format("quern_causal_edges").option("path", str(tmp_path)).load()
    assert [tuple(r) for r in edges.collect()] == [("c.edges.jsonl", "s", 1, "e", "d", "doc", None)]


def test_notes_as_a_stream(spark, tmp_path):
    trees.register(spark)
    root, out = tmp_path / "v", str(tmp_path / "out")
    root.mkdir()
    (root / "a.md").write_text("a")

    def run():
        df = spark.readStream.format("quern_notes").option("path", str(root)).load()
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, bytes(r.data)) for r in spark.read.parquet(out).collect())

    assert run() == [("a.md", b"a")]
    assert run() == [("a.md", b"a")]
    (root / "b.md").write_text("b")
    assert run() == [("a.md", b"a"), ("b.md", b"b")]


@pytest.mark.parametrize("budget", [30, 60, 100, 140, 200, 400])
def test_prompt_budget_drops_in_order(spark, budget):
    from quern.operators import metrics

    parts = {"frame": [5, 6], "retrieved": [20, 10, 30], "history": [15, 25, 8], "tool": [40, 12, 30]}
    rows = [("r", k, i, t) for k, ts in parts.items() for i, t in enumerate(ts)]
    kept = {k: list(enumerate(ts)) for k, ts in parts.items()}
    total = lambda: sum(t + 4 for ts in kept.values() for _, t in ts)
    while total() > budget and kept["retrieved"]:
        kept["retrieved"].pop()
    while total() > budget and kept["history"]:
        kept["history"].pop(0)
    while total() > budget and kept["tool"]:
        i, t = kept["tool"].pop()
        room = budget - total() - 4
        if room > 0:
            kept["tool"].append((i, min(t, room)))
    want = {(k, i): t for k, ts in kept.items() for i, t in ts}
    got = metrics.prompt_budget(spark.createDataFrame(rows, "request string, kind string, rank int, tokens int"), budget).collect()
    assert {(r.kind, r.rank): r.kept_tokens for r in got if r.kept_tokens is not None} == want
    assert {r.escalate for r in got} == {19 > budget}
