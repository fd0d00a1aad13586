from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import crf, mixing, queries
from quern.llm.common import words_count
from quern.scratch import write_table

from .cases import awkward, frame
from .test_minhash_sketches_pivots_warc import near_brute

SF = "/root/testdata/sf0.001"


def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = tables()
    con.execute(queries.SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(tuple(map(tidy, r)) for r in con.fetchall())
    assert sorted(tuple(map(tidy, r)) for r in got.select(*names).collect()) == want


def test_every_operator_is_registered():
    found = {q.split("_")[0] for q in queries.QUERIES}
    assert found == {f"op{n}" for n in range(1, 14)}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, write_table(stage(spark, docs, SF), "test")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == start.columns
        if name == "quality classifier":
            field = crf.learned_from(start, labels, F.lit(False))
            good = crf.score_quality(start, field).where("score >= 0.7").select("doc_id").collect()
            assert sorted(good) == sorted(docs.select("doc_id").collect())
        if name == "line dedup":
            assert docs.count() == before.count()
        if name == "near-dedup":
            u = near_brute([(r.doc_id, r.text) for r in before.collect()], 80)
            rows = before.collect()
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in rows if u.root(r.doc_id) == r.doc_id}
    run = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "start", "length", "doc_tokens"]
    assert sorted(run.select(*cols).collect()) and run.count() >= kept["mixing"].count()
    tokens = kept["packing"].agg(F.sum("length")).first()[0]
    assert run.agg(F.sum("length")).first()[0] == tokens


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory, spark):
    """labels of awkward rows, and none."""
    root = tmp_path_factory.mktemp("sf")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(root / "some/labels.parquet"))
    labels.limit(0).write.parquet(str(root / "none/labels.parquet"))
    return root


@pytest.mark.parametrize(
    ("name", "which"),
    [(n, w) for n, _ in corpus_pipeline.STAGES for w in ("awkward", "empty")]
    + [("quality classifier", "no labels"), ("near-dedup", "all null"), ("mixing", "all null"), ("line dedup", "all null")],
)
def test_stages_stand_awkward_tables(spark, odd_dir, name, which):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    columns with clashing names, empty tables."""
    rows = {"empty": [], "all null": [(None,) * 8] * 3}.get(which, awkward())
    docs = frame(spark, rows).withColumns({"__q_id": F.lit(1), "set": F.lit("x"), "taken": F.lit(2), "mark": F.lit(0)})
    out = stage(name)(spark, docs, str(odd_dir / ("none" if which == "no labels" else "some")))
    got = out.collect()
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    if which == "empty":
        assert not got
    elif name in ("line dedup", "packing"):
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    elif name == "quality classifier" and which == "no labels":
        assert len(got) == len(rows)


def test_stages_go_by_row(spark, odd_dir):
    """Unlike texts under one id, copies under one id and without an id."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, a), (5, b), (None, b), (None, a), (7, "c d"), (7, "c d"), (None, "e f g"), (None, "e f g"), (9, "  "), (9, "  ")]
    docs = frame(spark, [(i, t, "en", "s", None, None, None, None) for i, t in rows])
    kept = stage("near-dedup")(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (5, b), (7, "c d"), (None, "e f g"), (9, "  "), (9, "  ")])
    sizes = [(5, "w " * 40, "s"), (5, "v " * 10, "t"), (5, "u " * 10, "t"), (None, "x " * 10, None), (None, "x " * 10, None)]
    docs = frame(spark, [(i, t, "en", s, None, None, None, None) for i, t, s in sizes])
    slim = docs.select("doc_id", "source", words_count(F.col("text")).alias("n"), "text")
    taken = Counter()
    for r in mixing.mix_sources(slim.withColumn("mark", F.xxhash64("text")).drop("text"), F.col("n"), order_cols=("mark",)).collect():
        taken[r.doc_id, r.source, r.mark] += r.taken // r.size
    got = Counter((r.doc_id, r.source, r.m) for r in stage("mixing")(spark, docs, "").select("doc_id", "source", F.xxhash64("text").alias("m")).collect())
    assert got == Counter({k: v for k, v in taken.items() if v})
