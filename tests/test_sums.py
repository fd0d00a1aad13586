from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import source_queries as queries
from quern.functions import scoring


def test_exact_sums_do_not_depend_on_order(spark):
    rows = [("a", 0.1)] * 10 + [("b", 1e300), ("b", 1.0), ("c", float("inf")), ("d", None)]
    got = spark.createDataFrame(rows, "k string, v double").repartition(7).groupBy("k").agg(scoring.exact_sum(F.col("v")).alias("s"))
    assert {r.k: r.s for r in got.collect()} == {"a": 1.0, "b": 1e300, "c": float("inf"), "d": None}


def test_activity_lines_at_a_glyphs_bound(spark, tmp_path):
    """The middle hour has 5 of 70: half a glyph, rounded up; added one by one it is less."""
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [(1, at(0), 0.0), (1, at(2), 70.0)] + [(1, at(1), 0.1)] * 50
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert queries.QUERIES["activity_lines"](spark, str(tmp_path)).first().line == "▁▂█"


def test_activity_lines_without_a_time_and_of_tiny_values(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [(1, at(0), 1.0), (1, None, 5.0), (1, at(3), 9.0), (2, at(1), 1e-14), (2, at(2), 2e-14), (2, at(3), 3e-14)]
    place = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(place)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{place}/*.parquet'")
    want = con.execute(queries.SQL["activity_lines"]).fetchall()
    assert {tuple(r) for r in queries.QUERIES["activity_lines"](spark, str(tmp_path)).collect()} == set(want) == {(1, "▁█▅"), (2, "▁▅█")}


def test_suppliers_whose_numbers_reach_those_of_lines(spark, tmp_path):
    rows = [(s, n) for s in (5, 9999, 10001, 10002, 10003, 20000) for n in range(1, 5) for _ in range(1 + (s * n) % 3)]
    place = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int").coalesce(1).write.parquet(place)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{place}/*.parquet'")
    con.execute(queries.SQL["resistance_degeneracy"])
    assert queries.QUERIES["resistance_degeneracy"](spark, str(tmp_path)).first().correlation == pytest.approx(con.fetchall()[0][0], abs=1e-6)
