"""Nearest-neighbour retrieval with provenance filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.ranks import global_rank
from ..scratch import partitions, write_table
from ..functions.vectors import cosine, doubles, literal

#: Queries and rows of one group of a search, and of one matrix of distances within.
QUERIES, ROWS, TILE = 4_096, 16_384, 256


def nearest(chunks: DataFrame, query: list[float], k: int = 5, provenances: tuple[str, ...] | None = None, superseded: bool = False, vec: str = "vector", key: str = "id") -> DataFrame:
    """The k rows nearest to the query by cosine distance, ties by key. The
    filters run before the top k, which keeps k rows a task and sorts none."""
    rows = chunks
    if provenances is not None:
        rows = rows.where(F.col("provenance").isin(*provenances)) if provenances else rows.where(F.lit(False))
    if not superseded and "current" in rows.columns:
        rows = rows.where("current")
    if not rows.where(F.size(vec) != len(query)).isEmpty():
        raise ValueError(f"the query has {len(query)} parts; some vector has not")
    distance = 1.0 - cosine(doubles(F.col(vec)), literal(query))
    return rows.withColumn("distance", distance).orderBy("distance", key).limit(k)


def grouped(hits: DataFrame, group: str = "digest", member: str = "id") -> DataFrame:
    """Hits by source: members by distance, best distance; a source of more
    than one provenance is refused."""
    out = hits.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("distance", member))), lambda s: s[member]).alias("members"),
        F.min("distance").alias("best_distance"),
        *([F.countDistinct("provenance").alias("__p")] if "provenance" in hits.columns else []),
    )
    if "provenance" in hits.columns:
        fine = F.when(F.col("__p") <= 1, F.col("best_distance")).otherwise(F.raise_error(F.lit("a source mixes provenances")).cast("double"))
        out = out.withColumn("best_distance", fine).drop("__p")
    return out


def best_per_path(hits: DataFrame, path: str = "source_path", layers: tuple[str, ...] | None = None) -> DataFrame:
    """One row per path at its best distance, ranked."""
    if layers is not None:
        hits = hits.where(F.col("layer").isin(*layers))
    best = hits.groupBy(path).agg(F.min("distance").alias("distance"))
    return global_rank(best, ["distance", path], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def rank_papers(papers: DataFrame, centroid: list[float], vec: str = "vector") -> DataFrame:
    """Papers by relevance to the centroid plus the weight of their evidence."""
    tier = scoring.evidence_tier(F.col("type"), F.col("is_preprint"))
    relevance = cosine(doubles(F.col(vec)), literal(centroid))
    flags = F.filter(
        F.array(
            F.when(F.col("tier") == "preprint", "preprint-not-vetted"),
            F.when((F.coalesce("doi", F.lit("")) == "") & (F.coalesce("url", F.lit("")) == ""), "unresolved-identifier"),
            F.when(F.trim(F.coalesce("abstract", F.lit(""))) == "", "no-abstract"),
        ),
        lambda x: x.isNotNull(),
    )
    out = papers.withColumns({"tier": tier, "relevance": relevance})
    out = out.withColumns({"score": F.col("relevance") + scoring.evidence_weight(F.col("tier")), "flags": flags})
    return out.orderBy(F.desc("score"), "source", "id")


def best_papers(papers: DataFrame, most: int) -> DataFrame:
    """Papers once each, by doi or else normalised title, the best evidence
    first (then the first to arrive); those without identifier go."""
    title = F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", " "))
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.lower("doi")).otherwise(title)
    tier = scoring.evidence_tier(F.col("type"), F.col("is_preprint"))
    rank = F.when(tier == "high", 0).when(tier == "primary", 1).when(tier == "other", 2).otherwise(3)
    rows = papers.where((F.coalesce("doi", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))
    rows = rows.withColumns({"__key": key, "evidence_rank": rank})
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("evidence_rank", "arrival"))).where("__n = 1")
    return one.drop("__key", "__n").orderBy("evidence_rank", "arrival").limit(most)



def _numbers(t: pa.Table) -> np.ndarray:
    """Vectors at length 1, a column for each row; zero ones stay, null ones
    are not a number. Sums run part by part, so equal vectors give equal bits
    wherever they stand."""
    v = t["v"].combine_chunks()
    known = np.asarray(v.is_valid())
    width = v.value_lengths().drop_null()
    if len(width.unique()) > 1:
        raise ValueError("vectors differ in length")
    x = np.full((t.num_rows, width[0].as_py() if len(width) else 0), np.nan)
    x[known] = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
    x = np.ascontiguousarray(x.T)
    size = np.zeros(t.num_rows)
    for part in x:
        size += part * part
    size = np.sqrt(size)
    x /= np.where(size == 0, 1.0, size)
    return x if len(x) else np.full((1, t.num_rows), np.nan)


def _distances(q: pa.Table, r: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """(queries, their distances to all rows), some queries at a time; what
    has no distance is infinitely far."""
    x, y = _numbers(q), _numbers(r)
    if len(x) != len(y) and not (np.isnan(x).all() or np.isnan(y).all()):
        raise ValueError("vectors differ in length")
    for lo in range(0, q.num_rows, TILE):
        out = np.empty((min(TILE, q.num_rows - lo), r.num_rows))
        for at in range(0, r.num_rows, 2 * TILE):
            sums = out[:, at : at + 2 * TILE]
            sums[:] = 0.0
            for a, b in zip(x[:, lo : lo + TILE], y[:, at : at + 2 * TILE], strict=False):
                sums += a[:, None] * b[None]
        d = 1.0 - out
        d[np.isnan(d)] = np.inf
        yield slice(lo, lo + TILE), d


def _met(queries: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(queries, rows) for every group of queries and slice of rows, these
    by their ids. A row is sent once for QUERIES queries and a query once for
    ROWS rows; no pair is sent or written."""
    groups = max(1, -(-queries.count() // QUERIES))
    slices = max(partitions(rows.sparkSession), -(-rows.count() // ROWS))
    series = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).withColumn("s", series(slices))
    r = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("g", series(groups))
    return q.groupBy("g", "s").cogroup(r.groupBy("g", "s")).applyInArrow(lambda a, b: run(a, b.sort_by("id")), schema)


def kin_ranks(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(q, hits, rank) for every q of the queries (q, label, v) that meets a
    row (id, label, v) of another id: how many of its k nearest rows, by cosine
    distance and then id, have its label, and the place of the first such row
    among all rows, null where there is none. Ids are whole numbers. Null
    vectors are the farthest, null labels nobody's.

    A group of queries and a slice of the rows meet in one task, which keeps k
    rows and the nearest of its label for each query. Only for queries without
    a hit rows are compared again, to count those up to the first of its label."""
    queries, rows = queries.where("q IS NOT NULL"), rows.where("id IS NOT NULL")

    def own(q: pa.Table, r: pa.Table, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = q["q"].to_numpy()[part], r["id"].to_numpy()
        names = pa.concat_arrays([*q["label"].chunks, *r["label"].chunks]).dictionary_encode().indices.fill_null(-1).to_numpy()
        la, lb = names[: q.num_rows][part], names[q.num_rows :]
        return a, a[:, None] == b[None], (la[:, None] == lb[None]) & (la >= 0)[:, None]

    def near(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, found = r["id"].to_numpy(), []
        for part, d in _distances(q, r) if q.num_rows and r.num_rows else ():
            a, same, kin = own(q, r, part)
            d[same] = np.inf
            kin &= ~same
            far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, [min(k, d.shape[1]) - 1]]
            i, j = np.nonzero((d <= far) & ~same)
            by = np.lexsort((j, d[i, j], i))  # rows stand by id
            i, j = i[by], j[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            first = np.argmin(np.where(kin, d, np.inf), axis=1)
            at = np.arange(len(a))
            first = np.where(kin[at, first], first, kin.argmax(axis=1))
            i, j = np.concatenate([i[keep], at[kin.any(axis=1)]]), np.concatenate([j[keep], first[kin.any(axis=1)]])
            i, j = np.unique(np.stack([i, j]), axis=1) if len(i) else (i, j)
            found.append(pa.table({"q": a[i], "d": d[i, j], "id": ids[j], "kin": kin[i, j]}))
        return pa.concat_tables([none.slice(0, 0), *found])

    none = pa.table({"q": np.zeros(0, np.int64), "d": np.zeros(0), "id": np.zeros(0, np.int64), "kin": np.zeros(0, bool)})
    kept = write_table(_met(queries, rows, near, "q long, d double, id long, kin boolean"), "nearest")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    top = kept.withColumn("place", place).where(F.col("place") <= k).groupBy("q").agg(F.count_if("kin").alias("hits"), F.min(F.when(F.col("kin"), F.col("place"))).alias("place"))
    top = write_table(top, "hits")
    late = kept.where("kin").withColumn("place", place).where("place = 1").join(top.where("hits = 0"), "q", "left_semi").select("q", F.col("d").alias("bound"), F.col("id").alias("last"))

    def upto(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, found = r["id"].to_numpy(), [pa.table({"q": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})]
        bound, last = (q[c].to_numpy()[:, None] for c in ("bound", "last"))
        for part, d in _distances(q, r) if q.num_rows and r.num_rows else ():
            a, same, _ = own(q, r, part)
            less = (d < bound[part]) | ((d == bound[part]) & (ids[None] <= last[part]))
            found.append(pa.table({"q": a, "n": (less & ~same).sum(axis=1)}))
        return pa.concat_tables(found)

    again = write_table(queries.join(late, "q"), "late")
    counted = _met(again, rows, upto, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    return top.join(counted, "q", "left").select("q", "hits", F.coalesce("place", "n").cast("long").alias("rank"))
