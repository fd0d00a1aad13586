"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..scratch import write_table

#: Vectors are described by the NEAREST pivots, in order; two that share
#: fewer than SHARED of them are no candidates.
NEAREST, SHARED = 8, 3
MIN_PIVOTS, MAX_PIVOTS = 64, 16_384
#: Products of vectors and pivots that a task has at a time.
PRODUCTS = 4_000_000
#: Rows of one inverted list that a task compares at a time.
BLOCK = 1024
#: Lists are split by the next shared pivots, so many in a key at most.
DEPTH = 3


def pivot_count(n: int) -> int:
    """About the square root of the number of vectors: lists then grow as
    that root too. MAX_PIVOTS bounds what is broadcast; lists that are long
    all the same are split by second and third pivots."""
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(math.sqrt(max(0, n))))))


def packed(col: pa.Array, kind: str) -> pa.Array:
    """Vectors as bytes of their parts; null for those that are null, zero,
    or hold null or non-finite parts."""
    at = np.asarray(col.offsets).astype(np.int64)
    v = col.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # one zero
    odd, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(v), v != 0))
    ok = col.is_valid().to_numpy(zero_copy_only=False) & (odd[at[1:]] == odd[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    return pa.array([v[a:b].tobytes() if good else None for a, b, good in zip(at[:-1], at[1:], ok, strict=True)], pa.binary())


def matrix(col: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Packed vectors of one length, as rows."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; first by their largest
    part, so that neither tiny nor huge components are lost in the squares."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def describe(vectors: np.ndarray, pivots: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """Numbers of each vector's k nearest pivots by angle, nearest first; some
    rows at a time, so that a batch of any size takes the same memory."""
    k = min(k, len(pivots))
    out = np.empty((len(vectors), k), np.int64)
    rows = max(1, PRODUCTS // max(1, len(pivots)))
    for lo in range(0, len(vectors), rows):
        close = unit(vectors[lo : lo + rows]) @ pivots.T
        top = np.argpartition(-close, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
        out[lo : lo + rows] = np.take_along_axis(top, order, 1)
    return out


def candidates(a: np.ndarray, b: np.ndarray, key: int, last: int, shared: int) -> np.ndarray:
    """Which rows of a and b share `shared` pivots at least and have this list
    as theirs: of the pivots that they share, `key` are not after `last`, so
    the list's own are the first. Every pair has one such list."""
    marks, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1, a.shape[1])
    one = np.zeros((len(at), len(marks)), np.float32)
    np.put_along_axis(one, at, 1.0, axis=1)
    early = int(np.searchsorted(marks, last, side="right"))
    before = one[: len(a), :early] @ one[len(a) :, :early].T
    return (before == key) & (before + one[: len(a), early:] @ one[len(a) :, early:].T >= shared)


def similar(va: np.ndarray, vb: np.ndarray, floor: float) -> np.ndarray:
    """Which rows have a cosine of `floor` or more; those on the edge are
    summed again one by one, so that the block they met in plays no part."""
    close = va @ vb.T
    i, j = np.nonzero(np.abs(close - floor) < 1e-9)
    close[i, j] = (va[i] * vb[j]).sum(axis=1)
    return close >= floor


def compare_lists(a: pa.Table, b: pa.Table | None, kind: str, key: int, last: int, shared: int, floor: float) -> pa.Table:
    """Links between two blocks of one inverted list, or within one:
    (id, links, root) for every row that has a link."""
    both = [a] if b is None else [a, b]
    marks = [np.asarray(t["marks"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in both]
    vectors = [unit(matrix(t["vec"], kind)) for t in both]
    ok = candidates(marks[0], marks[-1], key, last, shared) & similar(vectors[0], vectors[-1], floor)
    if b is None:
        ok &= np.tri(a.num_rows, k=-1, dtype=bool)
    x, y = np.nonzero(ok)
    if b is not None:
        y = y + a.num_rows
    table = pa.concat_tables(both)
    copies = np.asarray(table["copies"].combine_chunks())
    n = table.num_rows
    links = np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
    ids = table["id"].combine_chunks()
    order = np.asarray(pc.sort_indices(ids))
    root = np.empty(n, np.int64)  # the least place by id that is reached
    root[order] = np.arange(n)
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        if (new == root).all():
            break
        root = new
    full = np.flatnonzero(links)
    return pa.table({"id": ids.take(full), "links": pa.array(links[full].astype(np.int64)), "root": ids.take(order[root[full]])})


def vector_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    floor: float = 0.98,
    nearest: int = NEAREST,
    shared: int = SHARED,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors under a label are one class. Of the classes of each length a
    bounded sample (pivot_count, by hash) are the pivots; every class is
    described by its `nearest` ones and posted in the inverted lists of all
    but the shared - 1 commonest of them, which two vectors that share
    `shared` pivots cannot both miss. A long list is split by the second
    shared pivot, then by the third, where that lowers the number of rows to
    send (measured on counts). What is still longer than BLOCK is cut into
    blocks, and every pair of blocks is one small group, so a list of any
    length is compared whole, over many tasks. A group returns each row's
    links counted and one root, never pairs. Cosines are in double precision,
    from `floor` on a link; pairs with equal vectors have cosine 1 and are
    counted without comparing. Vectors travel as bytes, of 4 a part where the
    column holds floats.

    Vectors that are null, zero, or hold null or non-finite parts, and rows
    without a label or id, link with nothing. Vectors of different lengths
    do not link; each length has lists of its own. Rows that repeat an id count as rows
    of their own. Without label_col all rows are comparable. Other columns
    are left out; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(0)
    vec, kind = F.col(vec_col), "<f4"
    if not isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType):
        vec, kind = vec.cast("array<double>"), "<f8"

    @F.arrow_udf("binary")
    def pack(col: pa.Array) -> pa.Array:
        return packed(col, kind)

    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), pack(vec).alias("vec"))
    good = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    key = F.when(good, F.unhex(F.md5(F.concat(F.to_json(F.struct("label")).cast("binary"), F.lit("|").cast("binary"), F.col("vec")))))
    rows = write_table(rows.withColumn("key", key), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    classes = write_table(classes.withColumn("width", (F.octet_length("vec") / int(kind[-1])).cast("int")), "classes")
    widths = {r["width"]: r["count"] for r in classes.groupBy("width").count().where("count > 1").collect()}
    found = component = None
    if widths:
        pivots = spark.sparkContext.broadcast(_pivots(classes, widths, kind))
        found, component = _search(classes.where(F.col("width").isin(list(widths))), pivots, kind, floor, nearest, shared)
    out = rows.select("id", "key").join(classes.select("key", F.col("id").alias("rep"), "copies"), "key", "left")
    if found is not None:
        out = out.join(found.select(F.col("id").alias("rep"), "links"), "rep", "left")
        out = out.join(component.select(F.col("id").alias("rep"), "component"), "rep", "left")
    else:
        out = out.withColumn("links", F.lit(0)).withColumn("component", F.lit(None))
    cid = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        cid.cast(rows.schema["id"].dataType).alias("component_id"),
        F.coalesce(F.col("id") == cid, F.lit(True)).alias("kept"),
    )


def _pivots(classes: DataFrame, widths: dict[int, int], kind: str) -> dict[int, np.ndarray]:
    """Pivots of every length: the classes with the least hashes, ranked
    among about twice as many as are wanted."""
    spark = classes.sparkSession
    wanted = spark.createDataFrame([(w, pivot_count(n), 2.0 * pivot_count(n) / n) for w, n in widths.items()], "width int, wanted int, share double")
    place = F.row_number().over(Window.partitionBy("width").orderBy("h", "key"))
    sample = classes.select("width", "key", "vec", F.xxhash64("key").alias("h")).join(F.broadcast(wanted), "width")
    sample = sample.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share")).withColumn("place", place).where("place <= wanted")
    found: dict[int, list] = {}
    for r in sample.select("width", "place", "vec").orderBy("width", "place").collect():
        found.setdefault(r["width"], []).append(bytes(r["vec"]))
    return {w: unit(np.frombuffer(b"".join(v), kind).reshape(len(v), -1)) for w, v in found.items()}


def _split(open_: DataFrame, depth: int, block: int) -> DataFrame | None:
    """The lists of open_ that are better split by one more pivot, by their
    keys: those longer than a block whose parts, in blocks of their own, send
    fewer rows. Only counts are compared. None if there is no long list."""
    keys = ["label", "width", *[f"k{d}" for d in range(1, depth + 1)]]
    rows = lambda: F.col("n") * F.ceil(F.col("n") / block)
    sizes = open_.where("both > " + str(depth)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    long = write_table(sizes.select(*keys, rows().alias("whole")), "long-lists")
    if long.isEmpty():
        return None
    parts = _deeper(open_.join(long, keys), depth + 1).groupBy(*keys, f"k{depth + 1}").agg(F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole"))
    parts = parts.groupBy(*keys).agg(F.sum(rows()).alias("sent"), F.first("whole").alias("whole"))
    return write_table(parts.where("sent < whole").select(*keys, F.lit(True).alias("split")), "split-lists")


def _deeper(rows: DataFrame, depth: int) -> DataFrame:
    """Each row once for each of its pivots that can be the next one shared:
    the one of number `depth` leaves enough after it for `both` in all."""
    rows = rows.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.size("marks") - F.col("both") + (depth - 1))))
    return rows.withColumn(f"k{depth}", F.element_at("marks", F.col("at") + 1))


def _search(same: DataFrame, pivots, kind: str, floor: float, nearest: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (id, component) of classes with a link; pivots are
    broadcast by length."""
    size, block = int(kind[-1]), BLOCK

    def by_width(col: pa.Array, width: np.ndarray, f) -> pa.Array:
        out = np.empty(len(col), object)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            for i, row in zip(at, f(col.take(pa.array(at)), int(w)), strict=True):
                out[i] = row.astype(np.int32)
        return pa.array(out, pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def nearest_pivots(vec: pa.Array) -> pa.Array:
        width = np.fromiter((len(v.as_buffer()) // size for v in vec), np.int64, len(vec))
        return by_width(vec, width, lambda v, w: describe(matrix(v, kind), pivots.value[w], nearest))

    told = write_table(same.select("id", "copies", "label", "width", "vec", nearest_pivots("vec").alias("pivots")), "told")
    usage = told.select("width", F.explode("pivots").alias("p")).groupBy("width", "p").agg(F.count(F.lit(1)).alias("n"))
    # Pivots are renumbered by the length of their lists, rare ones first.
    order = {w: np.full(len(v), -1, np.int32) for w, v in pivots.value.items()}
    for i, r in enumerate(usage.orderBy("n", "p").collect()):  # one row per pivot
        order[r["width"]][r["p"]] = i
    ranks = same.sparkSession.sparkContext.broadcast(order)

    @F.arrow_udf("array<int>")
    def ranked(p: pa.Array, width: pa.Array) -> pa.Array:
        each = lambda q, w: np.sort(ranks.value[w][np.asarray(q.flatten()).reshape(len(q), -1)], axis=1)
        return by_width(p, np.asarray(width), each)

    base = told.select("id", "copies", "label", "width", "vec", ranked("pivots", "width").alias("marks"), F.lit(-1).alias("at"))
    open_ = _deeper(base.withColumn("both", F.least(F.lit(shared), F.size("marks"))), 1)
    done = []
    for depth in range(1, DEPTH + 1):
        split = _split(open_, depth, block) if depth < DEPTH else None
        whole = open_ if split is None else open_.join(split, ["label", "width", *[f"k{d}" for d in range(1, depth + 1)]], "left")
        rest = [F.lit(-1).alias(f"k{d}") for d in range(depth + 1, DEPTH + 1)]
        own = whole if split is None else whole.where("split IS NULL")
        done.append(own.select("id", "copies", "label", "width", "vec", "marks", *[f"k{d}" for d in range(1, depth + 1)], *rest))
        if split is None:
            break
        open_ = _deeper(whole.where("split").drop("split"), depth + 1)
    lists = done[0]
    for more in done[1:]:
        lists = lists.unionByName(more)
    keys = ["label", "width", *[f"k{d}" for d in range(1, DEPTH + 1)]]
    sizes = lists.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    lists = lists.join(write_table(sizes, "blocks"), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    id_kind = same.schema["id"].dataType.simpleString()
    types = {"id": None, "links": pa.int64(), "root": None}

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        _, _, *pivot, i, j = (k.as_py() for k in key)
        pivot = [p for p in pivot if p >= 0]
        both = min(shared, len(group["marks"][0]))
        if i == j:
            return compare_lists(group, None, kind, len(pivot), pivot[-1], both, floor)
        mark = np.asarray(group["block"].combine_chunks())
        a, b = group.filter(pa.array(mark == i)), group.filter(pa.array(mark == j))
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t or group.schema.field("id").type) for n, t in types.items()})
        return compare_lists(a, b, kind, len(pivot), pivot[-1], both, floor)

    # Dealt by the whole key: with the join above by list alone, all blocks of
    # a list would stay in one task.
    hits = lists.select("id", "copies", "vec", "marks", *keys, "block", "i", "j").repartition(*keys, "i", "j")
    hits = hits.groupBy(*keys, "i", "j").applyInArrow(compare, f"id {id_kind}, links long, root {id_kind}")
    hits = write_table(hits, "hits")
    found = write_table(hits.groupBy("id").agg(F.sum("links").alias("links")), "found")
    return found, connected_components(hits.select(F.col("id").alias("a"), F.col("root").alias("b")))


LINKS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other
), k AS (
  SELECT id, min(other) AS component_id FROM r GROUP BY id
), c AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT k.id AS vec_id, coalesce(c.n, 0) AS n_links, k.component_id, k.id = k.component_id AS kept FROM k LEFT JOIN c ON c.a = k.id
"""
