"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from ..operators.components import connected_components
from .words import shingle_set

#: 60 permutations give 60 least and 60 largest values: 24 bands of 5. A pair
#: of similarity 0.85 shares a band with probability 1 - (1 - 0.85**5)**24,
#: all but one in a million.
PERMUTATIONS, ROWS = 60, 5
#: Lower similarities take shorter bands, so that no more pairs are missed.
MISSED = 1e-6


def band_rows(percent: int, permutations: int = PERMUTATIONS) -> int:
    """The longest band, of ROWS at most, with which a pair at the threshold
    misses all bands with a probability of MISSED at most; 1 if none has."""
    for rows in range(ROWS, 1, -1):
        bands, rest = divmod(2 * permutations, rows)
        if not rest and (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return rows
    return 1


def _permutations(n: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def minmax_bands(sets: list[np.ndarray], permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) of 64-bit band keys; every set has an element at least.

    Each permutation of 32 bits is evaluated once and gives two values of the
    signature, the least and the largest; a band takes values of one kind."""
    a, b = _permutations(permutations)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(size) - size
    sig = np.empty((2, permutations, len(sets)), np.uint32)
    for p in range(permutations):
        y = x * a[p] + b[p]
        np.minimum.reduceat(y, first, out=sig[0, p])
        np.maximum.reduceat(y, first, out=sig[1, p])
    grouped = sig.reshape(2 * permutations // rows, rows, len(sets)).astype(np.uint64)
    key = np.arange(1, len(grouped) + 1, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95)
    for r in range(rows):
        key = (key ^ grouped[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.T.view(np.int64)


def _batches(sizes: Iterator[int] | list[int], most: int = 150_000) -> Iterator[tuple[int, int]]:
    first = total = 0
    n = 0
    for n, s in enumerate(sizes, 1):
        total += s
        if total >= most:
            yield first, n
            first, total = n, 0
    if first < n:
        yield first, n


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, band: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): the size of each row's shingle
    set, a 128-bit digest of the whole set, and its band keys (null if empty)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            lengths = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            for lo, hi in _batches(lengths, 1_000_000):
                sets = [shingle_set(t.as_py(), width) for t in texts.slice(lo, hi - lo)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, minmax_bands([sets[i] for i in full], rows=band), strict=True):
                        keys[i] = set_digest(sets[i])
                        bands[i] = row
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return rows.mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def set_digest(s: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(id, set_key, set) of rows (id, text): whole sets, as sorted 64-bit
    hashes, and their digests; only of those that aren't empty."""
    kind = docs.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [shingle_set(t.as_py(), width) for t in part.column(1)]
                full = [i for i, s in enumerate(found) if len(s)]
                columns = [pa.array([f(found[i]) for i in full], pa.binary()) for f in (set_digest, np.ndarray.tobytes)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full, pa.int64())), *columns], ["id", "set_key", "set"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(sets, f"id {kind}, set_key binary, set binary")


def shared_count(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sets of sorted 64-bit hashes."""
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        out[i] = len(np.intersect1d(p, q, assume_unique=True))
    return pa.array(out)


def _similar_sizes(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose whole sets are similar enough."""
    count = F.arrow_udf(shared_count, "long")
    p = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    p = p.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    p = p.select("a", "b", "na", "nb", count("sa", "sb").alias("both"))
    return p.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame, band: int, percent: int) -> pd.DataFrame:
    """Links (a, b) between two blocks of a bucket whose ends are in
    different components: one for each row of `left` and component reached.
    A pair is met only in the first band that it shares."""
    bands = np.stack(right["bands"].to_numpy())
    sets = [np.frombuffer(x, np.uint64) for x in right["set"]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), size)[order]
    ids, component = right["node"].to_numpy(), right["component"].to_numpy()
    found: list[tuple] = []
    for row in left.itertuples():
        own = np.frombuffer(row.set, np.uint64)
        n = len(own)
        ok = (component != row.component) & (np.minimum(size, n) * 100 >= np.maximum(size, n) * percent)
        if not ok.any():
            continue
        same = bands == np.asarray(row.bands)
        ok &= same.any(axis=1) & (np.asarray(row.bands)[same.argmax(axis=1)] == band)
        if not ok.any():
            continue
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        hits = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
        both = np.bincount(owner[hits], minlength=len(sets))
        linked = np.flatnonzero(ok & (both * 100 >= (size + n - both) * percent))
        _, once = np.unique(component[linked], return_index=True)
        found += [(row.node, ids[k]) for k in linked[once]]
    return pd.DataFrame(found, columns=["a", "b"])


def _links_within(rows: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All links of open buckets (band, node, n, component) between different
    components, bucket by bucket in blocks: whatever a bucket's size, a task
    holds two blocks, and pairs that do not link leave no row."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(sets, "node").join(classes.select("node", "bands"), "node")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key
        a, b = group[group["block"] == i], group[group["block"] == j]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []})
        return compare_blocks(a, b, band, percent)

    return rows.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


#: Ids of this many documents, of 8 bytes, are broadcast; more are joined.
BROADCAST_IDS = 2_000_000
#: Rows of one bucket that a task compares at a time.
BLOCK = 400


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, by_row: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, classes, groups): (doc_id, n_shingles, set_key) of every row;
    (node, set_key, rep, copies) of every class of rows with an equal set; and
    (node, component) of the classes that are linked, component a node.

    Classes that share a band are candidates; a link needs 100 * intersection
    >= percent * union of the whole sets, and the bands are as long as
    `percent` allows (band_rows). Components need no pair within them: first
    every member of a bucket is compared with its least, then with its largest
    member, so a group of copies costs two comparisons each; then, in the
    buckets of four and more, all pairs whose ends are still in different
    components, in blocks. So no link between candidates is lost, and no
    bucket is collected. Rows without an id are left out, and the classes of
    rows with one id are linked as well, unless rows count one by one (by_row).

    Null texts and texts without words have no set and no class."""
    signed = write_table(signatures(docs, id_col, text_col, width, band_rows(percent)), "signed")
    linked = signed.where("set_key IS NOT NULL" + " AND doc_id IS NOT NULL" * (not by_row))
    classes = linked.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")
    )
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    # What is joined on a band is a table of its own, so that Spark can
    # broadcast it when small and split a hot bucket's rows when not.
    buckets = write_table(buckets, "buckets")
    members = write_table(banded.join(buckets, "band"), "members")
    # One text of each class that is compared: a row of its least id.
    wanted = members.select("node").distinct().join(classes.select("node", "set_key", "rep"), "node")
    wanted = write_table(wanted, "wanted")
    ids = wanted.select("rep").distinct()
    if wanted.count() <= BROADCAST_IDS:  # else the texts are shuffled to them
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(ids, F.col("id") == F.col("rep"), "left_semi")
    if by_row:  # classes of rows without an id have no other name
        chosen = chosen.unionAll(texts.where("id IS NULL"))
    sets = shingle_sets(chosen, width).join(wanted.drop("rep").withColumnRenamed("set_key", "own"), F.col("set_key") == F.col("own")).select("node", "set")
    repeated = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("set_key").alias("lo"), F.max("set_key").alias("hi"))
    repeated = write_table(repeated.where("rows > 1").select("doc_id", (F.col("lo") < F.col("hi")).alias("several")), "repeated")
    if not repeated.isEmpty():  # then rows of one id may give one set twice
        sets = sets.dropDuplicates(["node"])
    sets = write_table(sets, "sets")

    edges = _same_id(linked, classes, repeated.where("several" if not by_row else "false"))
    component = write_table(connected_components(edges), "components")
    tried = None
    for turn in ("least", "largest", "all"):
        own = component.select(F.col("id").alias("node"), "component")
        rows = members.join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn != "least":
            several = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
            several = several.where("lo < hi" if turn == "largest" else "lo < hi AND m > 3").select("band")
            rows = write_table(rows.join(write_table(several, "several"), "band"), "open")
            if rows.isEmpty():
                break
        if turn == "all":
            found = write_table(_links_within(rows, sets, classes, percent), "links")
        else:
            pick = F.min if turn == "least" else F.max
            centres = rows.groupBy("band").agg(pick(F.struct("node", "n", "component")).alias("c"))
            centres = centres.select("band", F.col("c.node").alias("b"), F.col("c.n").alias("nb"), F.col("c.component").alias("cb"))
            pairs = rows.join(write_table(centres, "centres"), "band").where("component <> cb").where(_similar_sizes("n", "nb", percent))
            first = F.col("node") < F.col("b")
            pairs = pairs.select(
                F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"),
                F.when(first, F.col("n")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("n")).alias("nb"),
            ).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = write_table(pairs, "pairs")
            tried = pairs.select("a", "b")
            found = write_table(_verified(pairs, sets, percent), "links")
        edges = edges.unionAll(found)
        component = write_table(connected_components(edges), "components")
    groups = component.select(F.col("id").alias("node"), "component")
    return signed.select("doc_id", "n_shingles", "set_key"), classes.select("node", "set_key", "rep", "copies"), groups


def _same_id(linked: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each id that has several, each
    class to the id's least."""
    own = linked.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").distinct()
    own = own.join(classes.select("set_key", "node"), "set_key")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return write_table(own.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"), "same-id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the least id that links reach (near_classes); equal sets
    are one class, compared once. Rows that repeat an id are one node and each
    get its component, whatever their texts; rows without a set are alone.
    Rows with a null id link with nothing, have a null component and are
    kept. Other columns are left out. An empty table gives an empty one.
    """
    signed, classes, groups = near_classes(docs, id_col, text_col, width, percent)
    named = classes.join(groups, "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("set_key", "least")
    multi = classes.where("copies > 1").select("set_key", "rep").join(named.select("set_key"), "set_key", "left_anti")
    told = named.unionAll(multi.select("set_key", F.col("rep").alias("least")))
    out = signed.join(told, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the least
    id (nulls last; of several, that of the least digest of its set).

    Decided by row, not by id: of the rows under one id, or under null, each
    stays or goes by its own text, one row of equal ones stays, and a text
    that nothing else holds stays. Unlike in near_duplicates, an id does not
    link its rows. Rows without words stay. All columns stay as they are; an
    empty table gives an empty one. Only ids are joined to the texts; of ids
    that repeat, the texts are hashed once more to tell the rows apart."""
    signed, classes, groups = near_classes(docs, id_col, text_col, width, percent, by_row=True)
    own = classes.join(groups, "node", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    best = own.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "set_key")).alias("best"))
    own = own.join(best, "component").select(
        F.col("set_key").alias("__q_set"), F.col("rep").alias("__q_rep"), (F.col("set_key") == F.col("best.set_key")).alias("__q_best")
    )
    own = write_table(own, "chosen")
    stays = F.col("__q_best") & F.col("__q_id").eqNullSafe(F.col("__q_rep"))
    repeated = signed.groupBy(F.col("doc_id").alias("__q_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__q_id")
    repeated = write_table(repeated, "repeated-ids")
    gone = signed.select(F.col("doc_id").alias("__q_id"), "set_key").join(own, F.col("set_key") == F.col("__q_set")).where(~stays)
    gone = write_table(gone.select("__q_id").where("__q_id IS NOT NULL").distinct(), "gone")
    same = F.col(id_col).eqNullSafe(F.col("__q_id"))
    if repeated.isEmpty():
        return docs.join(gone, F.col(id_col) == F.col("__q_id"), "left_anti")
    single = docs.join(repeated, same, "left_anti").join(gone, F.col(id_col) == F.col("__q_id"), "left_anti")

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py(), width) for t in texts)
        return pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())

    rest = docs.join(repeated, same, "left_semi").withColumn("__q_key", digest(F.col(text_col).cast("binary")))
    rest = rest.join(own, F.col("__q_key") == F.col("__q_set"), "left").withColumn("__q_id", F.col(id_col))
    alone = rest.where("__q_set IS NULL").select(*docs.columns)
    return single.unionAll(alone).unionAll(rest.where(stays).dropDuplicates(["__q_key"]).select(*docs.columns))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
         lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w
), n AS (
  SELECT doc_id, len(ss) AS n FROM s
), f AS (
  SELECT doc_id, unnest(ss) AS sh FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other
), k AS (
  SELECT id, min(other) AS component_id FROM r GROUP BY id
)
SELECT n.doc_id, n.n AS n_shingles, k.component_id, n.doc_id = k.component_id AS kept FROM n JOIN k ON k.id = n.doc_id
"""
