"""Document fingerprints as invertible Bloom lookup sketches (IBLT)."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from ..scratch import partitions

#: Cells of the published sketch, in three parts; each retry has 4 times more.
CELLS, GROWTH = 12, 4
#: Paragraphs are cut after words whose hash ends in this many zero bits, so
#: that texts of one paragraph have digests to compare (mean length 4 words).
CUT_BITS = 2
_SALTS = [np.uint64(s) for s in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def paragraph_digests(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit digests of the text's paragraphs (lines), cut
    at words that their content selects; white space around words is no part."""
    found: list[bytes] = []
    ends = []
    for line in text.split(b"\n"):
        found += line.split()
        ends.append(len(found))
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    memo = words.memo()
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, n)
    cut = (words.mix(h) & np.uint64((1 << CUT_BITS) - 1)) == 0
    last = np.asarray(ends)
    cut[last[last > 0] - 1] = True
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]])
    place = (np.arange(n) - np.repeat(start, stop - start)).astype(np.uint64)
    return np.unique(words.mix(np.add.reduceat(words.mix(h + place * _CHECK), start)))


class Sketches:
    """Cells of many sketches side by side: counts, key sums, check sums.

    Sketch i has size[i] cells in three equal parts; a key goes to one cell
    of each. Sums wrap at 64 bits, so a sketch is subtracted by adding its
    keys with the other sign."""

    def __init__(self, size: np.ndarray):
        self.size = size
        self.first = np.concatenate([[0], np.cumsum(size)])
        total = int(self.first[-1])
        self.count = np.zeros(total, np.int64)
        self.keys = np.zeros(total, np.uint64)
        self.checks = np.zeros(total, np.uint64)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add sign (1 or -1) times each key to its owner; returns the cells."""
        part = (self.size[owner] // 3).astype(np.uint64)
        wrapped = sign.astype(np.int64).view(np.uint64)
        cells = []
        for j, salt in enumerate(_SALTS):
            at = ((words.mix(key ^ salt) >> np.uint64(32)) * part) >> np.uint64(32)
            cell = self.first[owner] + (at + np.uint64(j) * part).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.add.at(self.keys, cell, key * wrapped)
            np.add.at(self.checks, cell, words.mix(key ^ _CHECK) * wrapped)
            cells.append(cell)
        return np.concatenate(cells) if len(key) else np.zeros(0, np.int64)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recover keys until no cell holds a single one: (owner, key, sign)."""
        found = []
        look = np.arange(len(self.count))
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look]
            key = self.keys[look] * sign.view(np.uint64)
            pure = self.checks[look] * sign.view(np.uint64) == words.mix(key ^ _CHECK)
            look, sign, key = look[pure], sign[pure], key[pure]
            owner = np.searchsorted(self.first, look, side="right") - 1
            # a key may stand alone in several cells; and zero-size sketches share a bound
            _, once = np.unique(key ^ words.mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
            owner, key, sign = owner[once], key[once], sign[once]
            if not len(key):
                break
            found.append((owner, key, sign))
            look = np.unique(self.add(owner, key, -sign))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def empty(self) -> np.ndarray:
        """Whether each sketch has nothing left."""
        full = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        sums = np.concatenate([[0], np.cumsum(full)])
        return sums[self.first[1:]] == sums[self.first[:-1]]


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) for every digest that only one side of a pair
    has: 1 for a's, -1 for b's. Sketches are subtracted and peeled; the pairs
    that do not come out empty are sketched again, larger."""
    na, nb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    size = np.full(len(a), cells, np.int64)
    while (low := size < np.abs(na - nb)).any():  # so many keys cannot come out of fewer cells
        size[low] *= GROWTH
    left = np.arange(len(a))
    parts = []
    while len(left):
        keys = np.concatenate([a[i] for i in left] + [b[i] for i in left])
        sign = np.concatenate([np.ones(int(na[left].sum()), np.int64), -np.ones(int(nb[left].sum()), np.int64)])
        owner = np.concatenate([np.repeat(np.arange(len(left)), na[left]), np.repeat(np.arange(len(left)), nb[left])])
        sketch = Sketches(size[left])
        sketch.add(owner, keys, sign)
        who, key, side = sketch.peel()
        done = sketch.empty()
        ok = done[who]
        parts.append((left[who[ok]], key[ok], side[ok]))
        left = left[~done]
        size[left] *= GROWTH
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of digest sets, from their sketches' differences;
    1 for two empty sets."""
    n = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.float64, len(a))
    d = np.bincount(differences(a, b)[0], minlength=len(a))
    return np.where(n > 0, (n - d) / np.maximum(n + d, 1), 1.0)


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """Number of digests and the base sketch of each set, as text."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    sketch = Sketches(np.full(len(sets), cells, np.int64))
    if len(sets):
        owner = np.repeat(np.arange(len(sets)), n)
        sketch.add(owner, np.concatenate(sets), np.ones(len(owner), np.int64))
    out = np.empty((len(sets), cells), np.dtype([("c", "<i4"), ("k", "<u8"), ("s", "<u4")]))
    out["c"], out["k"] = sketch.count.reshape(-1, cells), sketch.keys.reshape(-1, cells)
    out["s"] = (sketch.checks & np.uint64(0xFFFFFFFF)).reshape(-1, cells)
    return [f"{k}:{base64.b64encode(row.tobytes()).decode()}" for k, row in zip(n, out, strict=True)]


def edit_with_next(text: str, following: str) -> str:
    """The last third of the text (floor, in code points) replaced by as many
    first code points of the following one, or all."""
    n = len(text)
    k = n // 3
    return text[: n - k] + following[:k]


def _bounds(keys: DataFrame, n: int) -> list[tuple]:
    """The largest key of each of about n ranges, in descending order."""
    key = [F.col("known").desc(), F.col("id").desc_nulls_last(), F.col("tie").desc()]
    ranges = keys.repartitionByRange(n, *key)
    tops = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("known", "id", "tie")).alias("top"))
    return sorted(((r["top"]["known"], r["top"]["id"] if r["top"]["known"] else 0, r["top"]["tie"]) for r in tops.collect()), reverse=True)


def _hot_ids(ids: DataFrame, n: int) -> list:
    """Ids that more rows repeat than a range should have (null is one); there
    are fewer than n of them."""
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = ids.count()
    return [r["id"] for r in counts.where(F.col("n") * n > F.lit(total)).collect()]


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Rows stand by descending id (null ids last; of one id, by descending text,
    where it is in more rows than a range should have by a hash of the text
    first) in a ring. They are dealt to tasks by ranges, whose bounds (one key
    per range) a scan of the ids alone finds, so that an id or null in a third
    of all rows fills many ranges too; the first row of a range is also sent
    to the range before it, so each task streams through its rows and has
    every row's successor. Texts are shuffled once.

    Null texts count as empty: no digests, and like each other. Other
    columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    n = partitions(spark)
    hot = _hot_ids(rows.select("id"), n)
    is_hot = F.col("id").isin([x for x in hot if x is not None]) if any(x is not None for x in hot) else F.lit(False)
    is_hot = F.coalesce(is_hot, F.lit(False)) | (F.col("id").isNull() & F.lit(None in hot))
    tie = F.when(is_hot, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("id", "text", F.col("id").isNotNull().alias("known"), tie.alias("tie"))
    tops = _bounds(rows.select("known", "id", "tie"), n)
    index = {t: i for i, t in enumerate(tops)}
    ascending = tops[::-1]
    last = max(0, len(tops) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, known, ties = (b.column(i).to_pylist() for i in (0, 2, 3))
            keys = [(k, x if k else 0, t) for k, x, t in zip(known, ids, ties, strict=True)]
            bucket = [last - bisect_left(ascending, x) for x in keys]
            extra = [i for i, x in enumerate(keys) if x in index]
            before = [index[keys[i]] - 1 if index[keys[i]] else last for i in extra]
            both = b.take(pa.array([*range(len(ids)), *extra], pa.int64()))
            mark = [False] * len(ids) + [True] * len(extra)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*bucket, *before], pa.int32()), pa.array(mark), both.column(0), both.column(3), both.column(1)], ["bucket", "next", "id", "tie", "text"]
            )

    dealt = rows.mapInArrow(deal, f"bucket int, next boolean, id {kind}, tie long, text string")
    dealt = dealt.repartitionById(max(1, len(tops)), "bucket")
    dealt = dealt.sortWithinPartitions("next", F.col("id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc())

    def sketch(held: list[tuple]) -> pa.RecordBatch:
        """All but the last of the rows held, which is the others' successor."""
        texts = [t for _, _, t in held]
        own = [paragraph_digests(t.encode()) for t in texts]
        edited = [edit_with_next(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
        raw = [e.encode() for e in edited]
        sets = [paragraph_digests(e) for e in raw]
        columns = [
            pa.array([i for _, i, _ in held[:-1]], id_type[0]),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in raw], pa.string()),
            pa.array(fingerprints(own[:-1]), pa.string()),
            pa.array(fingerprints(sets), pa.string()),
            pa.array(likeness(own[:-1], sets)),
            pa.array(likeness(own[:-1], own[1:])),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays(columns, names)

    id_type: list = [None]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        ended = False
        for b in batches:
            id_type[0] = b.column(2).type
            for mark, i, t in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if ended:
                    break
                held.append((mark, i, t))
                chars += len(t)
                ended = mark
                if chars >= 1_000_000 and len(held) > 1:
                    yield sketch(held)
                    held, chars = held[-1:], len(held[-1][2])
        if len(held) > 1:
            yield sketch(held)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.drop("bucket").select(F.lit(0).alias("z"), "next", "id", "text").mapInArrow(stream, schema)
