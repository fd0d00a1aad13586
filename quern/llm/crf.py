"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .langid import in_fold
from .packing import in_chunks

#: About so many labelled documents of each label are learned from.
LEARN_DOCS = 1_500
#: Documents of more lines are not learned from, and of the sample as many
#: documents are taken as have so many lines together: what the driver holds.
LEARN_LINES, LEARN_ALL_LINES = 2_000, 400_000
#: Bytes of a very long text whose counts are in memory at a time; lines of a
#: text from which on its chain is worked on in blocks.
PIECE, LONG_LINES = 1_000_000, 2_000
THRESHOLD = 0.7
BASE_FEATURES = 17


def _byte_classes() -> np.ndarray:
    """(class, byte) -> 0 or 1: upper, lower, digit, non-ASCII, bar,
    exclamation, other symbol, sentence punctuation, white space."""
    table = np.zeros((9, 256), np.uint8)
    byte = np.arange(256)
    table[0] = (byte >= 65) & (byte <= 90)
    table[1] = (byte >= 97) & (byte <= 122)
    table[2] = (byte >= 48) & (byte <= 57)
    table[3] = byte >= 128
    table[4] = byte == ord("|")
    table[5] = byte == ord("!")
    table[6, [ord(c) for c in "#$%&*+/<=>@\\^_`{}~"]] = 1
    table[7, [ord(c) for c in ".,;:?'\"()-"]] = 1
    table[8] = (byte == 32) | ((byte >= 9) & (byte <= 13))
    return table


_CLASSES = _byte_classes()
#: The classes' marks in fields of 21 bits, three to a word, so that one sum
#: over a line counts three classes; lines of 2 MB and more are summed class by class.
_PACKED = [sum(_CLASSES[3 * w + k].astype(np.uint64) << np.uint64(21 * k) for k in range(3)) for w in range(3)]
_FIELD = 1 << 21
_MULTIPLIER = np.uint32(0x9E3779B1)
_WORD_MIX = (np.arange(1, 257, dtype=np.uint64) * 0x85EBCA6B % (1 << 32)).astype(np.uint32)


def _class_counts(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    if len(size) and size.max() >= _FIELD - 1:
        return [np.add.reduceat(_CLASSES[k][buf].astype(np.int64), starts) for k in range(9)]
    sums = [np.add.reduceat(p[buf], starts) for p in _PACKED]
    return [((sums[k // 3] >> np.uint64(21 * (k % 3))) & np.uint64(_FIELD - 1)).astype(np.int64) for k in range(9)]


@dataclass
class _Counts:
    """What the features of lines are made of; all but the ends add up over
    the parts of a line."""

    size: np.ndarray
    classes: np.ndarray  # (9, lines)
    words: np.ndarray
    same: np.ndarray  # words equal to the one before
    first: np.ndarray  # bytes
    last: np.ndarray
    keys: tuple[int | None, int | None]  # hashes of the first and last word of all

    def features(self) -> np.ndarray:
        n, many = np.maximum(self.size, 1).astype(np.float64), np.maximum(self.words, 1)
        share = [c / n for c in self.classes[:8]]
        cols = [
            np.log1p(self.size), np.log1p(self.words), self.size / many / 10.0, self.same / many, *share, self.classes[8] / n,
            ((self.first >= 65) & (self.first <= 90)).astype(float), np.isin(self.last, np.frombuffer(b".!?", np.uint8)).astype(float),
            (share[0] > 0.5).astype(float), (self.size == 0).astype(float),
        ]
        return np.stack(cols, axis=1)


def _count_lines(buf: np.ndarray) -> _Counts:
    """Counts of the lines of a buffer that ends with a line feed."""
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    counts = np.stack(_class_counts(buf, starts, size))
    counts[8] -= 1  # without the line's own end
    space = _CLASSES[8].astype(bool)[buf]
    # Words: maximal runs of other bytes, each with a polynomial hash.
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate([[0], edge])
    begin, stop = edge[::2], edge[1::2]  # the buffer ends in white space
    words, same, keys = np.zeros(len(ends)), np.zeros(len(ends)), (None, None)
    if len(begin):
        line = np.searchsorted(ends, begin)
        place = np.arange(len(buf), dtype=np.uint32)
        place[begin[0] :] -= np.repeat(begin.astype(np.uint32), np.diff(np.concatenate([begin, [len(buf)]])))
        place[: begin[0]] = 0
        mixed = _WORD_MIX[buf] * (place * np.uint32(2) + np.uint32(3))
        mixed ^= mixed >> np.uint32(15)
        mixed *= _MULTIPLIER
        key = np.add.reduceat(mixed, np.stack([begin, stop], axis=1).ravel()[: 2 * len(begin)])[::2]
        words = np.bincount(line, minlength=len(ends)).astype(np.float64)
        again = (key[1:] == key[:-1]) & (line[1:] == line[:-1])
        same = np.bincount(line[1:][again], minlength=len(ends)).astype(np.float64)
        keys = int(key[0]), int(key[-1])
    return _Counts(size, counts, words, same, buf[starts], buf[np.maximum(ends - 1, starts)], keys)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its UTF-8 length, bounds of the texts' lines),
    from one pass over the bytes of all texts."""
    parts = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    lines = _count_lines(buf)
    text_ends = np.cumsum([len(p) for p in parts])
    bounds = np.concatenate([[0], np.searchsorted(np.cumsum(lines.size + 1), text_ends) + 1])
    return lines.features(), lines.size, bounds


def _long_word(line: bytes, at: int, end: int, piece: int) -> _Counts:
    """Counts of one word, line[at:end], by parts; its hash is a sum over its
    bytes and their places, and goes on from part to part."""
    parts, key = [], np.uint32(0)
    for lo in range(at, end, piece):
        buf = np.frombuffer(line, np.uint8, min(piece, end - lo), lo)
        mixed = _WORD_MIX[buf] * (np.arange(lo - at, lo - at + len(buf), dtype=np.uint32) * np.uint32(2) + np.uint32(3))
        mixed ^= mixed >> np.uint32(15)
        mixed *= _MULTIPLIER
        key = np.add(key, np.add.reduce(mixed, dtype=np.uint32), dtype=np.uint32)
        parts.append(_count_lines(np.concatenate([buf, np.array([10], np.uint8)])))
    size, classes = sum(p.size for p in parts), sum(p.classes for p in parts)
    return _Counts(size, classes, np.ones(1), np.zeros(1), parts[0].first, parts[-1].last, (int(key), int(key)))


def _long_line(line: bytes, piece: int) -> _Counts:
    """Counts of one line, by parts cut before white space; a word that is
    longer than a part is a part of its own. They equal those of the whole."""
    spaces = b" \t\r\x0b\x0c"
    total, at = None, 0
    while at < len(line):
        end = min(len(line), at + piece)
        part = None
        if end < len(line):
            end = max((line.rfind(c, at + 1, end) for c in spaces), default=-1)
            if end <= at:
                end = at + 1
                while end < len(line) and line[at] in spaces and line[end] in spaces:
                    end += 1
                if line[at] not in spaces:
                    end = len(line)
                    for c in spaces:
                        found = line.find(c, at, end)
                        end = found if found >= 0 else end
                    part = _long_word(line, at, end, piece)
        part = part or _count_lines(np.frombuffer(line[at:end] + b"\n", np.uint8))
        if total is None:
            total = part
        else:
            again = part.keys[0] is not None and part.keys[0] == total.keys[1]
            keys = (total.keys[0] if total.keys[0] is not None else part.keys[0], part.keys[1] if part.keys[1] is not None else total.keys[1])
            total = _Counts(
                total.size + part.size, total.classes + part.classes, total.words + part.words, total.same + part.same + again, total.first, part.last, keys
            )
        at = end
    return total


def features_by_pieces(text: str, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, UTF-8 lengths) of the lines of a very long text, some lines
    at a time; only a piece has its counts in memory."""
    raw = text.encode("utf-8", "surrogatepass")
    at = 0
    while at <= len(raw):
        end = len(raw) if len(raw) - at <= piece else raw.rfind(b"\n", at, at + piece)
        if end < at:  # a line longer than a piece
            end = raw.find(b"\n", at)
            end = len(raw) if end < 0 else end
            lines = _long_line(raw[at:end], piece)
        else:
            lines = _count_lines(np.frombuffer(raw[at:end] + b"\n", np.uint8))
        yield lines.features(), lines.size
        at = end + 1


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's features, its neighbours' (zeros beyond the text), marks
    of the first and last line, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    before[first], after[last] = 0.0, 0.0
    marks = np.zeros((len(x), 3))
    marks[first, 0], marks[last, 1], marks[:, 2] = 1.0, 1.0, 1.0
    return np.concatenate([x, before, after, marks], axis=1)


def marginals(score: np.ndarray, trans: np.ndarray, bounds: np.ndarray):
    """Forward-backward over all texts at once, in the order of position.

    score: log potential of good minus bad for each line; trans: 2 x 2 log
    potentials. Returns the marginal of good for each line, the expected
    transitions and the log partition of each text."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t lines
    move = np.exp(trans)
    unary = np.stack([np.zeros_like(score), score], axis=1)
    unary -= (shift := unary.max(axis=1, keepdims=True))
    unary = np.exp(unary)
    alpha, beta = np.zeros_like(unary), np.ones_like(unary)
    scale = np.ones(len(score))
    for t in range(longest):
        at = start[: live[t]] + t
        a = unary[at] if t == 0 else (alpha[at - 1] @ move) * unary[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        beta[at] = ((unary[at + 1] * beta[at + 1]) @ move.T) / scale[at + 1][:, None]
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(score), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * move[None] * (unary[at] * beta[at])[:, None, :]
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    logz = np.add.reduceat(np.log(scale) + shift[:, 0], bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return good, pair, logz


def chain_marginals(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The marginals of good of one long text: forward-backward in about
    sqrt(n) blocks side by side. The blocks' products of step matrices carry
    the messages from block to block; within blocks all go on together."""
    n = len(score)
    b = max(1, int(np.ceil(np.sqrt(n))))
    k = -(-n // b)
    move = np.exp(trans)
    unary = np.stack([np.zeros_like(score), score], axis=1)
    unary = np.exp(unary - unary.max(axis=1, keepdims=True))
    unary = np.concatenate([unary, np.ones((k * b - n, 2))]).reshape(k, b, 2)

    def step(t: int) -> np.ndarray:
        """Each block's matrix of its line t: from the state before to its own."""
        m = move[None] * unary[:, t, None, :]
        if t == 0:
            m[0] = unary[0, 0]  # nothing comes before the first line
        m[np.arange(k) * b + t >= n] = np.eye(2)
        return m

    through = np.tile(np.eye(2), (k, 1, 1))
    for t in range(b):
        through = through @ step(t)
        through /= through.sum(axis=(1, 2), keepdims=True)
    left, right = np.empty((k, 2)), np.empty((k, 2))
    a, z = np.array([1.0, 0.0]), np.ones(2)
    for i in range(k):
        left[i], a = a, a @ through[i]
        a /= a.sum()
    for i in range(k - 1, -1, -1):
        right[i], z = z, through[i] @ z
        z /= z.sum()
    alpha = np.empty((k, b, 2))
    for t in range(b):
        left = np.einsum("ki,kij->kj", left, step(t))
        left /= left.sum(axis=1, keepdims=True)
        alpha[:, t] = left
    good = np.empty((k, b))
    for t in range(b - 1, -1, -1):
        both = alpha[:, t] * right
        good[:, t] = both[:, 1] / both.sum(axis=1)
        right = np.einsum("kij,kj->ki", step(t), right)
        right /= right.sum(axis=1, keepdims=True)
    return good.ravel()[:n]


@dataclass
class LineField:
    """A fitted field: feature scale, weights, transitions, calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Of each line, what it adds to its own potential and to those of the
        lines after and before it."""
        return ((x - self.mean) / self.spread) @ self.weights[: 3 * BASE_FEATURES].reshape(3, BASE_FEATURES).T

    def potentials(self, parts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Potentials of all lines, as by with_neighbours."""
        first, last, always = self.weights[3 * BASE_FEATURES :]
        z, before, after = parts[:, 0] + always, np.zeros(len(parts)), np.zeros(len(parts))
        before[1:], after[:-1] = parts[:-1, 1], parts[1:, 2]
        before[bounds[:-1]], after[bounds[1:] - 1] = first, last
        return z + before + after

    def raw(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of good."""
        return self.weighted(self.potentials(self.parts(x), bounds), size, bounds)

    def weighted(self, z: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        good, n = np.empty(len(z)), np.diff(bounds)
        for i in np.flatnonzero(n > LONG_LINES):
            good[bounds[i] : bounds[i + 1]] = chain_marginals(z[bounds[i] : bounds[i + 1]], self.trans)
        short = np.repeat(n <= LONG_LINES, n)
        if short.any():
            own = np.concatenate([[0], np.cumsum(n[n <= LONG_LINES])])
            good[short] = marginals(z[short], self.trans, own)[0]
        weight = size + 1.0
        return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0] or "") > PIECE:
            parts, size = zip(*((self.parts(x), n) for x, n in features_by_pieces(texts[0])), strict=True)
            parts, size = np.concatenate(parts), np.concatenate(size)
            bounds = np.array([0, len(size)])
            raw = self.weighted(self.potentials(parts, bounds), size, bounds)
        else:
            raw = self.raw(*line_features(texts))
        return 1.0 / (1.0 + np.exp(-(self.slope * _logit(raw) + self.offset)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_field(
    x: np.ndarray, size: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = 120, weight: np.ndarray | None = None
) -> LineField:
    """Maximum likelihood by gradient ascent (Adam), every line taking its
    document's label, each document weighing as one line of its label's share;
    then the aggregated marginals are calibrated on the same documents, each
    counting `weight` times there (once by default)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    full = with_neighbours((x - mean) / spread, bounds)
    n = np.diff(bounds)
    y = np.repeat(label, n).astype(np.float64)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    doc_weight = share / n
    line_weight = np.repeat(doc_weight, n)
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    observed = np.zeros((len(y), 2, 2))
    observed[np.arange(len(y)), y.astype(int), y.astype(int)] = 1.0
    observed, pair_weight = observed[inner], line_weight[inner][:, None, None]
    theta = np.zeros(full.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        good, pair, _ = marginals(full @ w, trans, bounds)
        grad = np.concatenate([full.T @ ((y - good) * line_weight), ((observed - pair) * pair_weight).sum(axis=0).ravel()])
        grad -= 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = LineField(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    z = _logit(field.raw(x, size, bounds))
    times = np.ones(len(label)) if weight is None else weight
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps for the two calibration parameters
        p = 1 / (1 + np.exp(-(a * z + b)))
        off = times * (label - p)
        g = np.array([(off * z).sum() - 0.01 * (a - 1), off.sum() - 0.01 * b])
        h = times * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-9:
            break
    field.slope, field.offset = float(a), float(b)
    return field


def learn_field(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_docs: int = LEARN_DOCS) -> LineField | None:
    """A field from a bounded sample of docs with a 0/1 label in `known`
    (doc_id, y): by a hash of the id, about n_docs whole documents of the
    rarer label and as many times more of the other as it is commoner, up to
    4 (all, where there are no more). In the calibration each counts for the
    documents of its label that it stands for, so that scores keep the labels'
    ratio in the whole table. Documents of more than LEARN_LINES lines are
    not learned from, and together the sample has LEARN_ALL_LINES at most. Ids are joined to choose the sample;
    its ids, so few by the bound, are broadcast to the texts. Line features
    are made in tasks; the driver fits on them. None unless both labels occur."""
    has = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"))
    rows = write_table(has.join(known.where("y IN (0, 1)"), "doc_id").select("doc_id", F.col("y").cast("int").alias("y")), "labelled")
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return None
    rate = min(1.0, n_docs / min(found.values()))
    share = {y: min(rate, 4 * n_docs / n) for y, n in found.items()}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.where(unit < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).dropDuplicates(["doc_id"])
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    chosen = chosen.join(F.broadcast(sample), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("h"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, texts, h = (b.column(i).to_pylist() for i in range(3))
            for lo, hi in in_chunks(texts):
                own = [i for i in range(lo, hi) if texts[i].count("\n") < LEARN_LINES]
                if not own:
                    continue
                x, size, bounds = line_features([texts[i] for i in own])
                cut = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([labels[i] for i in own], pa.int32()), pa.array([h[i] for i in own], pa.int64()), pa.array(np.diff(bounds)),
                        pa.array([x[a:z].tobytes() for a, z in cut], pa.binary()), pa.array([size[a:z].astype(np.int64).tobytes() for a, z in cut], pa.binary()),
                    ],
                    ["y", "h", "lines", "x", "size"],
                )

    measured = write_table(chosen.mapInArrow(measure, "y int, h long, lines long, x binary, size binary"), "measured")
    lines = sorted(measured.select("h", "y", "lines").collect())  # as many rows as the sample has
    upto = np.searchsorted(np.cumsum([r["lines"] for r in lines]), LEARN_ALL_LINES, side="right")
    taken = {y: max(1, sum(r["y"] == y for r in lines[:upto])) for y in found}
    if not upto:
        return None
    got = measured.where(F.col("h") <= lines[upto - 1]["h"]).select("y", "x", "size").collect()
    got = sorted(map(tuple, got), key=lambda r: (r[0], bytes(r[1])))
    if len({r[0] for r in got}) < 2:
        return None
    x = np.concatenate([np.frombuffer(r[1], np.float64).reshape(-1, BASE_FEATURES) for r in got])
    sizes = [np.frombuffer(r[2], np.int64) for r in got]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    label = np.array([r[0] for r in got])
    weight = np.where(label == 1, found[1] / taken[1], found[0] / taken[0])
    return fit_field(x, np.concatenate(sizes), bounds, label, weight=weight)


def score_quality(docs: DataFrame, field: LineField | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from `threshold` on).

    Null texts count as empty ones, a single empty line; without a field all
    scores are 0.5. Very long texts are scored whole, by pieces. Same-named
    columns are replaced; rows and others stay."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    if field is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    model = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("double")
    def score(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in col:
            texts = part.to_pylist()
            found = [model.value.scores(texts[lo:hi]) for lo, hi in in_chunks(texts, alone=True)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    out = docs.select(*keep, score(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learned_from(docs: DataFrame, labels: DataFrame, held_out: Column, n_docs: int = LEARN_DOCS) -> LineField | None:
    """The field fitted on the labelled rows of docs that are not held out;
    of several labels of a document the largest counts."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("quality").alias("y"))
    return learn_field(docs, known, n_docs=n_docs)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = in_fold("doc_id", 4, 2)
    field = learned_from(docs, labels, held)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return score_quality(rows, field).drop("text")
