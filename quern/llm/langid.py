"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import in_chunks

UNKNOWN = "und"
#: About so many labelled documents a language are learned from.
LEARN_DOCS = 1_000
_PAD = b"\n\n\n"
#: Code lengths (bytes times languages) in memory at a time.
PIECE_VALUES = 4_000_000


def in_pieces(texts: list[str | None], most: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Groups of byte strings of about `most` bytes with the numbers of their
    texts. Texts are lower-cased UTF-8 in the context of line feeds; very long
    ones are cut, each piece beginning with the three bytes before it."""
    parts, owner, size = [], [], 0
    for i, t in enumerate(texts):
        raw = _PAD + (t or "").lower().encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - 3), most):
            parts.append(raw[at : at + most + 3])
            owner.append(i)
            size += len(parts[-1])
            if size >= most:
                yield parts, owner
                parts, owner, size = [], [], 0
    if parts:
        yield parts, owner


def four_grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the three before it, bounds of the parts);
    a part's first three bytes are context only."""
    buf = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    code = buf[3:] | (buf[2:-1] << 8) | (buf[1:-2] << 16) | (buf[:-3] << 24)
    keep = np.ones(len(buf), bool)
    first = np.cumsum(sizes) - sizes
    for i in range(3):
        keep[first + i] = False
    return code[keep[3:]], np.concatenate([[0], np.cumsum(sizes - 3)])


class Table:
    """Sorted codes in an open-addressed table, looked up in bulk."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 4))))
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, place = np.arange(len(codes)), self.slot(codes)
        while len(left):
            free = self.rows[place] < 0
            where, which = np.unique(place[free], return_index=True)
            won = np.flatnonzero(free)[which]
            self.keys[where], self.rows[where] = codes[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, place = left[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        place = self.slot(codes)
        row = self.rows[place]
        open_ = np.flatnonzero((row >= 0) & (self.keys[place] != codes))
        while len(open_):
            at = (place[open_] + 1) & ((1 << self.bits) - 1)
            place[open_] = at
            row[open_] = self.rows[at]
            open_ = open_[(row[open_] >= 0) & (self.keys[at] != codes[open_])]
        return row


class ByteTrees:
    """Frozen context trees of order 3 for each language, with the code
    lengths (nats) of every known path worked out.

    A symbol seen c times in a context that was seen n times with d distinct
    symbols has probability c / (n + d); the escape to the next shorter
    context has d / (n + d); below order 0 all bytes are alike.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray):
        self.langs = langs
        width = len(langs)
        four = np.unique(code)
        c3 = np.zeros((len(four), width))
        np.add.at(c3, (np.searchsorted(four, code), lang), count)
        three = np.unique(np.concatenate([four & 0xFFFFFF, four >> 8]))
        c2 = np.zeros((len(three), width))
        np.add.at(c2, np.searchsorted(three, four & 0xFFFFFF), c3)
        c1 = np.zeros((1 << 16, width))
        np.add.at(c1, four & 0xFFFF, c3)
        c0 = c1.reshape(256, 256, width).sum(axis=0)

        def lengths(c, context, n_contexts, below):
            """Code lengths at this order, and the escapes by context."""
            total, kinds = np.zeros((n_contexts, width)), np.zeros((n_contexts, width))
            np.add.at(total, context, c)
            np.add.at(kinds, context, c > 0)
            escape = np.where(total > 0, -np.log(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            seen = -np.log(np.maximum(c, 1) / np.maximum(total + kinds, 1)[context])
            return np.where(c > 0, seen, escape[context] + below), escape

        cost0, _ = lengths(c0, np.zeros(256, np.int64), 1, np.log(256.0))
        pair = np.arange(1 << 16)
        self.cost1, _ = lengths(c1, pair >> 8, 256, cost0[pair & 0xFF])
        cost2, self.escape2 = lengths(c2, three >> 8, 1 << 16, self.cost1[three & 0xFFFF])
        context = np.searchsorted(three, four >> 8)
        cost3, escape3 = lengths(c3, context, len(three), cost2[np.searchsorted(three, four & 0xFFFFFF)])
        self.four, self.three = Table(four.astype(np.uint32)), Table(three.astype(np.uint32))
        none = np.zeros((1, width))  # row -1: no such context, no escape to pay
        self.cost3, self.cost2, self.escape3 = cost3, cost2, np.concatenate([escape3, none])

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): the exact code length of each whole text. The
        lengths of a text's pieces add up; a piece is smaller the more
        languages there are, so that memory stays the same."""
        sums = np.zeros((len(texts), len(self.langs)))
        for parts, owner in in_pieces(texts, max(4096, PIECE_VALUES // max(1, len(self.langs)))):
            np.add.at(sums, owner, self._lengths(parts))
        return sums

    def _lengths(self, parts: list[bytes]) -> np.ndarray:
        code, bounds = four_grams(parts)
        row = self.four.find(code)
        cost = self.cost3[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            c = code[new]
            low = self.three.find(c & np.uint32(0xFFFFFF))
            shorter = np.where((low >= 0)[:, None], self.cost2[low], 0.0)
            rare = np.flatnonzero(low < 0)
            shorter[rare] = self.escape2[(c[rare] >> 8) & 0xFFFF] + self.cost1[c[rare] & 0xFFFF]
            cost[new] = self.escape3[self.three.find(c >> np.uint32(8))] + shorter
        sums = np.zeros((len(parts), len(self.langs)))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            sums[full] = np.add.reduceat(cost, bounds[full], axis=0)
        return sums


def learn_trees(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = LEARN_DOCS
) -> ByteTrees | None:
    """Trees from a bounded sample: by a hash of the id, about docs_per_lang
    whole documents of each language (all, where it has no more). The counts
    are made in tasks and summed by Spark; the driver gets the distinct byte
    sequences of the sample. None if no row has a language and a text."""
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    share = known.groupBy("lang").agg((F.lit(docs_per_lang) / F.count(F.lit(1))).alias("share"))
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = known.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for parts, _ in in_pieces(own, PIECE_VALUES // 4):
                    code, n = np.unique(four_grams(parts)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "code", "n"],
                    )

    sums = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    if got.empty:
        return None
    langs = sorted(set(got["lang"]))
    at = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    return ByteTrees(langs, at, got["code"].to_numpy(np.int64), got["n"].to_numpy(np.float64))


def predict_language(docs: DataFrame, trees: ByteTrees | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language with the shortest code
    for the whole text (ties: the first by name) and its posterior under
    equal priors. `und` and 0 for null texts, texts without a letter, and
    where nothing was learned. Same-named columns are replaced; rows and
    other columns stay."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if trees is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def classify(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in col:
            texts = part.to_pylist()
            names, scores = [], []
            for lo, hi in in_chunks(texts):
                bits = model.value.code_lengths(texts[lo:hi])
                odds = np.exp(bits.min(axis=1, keepdims=True) - bits)
                best = bits.argmin(axis=1)
                names += [model.value.langs[i] for i in best]
                scores.append(1.0 / odds.sum(axis=1))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(flat)], ["lang_pred", "score"])

    out = docs.select(*keep, F.when(letters, F.col(text_col)).alias("__q_text"))
    out = out.withColumn("__q_p", classify("__q_text"))
    found = F.col("__q_text").isNotNull()
    return out.select(
        *keep,
        F.when(found, F.col("__q_p.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(found, F.col("__q_p.score")).otherwise(0.0).alias("score"),
    )


def in_fold(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text has this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", in_fold("doc_id", 3, 1).alias("held_out"))
    trees = learn_trees(rows.where("NOT held_out AND doc_id IS NOT NULL"))
    return predict_language(rows.select("doc_id", "text", "held_out"), trees).drop("text")
