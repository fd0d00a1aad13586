"""Alignment of two tokenizers over the same bytes, and the number of
documents that hold each linked pair of tokens."""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import partitions, scratch_path, write_table
from .packing import CHUNK_CHARS, in_chunks

#: Units of text, and their characters, that a task remembers before it starts anew.
MEMO_UNITS, MEMO_CHARS = 300_000, 8_000_000
#: Pair keys that a task gathers before it adds up equal ones.
PARTIAL_KEYS = 4_000_000

#: Where a text can be cut without a change to either tokenizer's tokens: at a
#: space after another character than white space. The space goes with what
#: follows: the first tokenizer begins a word with it and the second puts its
#: own there. A space at the text's end stays, as nothing follows.
_CUT = re.compile(r"(?<=\S) (?!\Z)")
#: White space before a space: such spaces are no cuts. Searched one by one,
#: which is several times faster than a pattern.
_KEPT_SPACES = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def units(text: str) -> list[str]:
    """The parts of a text that are tokenized apart; none of an empty one."""
    if not text:
        return []
    unlike = text[0] == " " or text[-1] == " " or any(s in text for s in _KEPT_SPACES)
    return _CUT.split(text) if unlike else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others in turn for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ragged:
    """Rows of int64 numbers, end to end."""

    def __init__(self, values: np.ndarray, size: np.ndarray):
        self.values, self.size = values, size
        self.first = np.cumsum(size) - size

    def add(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.values, other.values]), np.concatenate([self.size, other.size]))

    def take(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        before = np.cumsum(size) - size
        return self.values[np.repeat(self.first[at] - before, size) + np.arange(size.sum())]


class Aligner:
    """Tokens, groups and links of units of text, remembered by unit.

    links(unit) are the keys a << 32 | b of all pairs of occurrences whose
    bytes overlap. With both tokenizers' ends in one line, each stretch
    between neighbouring ends lies in one token of either, and a pair that
    overlaps does so in one stretch: links are the distinct ends, and groups
    the ends that both have."""

    def __init__(self, a_path: str | None, b_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if a_path is None or b_path is None:
            import public_tokenizers

            a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
            b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_unit = self.words_stand_alone(pieces)
        self.a_width, self.b_width = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        named = lambda n, last: np.array([f"{i}{end}" for end in (",", last) for i in range(n)], object)
        self.a_names, self.b_names = named(len(self.a_bytes), "|"), named(len(self.b_bytes), ";")
        self.clear()

    def words_stand_alone(self, pieces: list[str]) -> bool:
        """Whether units have the tokens that they have in a text: the files
        are looked at for what cuts them there. No piece of b goes on over the
        start of a word, and a is the plain byte-level kind."""
        spec = json.loads(self.a.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        kept = b"".join(map(self.b_bytes.__getitem__, self.b.encode("a  b"))) == b" a  b"
        return bool(plain and kept and not any("▁" in p.lstrip("▁") for p in pieces))

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((0, 4), np.int64)  # tokens of a and b, groups, links
        self.bad = np.zeros(0, bool)
        self.keys = Ragged(np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.texts: list[str] = []
        self.counted = np.zeros((0, 2), np.int64)  # links of the highest count, sum of counts
        self.chars = 0

    def ids(self, found: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a, of b, and their numbers by unit (`raw`: their bytes, with
        the space before). For a, units are joined
        to one text, which is several times faster than one by one; their
        bytes tell them apart again."""
        b = self.b.encode(found, num_threads=1)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        width = np.fromiter(map(len, raw), np.int64, len(found))
        parts, sizes = [], np.zeros(len(found), np.int64)
        lo = 0
        while lo < len(found):
            hi = lo + 1
            while hi < len(found) and hi < lo + 2000 and not found[hi - 1][-1:].isspace():  # nothing may follow white space
                hi += 1
            text = " " + " ".join(found[lo:hi])
            a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            upto = np.concatenate([[0], np.cumsum(self.a_width[a])])
            at = np.searchsorted(upto, np.concatenate([[0], np.cumsum(width[lo:hi])]))
            if at[-1] >= len(upto) or (upto[at[1:]] != np.cumsum(width[lo:hi])).any() or len(a) != at[-1]:
                own = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + u for u in found[lo:hi]], add_special_tokens=False)]
                a, at = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            parts.append(a)
            sizes[lo:hi] = np.diff(at)
            lo = hi
        return np.concatenate(parts), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum())), sizes, n_b

    def learn(self, found: list[str], counts: PairCounts | None) -> None:
        raw = [b" " + u.encode() for u in found]
        a, b, n_a, n_b = self.ids(found, raw)
        wanted = b"".join(raw)
        whole = [b"".join(map(t.__getitem__, x.tolist())) for t, x in ((self.a_bytes, a), (self.b_bytes, b))]
        bad = np.zeros(len(found), bool)
        ends_a, ends_b = np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b])
        if whole != [wanted, wanted]:  # unit by unit
            for width, n, text in ((ends_a, n_a, whole[0]), (ends_b, n_b, whole[1])):
                upto = np.concatenate([[0], width])[np.cumsum(n)]
                first = 0
                for i, (u, end) in enumerate(zip(raw, upto.tolist(), strict=True)):
                    bad[i] |= text[first:end] != u
                    first = end
            a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
            n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
            ends_a, ends_b = np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b])
        mark = np.zeros(max(ends_a[-1:].sum(), ends_b[-1:].sum()) + 1, bool)
        mark[ends_a], mark[ends_b] = True, True
        ends = np.flatnonzero(mark)
        ia, ib = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        unit = np.repeat(np.arange(len(found)), n_a)[ia]
        both = (ends_a[ia] == ends) & (ends_b[ib] == ends)
        keys = a[ia] << 32 | b[ib]
        n_links, n_groups = (np.bincount(x, minlength=len(found)) for x in (unit, unit[both]))
        self.index.update(zip(found, range(len(self.bad), len(self.bad) + len(found)), strict=True))
        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.bad = np.concatenate([self.bad, bad])
        self.keys = self.keys.add(Ragged(keys, n_links))
        self.chars += sum(map(len, found))
        if counts is None:
            return
        distinct, back = np.unique(keys, return_inverse=True)
        n = counts.lookup(distinct)
        best = n == counts.best[distinct >> 32]
        bounds = np.concatenate([[0], np.cumsum(n_links)])  # a unit's links stand together
        add = [np.diff(np.concatenate([[0], np.cumsum(x[back])])[bounds]) for x in (best, n)]
        self.counted = np.concatenate([self.counted, np.stack(add, 1).astype(np.int64)])
        # each token with what follows it, in the order of the groups
        ga, gb = np.concatenate([[0], ia[both] + 1]), np.concatenate([[0], ib[both] + 1])
        of_a, of_b = np.repeat(np.arange(len(ga) - 1), np.diff(ga)), np.repeat(np.arange(len(gb) - 1), np.diff(gb))
        flat = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ga[1:] - 1], last_b[gb[1:] - 1] = True, True
        flat[np.arange(len(a)) + gb[of_a]] = self.a_names[a + len(self.a_bytes) * last_a]
        flat[np.arange(len(b)) + ga[of_b + 1]] = self.b_names[b + len(self.b_bytes) * last_b]
        flat, upto = flat.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.texts += ["".join(flat[x:y])[:-1] for x, y in zip(upto[:-1], upto[1:], strict=True)]

    def places(self, texts: list[str | None], counts: PairCounts | None) -> list[np.ndarray]:
        """Where the memo has the units of each text. A text with a unit whose
        tokens do not give its bytes back is one unit of its own."""
        if len(self.index) > MEMO_UNITS or self.chars > MEMO_CHARS:
            self.clear()
        collects = gc.isenabled()
        gc.disable()  # a list for each unit and no cycles: the collector would walk them in vain
        try:
            return self._places(texts, counts)
        finally:
            if collects:
                gc.enable()

    def _places(self, texts: list[str | None], counts: PairCounts | None) -> list[np.ndarray]:
        words = [units(t or "") if self.by_unit else [t] if t else [] for t in texts]
        for again in (False, True):
            flat = list(chain.from_iterable(words))
            missed = [u for u in dict.fromkeys(flat) if u not in self.index]
            if missed:
                self.learn(missed, counts)
            found = map(self.index.__getitem__, flat)
            size = np.fromiter(map(len, words), np.int64, len(words))
            out = np.split(np.fromiter(found, np.int64, len(flat)), np.cumsum(size)[:-1]) if words else []
            odd = [i for i, at in enumerate(out) if len(at) > 1 and self.bad[at].any()]
            if again or not odd:
                return out
            for i in odd:
                words[i] = [texts[i]]
        raise AssertionError

    def pieces(self, text: str) -> Iterator[str]:
        """A very long text by pieces whose tokens are those of the whole."""
        at = 0
        if self.by_unit:
            while (cut := _CUT.search(text, at + CHUNK_CHARS)) is not None:
                yield text[at : cut.start()]
                at = cut.end()
        yield text[at:]


@lru_cache(maxsize=2)
def aligner(a_path: str | None, b_path: str | None, owner: str) -> Aligner:
    """One for each Python worker and use, kept between its tasks."""
    return Aligner(a_path, b_path)


def _store(uri: str):
    """File system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@lru_cache(maxsize=4096)
def _mapped(uri: str, n: int) -> np.ndarray:
    """A shard's numbers: a memory map where the shared folder is mounted;
    from another store they are read."""
    from pyarrow import fs

    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, "<i8", "r", shape=(n,))
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), "<i8")


@dataclass
class PairCounts:
    """How many documents hold each pair, in sorted shards of the shared
    folder; `best` has the highest count of each id of the first vocabulary."""

    folder: str
    shards: list[tuple[int, int, str]]  # first key, keys, name
    best: np.ndarray

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, 0 where a pair is in no document."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys, [s[0] for s in self.shards]).tolist() + [len(keys)]
        for (_, n, name), lo, hi in zip(self.shards, cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                known, counts = (_mapped(f"{self.folder}/{kind}-{name}", n) for kind in ("keys", "counts"))
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), n - 1)
                out[lo:hi] = np.where(known[at] == keys[lo:hi], counts[at], 0)
        return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return distinct, total


def _partial_counts(texts: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """(key, n): the documents of one task that hold each pair."""

    def document_keys(al: Aligner, part: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        at = al.places(part, None)
        size = np.fromiter(map(len, at), np.int64, len(at))
        doc, unit = np.repeat(np.arange(len(at)), size), np.concatenate([*at, np.zeros(0, np.int64)])
        pairs = np.unique(doc * len(al.bad) + unit)  # each unit once a document
        doc, unit = np.divmod(pairs, max(1, len(al.bad)))
        doc, keys = np.repeat(doc, al.keys.size[unit]), al.keys.take(unit)
        distinct, back = np.unique(keys, return_inverse=True)
        held = np.unique(doc * max(1, len(distinct)) + back)
        return distinct, np.bincount(held % max(1, len(distinct)), minlength=len(distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, "")
        keys, counts, waiting = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            if keys:
                k, n = _summed(keys, counts)
                for lo in range(0, len(k), 500_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + 500_000]), pa.array(n[lo : lo + 500_000])], ["key", "n"])

        for b in batches:
            column = b.column(0).to_pylist()
            for lo, hi in in_chunks(column, alone=True):
                part = column[lo:hi]
                if hi - lo == 1 and len(part[0] or "") > 2 * CHUNK_CHARS:
                    found = [document_keys(al, [p])[0] for p in al.pieces(part[0])] if _whole(al, part[0]) else []
                    k = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
                    n = np.ones(len(k), np.int64)
                else:
                    k, n = document_keys(al, part)
                keys.append(k)
                counts.append(n)
                waiting += len(k)
                if waiting > PARTIAL_KEYS:
                    k, n = _summed(keys, counts)
                    keys, counts, waiting = [k], [n], len(k)
                    if waiting > PARTIAL_KEYS // 2:
                        yield from rows()
                        keys, counts, waiting = [], [], 0
        yield from rows()

    return texts.mapInArrow(run, "key long, n long")


def _whole(al: Aligner, text: str) -> bool:
    """Whether all pieces of a very long text give their bytes back."""
    return not any(al.bad[at].any() for p in al.pieces(text) for at in al.places([p], None))


def pair_counts(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> PairCounts:
    """In how many rows each pair of ids is linked, as sorted shards.

    Tasks add up their own documents' packed keys with np.unique; the partial
    counts are written, dealt by range of the key and sorted, and each range
    sums runs of equal keys into one shard (a file of keys, one of counts) in
    the shared folder. A file is named by the attempt that wrote it and known
    through its committed row only. To the driver come one row a shard and
    one number for each id of the first vocabulary.

    Null and empty texts, and those whose tokens do not give the text back,
    hold no pairs. Rows count one by one. An empty table gives no shards."""
    spark = docs.sparkSession
    partial = write_table(_partial_counts(docs.select(F.col(text_col).alias("text")), a_path, b_path), "pairs")
    folder = scratch_path(spark, "pair-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, first, n = uuid.uuid4().hex, None, 0
        best_a, best_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with store.open_output_stream(f"{path}/keys-{name}") as keys_out, store.open_output_stream(f"{path}/counts-{name}") as counts_out:
            held_k, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

            def put(k: np.ndarray, c: np.ndarray) -> None:
                keys_out.write(k.astype("<i8").tobytes())
                counts_out.write(c.astype("<i8").tobytes())
                if len(k):
                    a = k >> 32
                    new = np.flatnonzero(np.diff(a, prepend=-1))
                    best_a.append(a[new])
                    best_n.append(np.maximum.reduceat(c, new))

            for b in batches:
                k, c = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate((held_k, held_n)))
                new = np.flatnonzero(np.diff(k, prepend=-1))
                if len(new):
                    k, c = k[new], np.add.reduceat(c, new)
                    first = int(k[0]) if first is None else first
                    put(k[:-1], c[:-1])
                    n += len(k) - 1
                    held_k, held_n = k[-1:], c[-1:]  # the next batch may go on with it
            put(held_k, held_n)
            n += len(held_k)
        if n:
            a, back = np.unique(np.concatenate(best_a), return_inverse=True)
            most = np.zeros(len(a), np.int64)
            np.maximum.at(most, back, np.concatenate(best_n))
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "n": [n]}, schema=pa.schema([("name", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.string()), pa.array(a), pa.array(most)], ["name", "first", "n"])

    dealt = partial.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    made = write_table(dealt.mapInArrow(write, "name string, first long, n long"), "shards")
    shards = sorted((r[0], r[1], r[2]) for r in made.where("name IS NOT NULL").select("first", "n", "name").collect())
    best = made.where("name IS NULL").groupBy("first").agg(F.max("n").alias("n")).collect()  # one number an id of the vocabulary
    most = np.zeros(max((r[0] for r in best), default=-1) + 1, np.int64)
    for a, n in best:
        most[a] = n
    return PairCounts(folder, shards, most)


def align(docs: DataFrame, counts: PairCounts, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: id, n_a, n_b (tokens), n_groups, n_links, n_best
    (links whose pair has the highest count of its first id), count_sum (of
    the links' counts) and groups, as `a1,a2|b1;a3|b2,b3`.

    Counts are looked up by binary search in the shards, once for each unit
    of text that a task has not seen. Documents without tokens (see
    `pair_counts`) have zeros and empty groups; repeated rows and null ids
    stay rows; other columns are left out; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__q_text"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names) + ", groups string"

    def summary(al: Aligner, at: np.ndarray) -> tuple[np.ndarray, str]:
        if not len(at) or al.bad[at].any():
            return np.zeros(6, np.int64), ""
        return np.concatenate([al.sums[at].sum(0), al.counted[at].sum(0)]), ";".join(map(al.texts.__getitem__, at.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, counts.folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in in_chunks(texts, alone=True):
                part = texts[lo:hi]
                if hi - lo == 1 and len(part[0] or "") > 2 * CHUNK_CHARS:
                    found = []
                    if _whole(aligner(a_path, b_path, ""), part[0]):
                        by_piece = [summary(al, al.places([p], counts)[0]) for p in al.pieces(part[0])]
                        found = [(sum(x[0] for x in by_piece), ";".join(x[1] for x in by_piece))]
                    found = found or [(np.zeros(6, np.int64), "")]
                else:
                    found = [summary(al, at) for at in al.places(part, counts)]
                numbers = np.stack([x[0] for x in found])
                columns = [b.column(0).slice(lo, hi - lo), *[pa.array(numbers[:, i]) for i in range(6)], pa.array([x[1] for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names, "groups"])

    return rows.mapInArrow(run, schema)


def alignment_digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, its groups as their SHA-256."""
    out = align(docs, pair_counts(docs))
    hashed = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed.alias("groups_sha256"))
