"""Token ids as compressed blocks: context mixing and a range coder.

A block is a number of ids coded by itself: its model starts anew, its bytes
carry a checksum, and so do the ids of each document in it. Since blocks know
nothing of each other, a task codes thousands side by side, one id of each in
a step; every number below is an array over such lanes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import partitions, write_table
from .packing import encoder, in_chunks

#: Ids of a block, and blocks that a task codes side by side (about 100 kB each).
BLOCK_IDS, LANES = 4096, 3072
#: Bits of the slots that find an id in the list, and of the order-1 and order-2 tables.
SLOTS_0, SLOTS_1, SLOTS_2 = 13, 11, 12
#: Parts of the probability scale; what every outcome has of it at least.
SCALE_BITS, LEAST = 12, 6
#: How fast probabilities follow, what they stay above, and the least weight of a predictor.
RATE, FLOOR, LEAST_WEIGHT = 0.06, 0.002, 0.02
#: What a coded class of ranks gains; a block's gains stay below 2 ** 16.
GAIN = 8
#: Ids are below this: a slot holds an id and two bits of confidence.
MOST_ID = 1 << 30

_HEADER = struct.Struct("<4sIIIIQQIBI")
_MAGIC = b"QTB1"
_FULL, _LOW = np.uint64(2**64 - 1), np.uint64(1 << 48)
#: Confidence after a miss, then after a hit.
_AFTER = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.uint32)
_SLOTS = (1 << SLOTS_1) + (1 << SLOTS_2)
#: Classes of ranks, by their bits, and steps between two sums of their counts.
_CLASSES, _REST = 16, 16


class Mixer:
    """The model of each lane: three predictors of the next id.

    Order 2 and order 1 name the id that last followed the last two ids, or
    the last one, with a confidence of 0 to 3. Order 0 is the list of ids
    seen so far; one that is coded by it moves halfway to the front. An id is
    what order 2 names (outcome 0), else what order 1 names (1), else in the
    list (2), else new (3). Each predictor has its own probabilities of the
    four outcomes in its state, learned as it goes, and they are mixed by
    weights that follow how well each did. Only +, - and * and one division
    are used on single floats, in one order, so that all machines agree.

    Four probabilities are 16 bytes and are moved as one number."""

    def __init__(self, lanes: int, most: int):
        self.most = most
        self.lane = np.arange(lanes)
        self.q = np.tile(np.array([0.1, 0.1, 0.5, 0.3], np.float32), (lanes * 16, 1)).view(np.complex128)[:, 0]
        self.w = np.full((3, lanes), 1 / 3, np.float32)
        # a lane's slots of order 1, then those of order 2
        self.slots = np.zeros(lanes * _SLOTS, np.uint32)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.outcome = np.full(lanes, 3)
        self.order = np.zeros(lanes * most, np.uint32)
        self.size = np.zeros(lanes, np.int64)
        self.counts = np.ones((lanes, _CLASSES), np.int64)
        self.classes = np.zeros((lanes, _CLASSES + 1), np.int64)  # running sums, renewed now and then
        self.step = 0

    def predict(self, k: int) -> np.ndarray:
        """Where each outcome of the first k lanes begins on the scale, (5, k)."""
        if self.step % _REST == 0:
            np.cumsum(self.counts[:k], 1, out=self.classes[:k, 1:])
        self.step += 1
        lane, last = self.lane[:k], self.last[:k]
        self.at = np.empty((2, k), np.int64)
        np.bitwise_and(last * 0x9E3779B1 >> 13, (1 << SLOTS_1) - 1, out=self.at[0])
        np.bitwise_and((last * 0x85EBCA6B ^ self.before[:k] * 0xC2B2AE35) >> 12, (1 << SLOTS_2) - 1, out=self.at[1])
        self.at[1] += 1 << SLOTS_1
        self.at += lane * _SLOTS
        held = self.slots.take(self.at)
        self.sure, self.named = held & 3, held >> 2
        self.rows = np.empty((3, k), np.int64)
        self.rows[0] = self.sure[1]
        np.add(self.sure[0], (self.named[0] == self.named[1]) << 2, out=self.rows[1])
        self.rows[1] += 4
        np.add(self.outcome[:k], 12, out=self.rows[2])
        self.rows += lane << 4
        self.own = self.q.take(self.rows).view(np.float32).reshape(3, k, 4)
        w, cum = self.w[:, :k], np.zeros((5, k), np.int64)
        for j in range(3):
            part = self.own[:, :, j] * w
            p = part[0] + part[1]
            p += part[2]
            p *= np.float32((1 << SCALE_BITS) - 4 * LEAST)
            np.add(cum[j], p.astype(np.int64), out=cum[j + 1])
            cum[j + 1] += LEAST
        cum[4] = 1 << SCALE_BITS
        return cum

    def update(self, k: int, outcome: np.ndarray, ids: np.ndarray) -> None:
        at = (self.lane[:k] << 2) + outcome + np.arange(3)[:, None] * (4 * k)
        flat = self.own.reshape(-1)
        good = flat.take(at)
        w = self.w[:, :k]
        w *= good
        w *= np.float32(1 - 3 * LEAST_WEIGHT) / (w[0] + w[1] + w[2])
        w += np.float32(LEAST_WEIGHT)
        flat *= np.float32(1 - RATE)
        flat += np.float32(RATE * FLOOR)
        good *= np.float32(1 - RATE)
        good += np.float32(RATE * (1 - 3 * FLOOR))
        flat[at] = good
        self.q[self.rows] = self.own.view(np.complex128)[..., 0]
        new = ids.astype(np.uint32)
        hit = (self.named == new) & (self.sure > 0)
        kept = np.where(hit | (self.sure > 1), self.named, new)
        self.slots[self.at] = kept << 2 | _AFTER.take(self.sure + (hit << 2))
        self.before[:k], self.last[:k], self.outcome[:k] = self.last[:k], ids, outcome

    def advance(self, lanes: np.ndarray, ranks: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Ids at these ranks move halfway to the front; returns what stood there."""
        self.counts.reshape(-1)[lanes * _CLASSES + classes] += GAIN
        first = lanes * self.most
        here, there = first + ranks, first + (ranks >> 1)
        other, own = self.order.take(there), self.order.take(here)
        self.order[here], self.order[there] = other, own
        return other

    def append(self, lanes: np.ndarray, ids: np.ndarray) -> None:
        self.order[lanes * self.most + self.size[lanes]] = ids
        self.size[lanes] += 1


def _by_length(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from the longest block down, and how many take part in each step."""
    order = np.argsort(-np.array(lengths, np.int64), kind="stable")
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(max(lengths, default=0)), "right")
    return order, alive


_CLASS_OF = np.frexp(np.arange(1 << 16).astype(np.float64))[1].astype(np.int64) - 1  # of rank + 1: its bits, less one


def code(blocks: list[np.ndarray], bound: int) -> list[bytes]:
    """The blocks' ids, all below `bound`, each as 16-bit words."""
    lanes = len(blocks)
    order, alive = _by_length([len(b) for b in blocks])
    most = max(1, len(alive))
    model = Mixer(lanes, most)
    ids = np.zeros((most, lanes), np.uint32)
    for lane, at in enumerate(order):
        ids[: len(blocks[at]), lane] = blocks[at]
    place = np.zeros(lanes << SLOTS_0, np.uint16)  # of an id in the list, by a hash; one that is lost counts as new
    wide = bound > 1 << 16
    width = most * (4 if wide else 3) + 8
    out, end = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    for step, k in enumerate(alive.tolist()):
        own = ids[step, :k].astype(np.int64)
        cum = model.predict(k)
        named = (model.named == ids[step, :k]) & (model.sure > 0)
        outcome = np.where(named[1], 0, np.where(named[0], 1, 3))
        rest = np.flatnonzero(outcome == 3)
        hashed = (rest << SLOTS_0) + ((own[rest] * 0x9E3779B1 >> 15) & ((1 << SLOTS_0) - 1))
        rank = place[hashed].astype(np.int64)
        seen = (rank < model.size[rest]) & (model.order[rest * most + rank] == own[rest])
        outcome[rest[seen]] = 2
        at = outcome * k + model.lane[:k]
        flat = cum.reshape(-1)
        begin = flat.take(at)
        r = rng[:k] >> SCALE_BITS
        add = r * begin.astype(np.uint64)
        now = r * (flat.take(at + k) - begin).astype(np.uint64)
        old, rank = rest[seen], rank[seen]
        if len(old):
            v = rank + 1
            c = _CLASS_OF[v]
            row = model.classes.reshape(-1)
            first = old * (_CLASSES + 1)
            begin = row[first + c]
            r = now[old] // row[first + _CLASSES].astype(np.uint64)
            plus = r * begin.astype(np.uint64)
            r = r * (row[first + c + 1] - begin).astype(np.uint64) >> c.astype(np.uint64)
            add[old] += plus + r * (v - (1 << c)).astype(np.uint64)
            now[old] = r
            moved = model.advance(old, rank, c)
            place[hashed[seen]] = rank >> 1
            other = (old << SLOTS_0) + ((moved.astype(np.int64) * 0x9E3779B1 >> 15) & ((1 << SLOTS_0) - 1))
            up = rank > 0
            place[other[up]] = rank[up]
        new = rest[~seen]
        if len(new):
            v = own[new].astype(np.uint64)
            r = now[new]
            if wide:
                r = r // np.uint64((bound - 1 >> 16) + 1)
                add[new] += r * (v >> 16)
                r >>= 16
                v &= 0xFFFF
            else:
                r = r // np.uint64(bound)
            add[new] += r * v
            now[new] = r
            place[hashed[~seen]] = model.size[new]
            model.append(new, own[new])
        model.update(k, outcome, own)
        sum_ = low[:k] + add
        words = end[np.flatnonzero(sum_ < add)] - 1
        while len(words):  # one more in the word before, and on through words of all ones
            out[words] += 1
            words = words[out[words] == 0] - 1
        low[:k], rng[:k] = sum_, now
        short = np.flatnonzero(rng[:k] < _LOW)
        while len(short):
            out[end[short]] = low[short] >> 48
            end[short] += 1
            low[short] <<= 16
            rng[short] <<= 16
            short = short[rng[short] < _LOW]
    for shift in (48, 32, 16, 0):
        out[end] = (low >> shift) & 0xFFFF
        end += 1
    found = [b""] * lanes
    for lane, at in enumerate(order):
        found[at] = out[lane * width : end[lane]].astype("<u2").tobytes()
    return found


def decode(payloads: list[bytes], lengths: list[int], bound: int) -> list[np.ndarray]:
    """The ids of each block again."""
    lanes = len(payloads)
    order, alive = _by_length(lengths)
    most = max(1, len(alive))
    model = Mixer(lanes, most)
    ids = np.zeros((most, lanes), np.uint32)
    wide = bound > 1 << 16
    sizes = np.array([len(payloads[at]) // 2 for at in order], np.int64)
    words = np.concatenate([np.frombuffer(b"".join(payloads[at] for at in order), "<u2"), np.zeros(4, "<u2")]).astype(np.uint64)
    end = np.cumsum(sizes) - sizes
    d, rng = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    for _ in range(4):
        d = d << 16 | words[end]
        end += 1
    for step, k in enumerate(alive.tolist()):
        cum = model.predict(k)
        r = rng[:k] >> SCALE_BITS
        t = (d[:k] // r).astype(np.int64)
        outcome = (t >= cum[1]).astype(np.int64)
        outcome += t >= cum[2]
        outcome += t >= cum[3]
        at = outcome * k + model.lane[:k]
        flat = cum.reshape(-1)
        begin = flat.take(at)
        less = r * begin.astype(np.uint64)
        now = r * (flat.take(at + k) - begin).astype(np.uint64)
        rest = d[:k] - less
        own = np.where(outcome == 0, model.named[1], model.named[0]).astype(np.int64)
        old = np.flatnonzero(outcome == 2)
        if len(old):
            row = model.classes.reshape(-1)
            first = old * (_CLASSES + 1)
            r = now[old] // row.take(first + _CLASSES).astype(np.uint64)
            t = (rest[old] // r).astype(np.int64)
            c = np.zeros(len(old), np.int64)
            for half in (8, 4, 2, 1):
                c += half * (row.take(first + c + half) <= t)
            begin = row.take(first + c)
            rest[old] -= r * begin.astype(np.uint64)
            r = r * (row.take(first + c + 1) - begin).astype(np.uint64) >> c.astype(np.uint64)
            v = rest[old] // r
            rest[old] -= r * v
            now[old] = r
            rank = v.astype(np.int64) + (1 << c) - 1
            own[old] = model.order[old * most + rank]
            model.advance(old, rank, c)
        new = np.flatnonzero(outcome == 3)
        if len(new):
            r = now[new]
            v = np.zeros(len(new), np.uint64)
            if wide:
                r = r // np.uint64((bound - 1 >> 16) + 1)
                v = rest[new] // r
                rest[new] -= r * v
                r >>= 16
                v <<= 16
            else:
                r = r // np.uint64(bound)
            low = rest[new] // r
            rest[new] -= r * low
            now[new] = r
            own[new] = v | low
            model.append(new, own[new])
        ids[step, :k] = own
        model.update(k, outcome, own)
        d[:k], rng[:k] = rest, now
        short = np.flatnonzero(now < _LOW)
        while len(short):
            d[short] = d[short] << 16 | words[end[short]]
            end[short] += 1
            rng[short] <<= 16
            short = short[rng[short] < _LOW]
    found = [np.zeros(0, np.uint32)] * lanes
    for lane, at in enumerate(order):
        found[at] = ids[: lengths[at], lane].copy()
    return found


@dataclass
class Block:
    """Ids and where documents begin and end in them. The first piece may go
    on a document of the blocks before, of which it follows `before` ids with
    the checksum `crc_before`; `open` says that the last one goes on."""

    first: int  # ids in the file before it
    ids: np.ndarray
    lengths: list[int]
    crcs: list[int]  # of a document's ids up to each piece's end
    before: int
    crc_before: int
    open: bool

    def pack(self, payload: bytes, bound: int) -> bytes:
        body = np.array([self.lengths, self.crcs], "<u4").tobytes() + payload
        head = (_MAGIC, len(self.ids), bound, len(self.lengths), len(payload), self.first, self.before, self.crc_before, self.open)
        return _HEADER.pack(*head, zlib.crc32(body, zlib.crc32(repr(head).encode()))) + body


def unpack(blocks: list[bytes]) -> list[Block]:
    """Blocks from their bytes, decoded side by side; what does not agree with
    a checksum is an error."""
    heads, payloads, out = [], [], []
    for data in blocks:
        *head, crc = _HEADER.unpack_from(data)
        body = data[_HEADER.size :]
        if head[0] != _MAGIC or zlib.crc32(body, zlib.crc32(repr((*head[:-1], bool(head[-1]))).encode())) != crc or len(body) != 8 * head[3] + head[4]:
            raise ValueError("a block of token ids is damaged")
        heads.append(head)
        payloads.append(body[8 * head[3] :])
        out.append(Block(head[5], np.zeros(0, np.uint32), *np.frombuffer(body, "<u4", 2 * head[3]).reshape(2, -1).tolist(), head[6], head[7], bool(head[8])))
    for bound in {h[2] for h in heads}:
        at = [i for i, h in enumerate(heads) if h[2] == bound]
        for i, ids in zip(at, decode([payloads[i] for i in at], [heads[i][1] for i in at], bound), strict=True):
            out[i].ids = ids
    for b in out:
        crc, lo = b.crc_before, 0
        for n, want in zip(b.lengths, b.crcs, strict=True):
            crc = zlib.crc32(b.ids[lo : lo + n].astype("<u4").tobytes(), crc)
            if crc != want:
                raise ValueError("the ids of a block do not agree with their checksum")
            crc, lo = 0, lo + n
    return out


class Writer:
    """Cuts documents that come in order into blocks of one file."""

    def __init__(self, most: int):
        self.most, self.total, self.seq = most, 0, 0
        self.ready: list[tuple[Block, list]] = []
        self.start(0, 0)

    def start(self, before: int, crc: int) -> None:
        self.parts: list[np.ndarray] = []
        self.block, self.docs, self.n = Block(self.total, None, [], [], before, crc, False), [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        done = crc = 0
        while True:
            part = ids[done : done + self.most - self.n]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            self.parts.append(part)
            self.docs.append(doc)
            self.block.lengths.append(len(part))
            self.block.crcs.append(crc)
            self.n, self.total, done = self.n + len(part), self.total + len(part), done + len(part)
            more = done < len(ids)
            if more or self.n >= self.most or len(self.docs) >= self.most:
                self.cut(done if more else 0, crc if more else 0)
            if not more:
                return

    def cut(self, before: int = 0, crc: int = 0) -> None:
        if self.docs:
            self.block.ids, self.block.open = np.concatenate(self.parts), before > 0
            self.ready.append((self.block, self.docs))
        self.start(before, crc)

    def flush(self) -> list[tuple[int, int, list, bytes]]:
        """(seq, ids, documents of the pieces, bytes) of what is ready."""
        ready, self.ready = self.ready, []
        bounds = [1 << max(8, int(b.ids.max(initial=0)).bit_length()) for b, _ in ready]
        if max(bounds, default=0) > MOST_ID:
            raise ValueError(f"an id is beyond {MOST_ID - 1}, what a block holds")
        payloads = [b""] * len(ready)
        for bound in set(bounds):
            at = [i for i, x in enumerate(bounds) if x == bound]
            for i, payload in zip(at, code([ready[i][0].ids for i in at], bound), strict=True):
                payloads[i] = payload
        first, self.seq = self.seq, self.seq + len(ready)
        return [(first + i, len(b.ids), docs, b.pack(payloads[i], bounds[i])) for i, (b, docs) in enumerate(ready)]


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Blocks of all documents' ids in ascending id order (nulls first): file,
    seq, n_ids, docs (the id of each piece's document) and data, as a table
    to write; a range of ids is one file.

    Texts are dealt by range of (id, hash of the text, place in the input),
    so that no range grows with the rows of one id, and sorted; each task
    encodes its own, in order, and codes up to LANES blocks side by side.
    Null and empty texts are the end id alone, or nothing. Repeated rows are
    written one by one. Other columns are left out; an empty table gives no
    blocks. tokenizer_path None is the public word_bpe_49k."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.monotonically_increasing_id().alias("nth")
    )
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "id", "mark", "nth").sortWithinPartitions("id", "mark", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file, writer = encoder(tokenizer_path), TaskContext.get().partitionId(), Writer(BLOCK_IDS)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        id_type = pa.null()

        def batch() -> Iterator[pa.RecordBatch]:
            found = writer.flush()
            if found:
                seq, n, names, data = zip(*found, strict=True)
                columns = [pa.array([file] * len(seq), pa.int32()), pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.list_(id_type)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "seq", "n_ids", "docs", "data"])

        for b in batches:
            id_type = b.column(0).type
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in in_chunks(texts):
                for doc, ids in zip(names[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    writer.add(doc, np.concatenate([ids, end]))
                if len(writer.ready) >= LANES:
                    yield from batch()
        writer.cut()
        yield from batch()
        enc.forget()

    return dealt.select("id", "text").mapInArrow(run, f"file int, seq long, n_ids long, docs array<{kind}>, data binary")


def read_tokens(blocks: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in the blocks: id, start (ids of
    all documents before it), piece_start and piece_ids (of the piece in its
    document), crc32 (of the document's ids up to the piece's end, as
    little-endian unsigned 32-bit integers), last (whether the document ends
    there) and, if asked for, ids.

    Blocks may come in any order: each says where it stands in its file, and
    the files' sizes (one number a file) give the rest. A damaged block is an
    error. The checksum of a document over several blocks goes on from one to
    the next; each block's is checked."""
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    schema = f"file int, `{id_col}` {kind}, start long, piece_start long, piece_ids long, crc32 long, last boolean" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.column(1).type.value_type
            for lo in range(0, b.num_rows, LANES):
                part = b.slice(lo, LANES)
                names, starts, before, n, crcs, last, ids, files = [], [], [], [], [], [], [], []
                for file, docs, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), unpack(part.column(2).to_pylist()), strict=True):
                    at = block.first
                    for i, size in enumerate(block.lengths):
                        own = block.before if i == 0 else 0
                        starts.append(at - own)
                        before.append(own)
                        if with_ids:
                            ids.append(block.ids[at - block.first : at - block.first + size].astype("<u4").tobytes())
                        at += size
                    files += [file] * len(docs)
                    names += docs
                    n += block.lengths
                    crcs += block.crcs
                    last += [True] * (len(docs) - 1) + [not block.open]
                columns = [pa.array(files, pa.int32()), pa.array(names, id_type), *(pa.array(v, pa.int64()) for v in (starts, before, n, crcs)), pa.array(last, pa.bool_())]
                names_out = ["file", id_col, "start", "piece_start", "piece_ids", "crc32", "last"]
                if with_ids:
                    columns, names_out = [*columns, pa.array(ids, pa.binary())], [*names_out, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names_out)

    pieces = blocks.select("file", "docs", "data").mapInArrow(run, schema)
    sizes = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row a file
    upto = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col("file").alias("__q_file"), upto.alias("__q_base"))
    out = pieces.join(F.broadcast(base), F.col("file") == F.col("__q_file"))
    return out.withColumn("start", F.col("start") + F.col("__q_base")).drop("file", "__q_file", "__q_base")


def token_digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, from the files as read back."""
    files = write_table(write_tokens(docs), "token-files")
    pieces = read_tokens(files, with_ids=False).where("last")
    return pieces.select("doc_id", "start", (F.col("piece_start") + F.col("piece_ids")).alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
