"""Packing token ids into sequences: vector bin packing by dot products."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 characters that are encoded at once; bounds a task's word lists.
CHUNK_CHARS = 1_000_000
#: Words, and their characters, that an encoder remembers before it starts anew.
MEMO_WORDS, MEMO_CHARS = 400_000, 16_000_000
#: Rows whose texts a task holds as Python strings at once.
BATCH_ROWS = 1_000
#: Tokens that wait in a task for a partner; bounds its memory.
WINDOW_TOKENS = 500_000

PIECE_SCHEMA = (
    "doc_id {id}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
)


#: How a tokenizer file must treat its text for words to be encoded apart:
#: white space is dropped, letters are lower-cased, words end in </w>.
_SPACE_DROPPED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = {"pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


_MARK = "\ue000"


def keeps_words_apart(spec: dict) -> bool:
    normalizer, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = pre.get("pretokenizers") or [{}, {}]
    return (
        normalizer.get("normalizers") == _SPACE_DROPPED and len(steps) == 2 and steps[0] == {"type": "Split", **_WORDS}
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
        and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
    )


class WordEncoder:
    """Token ids of whole texts, through a memo of blank-separated words.

    The tokenizer drops white space and no token, merge or pattern spans it
    (the file is looked at for that; one of another kind encodes whole texts,
    without a memo), so a text's ids are those of its words in order. Only
    blanks and line feeds are cut at here; any other white space stays inside
    a word and is left to the tokenizer.
    """

    def __init__(self, path: str | None, memo_words: int = MEMO_WORDS):
        self.most, self.most_chars = memo_words, MEMO_CHARS * memo_words // MEMO_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = keeps_words_apart(json.loads(self.tokenizer.to_str()))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # one character a byte, besides the mark of a word's end
            self.width[i] = len(token.removesuffix("</w>"))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.chars = 0

    def forget(self) -> None:
        """Keep the words that came again since the last time."""
        words, again = list(self.index), np.flatnonzero(self.used >= 2)
        if len(again) > self.most // 2 or self.chars > 2 * self.most_chars:
            self.clear()
            return
        ids = [self.ids[a : a + n] for a, n in zip(self.first[again], self.size[again], strict=True)]
        kept, size = [words[i] for i in again], self.size[again]
        self.clear()
        self.store(kept, np.concatenate([self.ids, *ids]), size)

    def store(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.chars += sum(map(len, words))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places of the memo, and where each ends."""
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        return self.ids[np.repeat(self.first[at], size) + within], upto

    def learn(self, words: list[str]) -> None:
        """Learn new words. One in capitals, or with a full stop or comma
        after a letter or digit, is made of known parts; the rest is encoded."""
        known = self.index
        made, stems, tails, whole = [], [], [], []
        for w in words:
            stem = w.lower() if w.isascii() and "|" not in w else w
            if stem[-1:] in (".", ",") and stem[-2:-1].isalnum() and stem.isascii():
                tails.append(stem[-1])
                stem = stem[:-1]
            elif stem == w:
                whole.append(w)
                continue
            else:
                tails.append("")
            made.append(w)
            stems.append(stem)
        self.encode_new([k for k in dict.fromkeys([*whole, *stems, ".", ",", ""]) if k not in known])
        if made:  # a word of the list may also be the stem of another
            both = [x for w, s, t in zip(made, stems, tails, strict=True) if w not in known for x in (s, t)]
            made = [w for w in made if w not in known]
            ids, upto = self.gather(np.fromiter(map(known.__getitem__, both), np.int64, len(both)))
            self.store(made, ids, np.diff(upto[::2]))

    def encode_new(self, words: list[str]) -> None:
        """Encode words joined by blanks in one text, which is several times
        faster than one by one. Every token stands for some bytes of the
        normalised text, and together a word's tokens for all its bytes; so
        running byte lengths find the words' tokens. Words with a special
        token's text are encoded alone."""
        odd = [w for w in words if "<|" in w]
        plain = [w for w in words if "<|" not in w]
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            width = self.normal_bytes(part)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            upto = np.concatenate([[0], np.cumsum(self.width[ids])])
            at = np.searchsorted(upto, np.concatenate([[0], np.cumsum(width)]))
            if upto[at[-1]] != upto[-1] or (upto[at[1:]] != np.cumsum(width)).any():
                raise ValueError("the tokens of a text do not add up to its bytes")
            self.store(part, ids, np.diff(at))
        if odd:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            self.store(odd, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def normal_bytes(self, words: list[str]) -> np.ndarray:
        """UTF-8 bytes of each word as normalised, without white space. Other
        than printable ASCII is normalised in one text, apart by a mark that
        no rule touches."""
        width = np.fromiter(map(len, words), np.int64, len(words))
        odd = [i for i, w in enumerate(words) if not (w.isascii() and w.isprintable())]
        normal, texts = self.tokenizer.normalizer.normalize_str, [words[i] for i in odd]
        found = normal(_MARK.join(texts)).replace(" ", "").split(_MARK)
        if len(found) != len(odd):  # a word has the mark
            found = [normal(t).replace(" ", "") for t in texts]
        if odd:
            width[odd] = [len(t.encode()) for t in found]
        return width

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if any(len(t or "") > 2 * CHUNK_CHARS for t in texts):  # very long ones by pieces
            return [np.concatenate([self.encode_words([p])[0] for p in blank_pieces(t or "", CHUNK_CHARS)]) for t in texts]
        return self.encode_words(texts)

    def encode_words(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.most or self.chars > self.most_chars:
            self.forget()
        words: list[str] = []
        ends = []
        for t in texts:
            if t:
                words += t.replace("\n", " ").split(" ")
            ends.append(len(words))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(at < 0)
        if len(missed):
            self.learn(list(dict.fromkeys(words[i] for i in missed)))
            at[missed] = [self.index[words[i]] for i in missed]
        self.used += np.bincount(at, minlength=len(self.used))
        ids, upto = self.gather(at)
        bounds = upto[np.array([0, *ends], np.int64)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def blank_pieces(text: str, most: int) -> Iterator[str]:
    """A text in pieces of about `most` characters, cut before blanks and line
    feeds; without any of these it stays whole."""
    at = 0
    while len(text) - at > 2 * most:
        ends = [e for e in (text.find(c, at + most) for c in " \n") if e >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


_encoders: dict[tuple[str | None, int], WordEncoder] = {}


def encoder(path: str | None, memo_words: int = MEMO_WORDS) -> WordEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    if (path, memo_words) not in _encoders:
        _encoders[path, memo_words] = WordEncoder(path, memo_words)
    return _encoders[path, memo_words]


def in_chunks(texts: list[str | None], most: int = CHUNK_CHARS, alone: bool = False) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a text is never cut. With
    `alone`, a longer one is a range of its own."""
    first = chars = 0
    for i, t in enumerate(texts):
        if alone and len(t or "") >= most and first < i:
            yield first, i
            first, chars = i, 0
        chars += len(t or "") + 1
        if chars >= most:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Packer:
    """Fills one sequence at a time with the waiting example whose demand has
    the largest dot product with the room left (tokens, segments,
    loss-bearing tokens). Where none fits whole, an example is cut to fill
    the sequence, if cutting is allowed.

    Examples of one demand wait in one bucket, (tokens, tokens before the
    loss), so a placement costs a look at each different demand."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, first_id: int):
        self.room = (max_tokens, max_segments, max_loss)
        self.cut, self.next_id = cut, first_id
        self.buckets: dict[tuple[int, int], list[tuple]] = {}  # of (doc, ids, start)
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray, loss_from: int) -> None:
        n, start = len(ids), 0
        whole, _, loss = self.room
        if not self.cut and (n > whole or n - loss_from > loss):
            raise ValueError(f"an example of {n} tokens exceeds a limit and may not be cut")
        while self.cut and n - start >= whole and whole - min(whole, max(0, loss_from - start)) <= loss:
            self.place((doc, ids, start), whole, min(whole, max(0, loss_from - start)), self.next_id, 0)
            self.next_id += 1
            start += whole
        if n > start or n == 0:
            self.wait((doc, ids, start), n - start, min(n - start, max(0, loss_from - start)))

    def wait(self, item: tuple, length: int, free: int) -> None:
        self.buckets.setdefault((length, free), []).append(item)
        self.tokens += length

    def place(self, item: tuple, length: int, free: int, sequence: int, offset: int) -> None:
        doc, ids, start = item
        self.out.append((doc, start, length, ids[start : start + length].tobytes(), len(ids), length - free, sequence, offset))

    def fill(self, last: bool) -> None:
        """Pack what waits; unless it is the last call, keep what does not
        fill a sequence for a later partner."""
        whole, segments, most_loss = self.room
        keys = list(self.buckets)
        size, free = np.array(keys, np.float64).reshape(-1, 2).T.copy()  # of an empty bucket: infinite, none
        loss = size - free
        room_weight, loss_weight = size / max(whole, 1) ** 2, loss / max(most_loss, 1) ** 2
        while self.buckets and (last or self.tokens >= 2 * whole):
            room, seats, bears, offset = whole, segments, most_loss, 0
            while seats > 0 and self.buckets:
                score = room_weight * room + loss_weight * bears
                score[(size > room) | (loss > bears)] = -1.0
                at = int(score.argmax())
                if score[at] >= 0:
                    length, part = keys[at]
                elif self.cut and room > 0:
                    most = np.minimum(np.minimum(size, room), free + bears)
                    at = int(most.argmax())
                    length = int(max(0, most[at]))
                    if length < 1:
                        break
                    part = min(length, keys[at][1])  # its tokens that bear no loss come first
                else:
                    break
                key = keys[at]
                own = self.buckets[key]
                item = own.pop()
                if not own:
                    del self.buckets[key]
                    size[at] = loss[at] = np.inf
                    free[at] = -np.inf
                self.tokens -= key[0]
                self.place(item, length, part, self.next_id, offset)
                if length < key[0]:
                    rest = key[0] - length, key[1] - part
                    if rest not in self.buckets:
                        keys.append(rest)
                        size, free, loss = (np.append(x, v) for x, v in ((size, rest[0]), (free, rest[1]), (loss, rest[0] - rest[1])))
                        room_weight = np.append(room_weight, rest[0] / max(whole, 1) ** 2)
                        loss_weight = np.append(loss_weight, (rest[0] - rest[1]) / max(most_loss, 1) ** 2)
                    self.wait((item[0], item[1], item[2] + length), *rest)
                room, seats, bears, offset = room - length, seats - 1, bears - (length - part), offset + length
            self.next_id += 1

    def flush(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_examples(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    max_tokens: int = 4096,
    max_segments: int = 4096,
    max_loss: int = 4096,
    cut: bool = True,
    prompt_tokens: int = 0,
    memo_words: int = MEMO_WORDS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit, binary), doc_tokens, loss_tokens, sequence_id, offset.

    Each task encodes its own rows and packs them (texts are not shuffled;
    sequences never span tasks, so a task leaves one sequence with padding
    and a lost one is made again alone). At most WINDOW_TOKENS wait in it.
    `loss_from_col` is the place of the first loss-bearing token of each
    example; where it is null or not named, that is `prompt_tokens`, but a
    quarter of the example at most. tokenizer_path None is the public
    word_bpe_49k; any other tokenizer file is used as it is. An encoder remembers
    `memo_words` words: fewer take less memory and more time.

    Null and empty texts are the end id alone. Repeated rows are packed one
    by one, a null id is kept. Other columns are left out. An empty table
    gives no pieces. With cut=False an example beyond a limit is an error.
    """
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    loss = F.col(loss_from_col) if loss_from_col else F.lit(None)
    rows = docs.select(*cols, loss.cast("long").alias("loss_from"))
    schema = PIECE_SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, memo_words)
        packer = Packer(max_tokens, max_segments, max_loss, cut, TaskContext.get().partitionId() << 33)
        kind = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*packer.flush(), strict=True)) or [[]] * 8
            types = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        end = np.array([end_id], np.uint32)
        for b in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            kind = b.column(0).type
            ids, texts, starts = (b.column(i).to_pylist() for i in range(3))
            for lo, hi in in_chunks(texts):
                for doc, tokens, loss_from in zip(ids[lo:hi], enc.encode(texts[lo:hi]), starts[lo:hi], strict=True):
                    tokens = np.concatenate([tokens, end])
                    packer.add(doc, tokens, min(prompt_tokens, len(tokens) // 4) if loss_from is None else loss_from)
                if packer.tokens >= WINDOW_TOKENS:
                    packer.fill(last=False)
                if len(packer.out) >= 2000:
                    yield batch()
        if kind is not None:
            packer.fill(last=True)
            yield batch()
        enc.forget()  # what came once; the worker may go on to other work

    return rows.mapInArrow(pack, schema)


#: The query's examples: the first tokens of a document are its prompt, and a
#: sequence has that many tokens less of loss than of length.
PROMPT_TOKENS = 64


def pack_digest(docs: DataFrame) -> DataFrame:
    out = pack_examples(docs, prompt_tokens=PROMPT_TOKENS, max_loss=4096 - PROMPT_TOKENS)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
