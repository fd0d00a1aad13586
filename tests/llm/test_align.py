"""Alignment of tokenizers against whole texts, byte by byte."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import align

from .cases import SCHEMA, awkward, frame

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = align.byte_alphabet()


def tokens(text):
    """(ids of a, ends), (ids of b, ends) in bytes, or None."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(ALPHABET[c] for c in A.id_to_token(i))) for i in a.ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return None
    return a, b


def spans(part):
    at, out = 0, []
    for i, x in part:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def aligned(text):
    """links as (a, b) pairs, groups as text."""
    found = tokens(text)
    if found is None:
        return (0, 0, 0), [], ""
    a, b = map(spans, found)
    links, j = [], 0
    for i, lo, hi in a:
        while b[j][2] <= lo:
            j += 1
        k = j
        while k < len(b) and b[k][1] < hi:
            links.append((i, b[k][0]))
            k += 1
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    groups, x, y = [], 0, 0
    for e in ends:
        u, v = x, y
        while u < len(a) and a[u][2] <= e:
            u += 1
        while v < len(b) and b[v][2] <= e:
            v += 1
        groups.append(",".join(str(t[0]) for t in a[x:u]) + "|" + ",".join(str(t[0]) for t in b[y:v]))
        x, y = u, v
    return (len(a), len(b), len(groups)), links, ";".join(groups)


def brute(rows):
    found = [(doc, aligned(text)) for doc, text in rows]
    held = Counter(p for _, f in found for p in set(f[1]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc, (sizes, links, groups) in found:
        out.append((doc, *sizes, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), groups and sha256(groups.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    " lead", "trail ", "two  spaces", "a \n b", "tab\t next", " ", "  ", "\n", "it's 's  's", "▁ low line", "x▁y z", "nul\x00 byte", "e ́ mark", "nbsp  and   em",
    "<|endoftext|> and </s> <unk> <0x41>", "\U0001f600 �   x", "a\x1c b", "\x85 x", "don't  Stop.\n\nNow", "trail \n", "x " * 50, "ﬁne ½ ｗide", "१२ ३",
]


def test_awkward_rows_match_whole_texts(spark):
    rows = [r for r in awkward() if len(r[1] or "") < 60_000]
    rows += [(100 + i, t, "en", "a", 0, "", "", "") for i, t in enumerate(ODD)]
    got = sorted((tuple(r) for r in align.alignment_digest(frame(spark, rows)).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in rows])
    assert align.alignment_digest(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_units_have_the_tokens_that_they_have_in_the_text(seed):
    rng = random.Random(seed)
    al = align.Aligner(None, None)
    assert al.by_unit
    parts = ["a", "Bc", " ", "  ", "\n", "\t", ".", ",", "'s", "12", "é", "́", "的", " ", " ", "<|endoftext|>", "</s>", "-", "\x1c", "\x85", "ab ", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(700)]
    al.learn(list(dict.fromkeys(u for t in texts for u in align.units(t))), None)
    for t, at in zip(texts, al.places(texts, None), strict=True):
        sizes, links, _ = aligned(t)
        assert (*sizes, len(links)) == tuple(al.sums[at].sum(0))
        assert Counter(al.keys.take(at).tolist()) == Counter(a << 32 | b for a, b in links)


def test_long_texts_by_pieces_and_partial_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_CHARS", 300)
    monkeypatch.setattr(align, "PARTIAL_KEYS", 200)
    monkeypatch.setattr(align, "MEMO_UNITS", 60)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 400]))) for _ in range(40)] + ["no▁ " + " ".join(words * 4)]
    rows = [(i, t, "en", "a", 0, "", "", "") for i, t in enumerate(texts)]
    whole, pieces = align.Aligner(None, None), align.Aligner(None, None)
    for t in texts:
        got = np.concatenate([pieces.keys.take(at) for p in pieces.pieces(t) for at in pieces.places([p], None)])
        want = aligned(t)[1]
        assert "▁" in t or Counter(got.tolist()) == Counter(a << 32 | b for a, b in want)
    assert whole.by_unit
    got = sorted((tuple(r) for r in align.alignment_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_lookup_of_pairs_that_no_document_holds(spark):
    counts = align.pair_counts(spark.createDataFrame([(1, "the cat"), (2, "the dog")], "doc_id long, text string"))
    a, b = A.encode(" the").ids[0], B.encode("the")[0]
    assert counts.lookup(np.array(sorted([0, a << 32 | b, 1 << 60]))).tolist() == [0, 2, 0]
    assert counts.best[a] == 2


def test_tokens_are_named_in_one_line_of_their_groups():
    """Groups come from one array of the tokens with their separators: as
    spelled out token by token, for texts with any white space."""
    al = align.Aligner(None, None)
    texts = ["plain words, here: naïve 東京 x1y2", " a  b \n c", "tail ", "a　 b\x1f c", "", None, "Wörter\tund\r\nZeilen  ."]
    counts = align.PairCounts("", [], np.zeros(len(al.a_bytes), np.int64))
    for text, at in zip(texts, al.places(texts, counts), strict=True):
        assert align.units(text or "") == ([] if not text else align._CUT.split(text))
        if not len(at):
            continue
        groups = ";".join(al.texts[i] for i in at.tolist()).split(";")
        sides = [g.split("|") for g in groups]
        a, b = ([int(i) for s in sides for i in s[k].split(",")] for k in (0, 1))
        assert a == al.a.encode(" " + text, add_special_tokens=False).ids and b == al.b.encode(text)
        for x, y in sides:
            assert sum(al.a_width[int(i)] for i in x.split(",")) == sum(al.b_width[int(i)] for i in y.split(","))
        assert len(groups) == al.sums[at].sum(0)[2]
    assert len(al.a_names) == 2 * len(al.a_bytes)
