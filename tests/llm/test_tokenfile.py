"""Coded blocks of token ids: exact round trips, damage, order and starts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import tokenfile
from quern.scratch import write_table

from .cases import SCHEMA, awkward, frame

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows):
    """(doc_id, start, n_tokens, ids_crc32) in ascending id order, equal ids in any."""
    ids = {i: np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, (_, t) in enumerate(rows)}
    return [(rows[i][0], len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()]


def check(got, rows):
    """Starts are gapless in ascending id order; sizes and checksums are those of whole texts."""
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(brute(rows), key=repr)
    at = 0
    got = sorted(got, key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    names = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert names == sorted(names)


def test_awkward_rows_come_back(spark):
    rows = awkward()
    check(tokenfile.token_digest(frame(spark, rows)).collect(), [(r[0], r[1]) for r in rows])
    assert tokenfile.token_digest(frame(spark, rows).limit(0)).count() == 0


def test_documents_over_many_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 37)
    monkeypatch.setattr(tokenfile, "LANES", 5)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["red", "green", "blue", "cyan", "Tier 7"]) for _ in range(rng.choice([0, 3, 35, 36, 37, 300]))) for _ in range(120)]
    rows = [(rng.randrange(60), t) for t in texts]
    df = spark.createDataFrame([(i, t, "en", "a", 0, "", "", "") for i, t in rows], SCHEMA).repartition(3)
    check(tokenfile.token_digest(df).collect(), rows)
    files = write_table(tokenfile.write_tokens(df), "t")
    assert files.count() > 100 and files.agg({"n_ids": "max"}).first()[0] == 37
    whole = {}
    for r in sorted(tokenfile.read_tokens(files).collect(), key=lambda r: (r.start, r.piece_start)):
        whole[r.start] = whole.get(r.start, b"") + r.ids
        assert len(r.ids) == 4 * r.piece_ids
    want = sorted(np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    assert sorted(whole.values()) == want
    # without an end id, empty documents are pieces of no ids
    bare = tokenfile.read_tokens(write_table(tokenfile.write_tokens(df, end_id=None), "t")).where("last")
    assert bare.count() == 120


@pytest.mark.parametrize("bound", [256, 1 << 16, 1 << 20, 1 << 30])
def test_ids_of_any_kind_come_back(bound):
    rng = np.random.default_rng(bound)
    blocks = [rng.zipf(1.2, rng.integers(1, 700)).clip(1, bound) - 1 for _ in range(9)]
    blocks += [np.zeros(0, int), np.full(600, bound - 1), np.arange(600) % 3, rng.integers(0, bound, 700), np.arange(1), np.tile(rng.integers(0, bound, 9), 60)]
    blocks = [b.astype(np.uint32) for b in blocks]
    coded = tokenfile.code(blocks, bound)
    back = tokenfile.decode(coded, [len(b) for b in blocks], bound)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    alone = [tokenfile.code([b], bound)[0] for b in blocks]  # a block's bytes do not hang on its neighbours
    assert [len(x) for x in alone] == [len(x) for x in coded]
    assert all(np.array_equal(tokenfile.decode([x], [len(b)], bound)[0], b) for x, b in zip(alone, blocks, strict=True))
    assert len(coded[-1]) < len(coded[-3]) / 4 and len(coded[10]) < 200  # what repeats takes little room


def test_carries_run_through_words_of_all_ones():
    """Ids at the upper end of the scale, where sums run over most often."""
    rng = np.random.default_rng(0)
    for bound in (1 << 16, 1 << 20):
        blocks = [np.where(rng.random(2000) < p, bound - 1, rng.integers(bound - 9, bound, 2000)).astype(np.uint32) for p in np.linspace(0, 1, 60)]
        back = tokenfile.decode(tokenfile.code(blocks, bound), [2000] * 60, bound)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))


def test_damage_is_found():
    writer = tokenfile.Writer(50)
    writer.add(1, np.arange(120, dtype=np.uint32))
    writer.cut()
    data = [d for *_, d in writer.flush()]
    assert [b.ids.tolist() for b in tokenfile.unpack(data)] == [list(range(50)), list(range(50, 100)), list(range(100, 120))]
    for at in (0, 9, 20, 50, len(data[0]) - 1):
        bad = bytearray(data[0])
        bad[at] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            tokenfile.unpack([bytes(bad)])
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.unpack([data[0][:-2]])
