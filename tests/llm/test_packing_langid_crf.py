import math
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import crf, langid, packing

from .cases import awkward, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_encoder_equals_the_tokenizer(tokenizer):
    texts = [r[1] for r in awkward()] + ["a  b\n\n c\r\nd　e\x85f", "don't STOP'S 12 34x é é ́x", "İI ΑΣ Σ"]
    enc = packing.WordEncoder(None)
    for _ in range(2):
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, want, most):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(want)
    for doc, own in by.items():
        whole = np.array(want[doc], np.uint32)
        got = Counter(p for r in own for p in range(r.start, r.start + r.length))
        copies = set(got.values())
        assert len(copies) == 1 and len(got) == len(whole)
        for r in own:
            assert bytes(r.ids) == whole[r.start : r.start + r.length].tobytes() and r.doc_tokens == len(whole)
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= most
    return sequences


def test_pieces_cover_every_id_once(spark, tokenizer):
    docs = frame(spark)
    want = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in awkward()}
    out = packing.pack_examples(docs.coalesce(1)).collect()
    sequences = check_pieces(out, want, 4096)
    used = sum(r.length for r in out)
    assert len(sequences) * 4096 - used <= 4096
    assert packing.pack_examples(frame(spark, [])).count() == 0


def test_limits_hold_together(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 90)), rng.randint(0, 60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int").coalesce(1)
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t, _ in rows}
    for cut in (True, False):
        out = packing.pack_examples(docs, loss_from_col="prompt", max_tokens=128, max_segments=4, max_loss=100, cut=cut).collect()
        for own in check_pieces(out, want, 128).values():
            assert len(own) <= 4 and sum(r.loss_tokens for r in own) <= 100
        prompt = {r[0]: r[2] for r in rows}
        for r in out:
            assert r.loss_tokens == max(0, r.start + r.length - max(r.start, prompt[r.doc_id]))
        if not cut:
            assert len(out) == len(rows)


def test_many_tiny_examples_are_packed_at_once():
    packer = packing.Packer(4096, 4096, 4096, True, 0)
    one = np.zeros(1, np.uint32)
    began = time.perf_counter()
    for i in range(500_000):
        packer.add(i, one, 0)
    packer.fill(last=True)
    out = packer.flush()
    assert time.perf_counter() - began < 60
    assert len(out) == 500_000 and len({r[6] for r in out}) == math.ceil(500_000 / 4096)


def test_buckets_choose_as_a_scan_of_all_examples_does():
    """Against a plain packer that looks at every waiting example."""
    rng = random.Random(2)
    for limits in ((100, 5, 70), (64, 64, 64), (50, 3, 10)):
        items = [(i, rng.randint(1, 40), 0) for i in range(200)]
        items = [(i, n, rng.randint(max(0, n - limits[2]), n)) for i, n, _ in items]
        packer = packing.Packer(*limits, False, 0)
        for i, n, free in items:
            packer.add(i, np.zeros(n, np.uint32), free)
        packer.fill(last=True)
        got = defaultdict(list)
        for r in packer.flush():
            got[r[6]].append((r[2], r[5]))
        left, want = [(n, n - free) for _, n, free in items], []
        while left:
            room, own = list(limits), []
            while room[1] and (fits := [x for x in left if x[0] <= room[0] and x[1] <= room[2]]):
                score = lambda x: x[0] / limits[0] * room[0] / limits[0] + x[1] / limits[2] * room[2] / limits[2]
                best = max(fits, key=score)
                left.remove(best)
                own.append(best)
                room = [room[0] - best[0], room[1] - 1, room[2] - best[1]]
            want.append(own)
        assert len(got) <= len(want) + 1
        assert all(len(own) <= limits[1] and sum(x[0] for x in own) <= limits[0] and sum(x[1] for x in own) <= limits[2] for own in got.values())


def test_the_query_keeps_to_its_loss_limit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    out = packing.pack_digest(docs).collect()
    tokens, loss = Counter(), Counter()
    for r in out:
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, min(64, r.doc_tokens // 4)))
    assert max(tokens.values()) == 4096 and max(loss.values()) == 4096 - 64  # both limits bind
    assert len(tokens) * 4096 <= 1.02 * sum(tokens.values()) + 4096


def test_very_long_texts_are_encoded_by_pieces(tokenizer):
    rng = random.Random(8)
    text = "".join(rng.choice(["word ", "Über\n", "x.\t", "İstanbul ", "<|endoftext|> ", "a"]) for _ in range(4000))
    packing.CHUNK_CHARS, old = 500, packing.CHUNK_CHARS
    try:
        assert len(list(packing.blank_pieces(text, 500))) > 20
        got = packing.WordEncoder(None).encode([text, None, "x"])
    finally:
        packing.CHUNK_CHARS = old
    for t, ids in zip([text, "", "x"], got, strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_another_tokenizer_file_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Two  Words\n and more", None, "ÉT <|endoftext|>"]
    for t, ids in zip(texts, packing.WordEncoder(path).encode(texts), strict=True):
        assert ids.tolist() == plain.encode(t or "", add_special_tokens=False).ids


def naive_code_length(train, text):
    """PPM of order 3, straight from its definition, over byte strings."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        b = b"\n\n\n" + t.lower().encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[k][b[i - k : i]][b[i]] += 1
    total, b = 0.0, b"\n\n\n" + text.lower().encode()
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0):
            seen = counts[k].get(b[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total -= math.log(seen[b[i]] / (n + d))
                break
            total -= math.log(d / (n + d))
        else:
            total += math.log(256)
    return total


def test_code_lengths_equal_the_definition():
    rng = random.Random(3)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    train = {"a": [make("abc é", 200), make("abcd", 50)], "b": [make("xyz ß", 300)]}
    lang, code, count = [], [], []
    for i, texts in enumerate(train.values()):
        parts = [p for own, _ in langid.in_pieces(texts, 50) for p in own]
        c, n = np.unique(langid.four_grams(parts)[0], return_counts=True)
        lang += [i] * len(c)
        code += c.tolist()
        count += n.tolist()
    trees = langid.ByteTrees(["a", "b"], np.array(lang), np.array(code, np.int64), np.array(count, float))
    texts = [make("abcé xyz", 80), "", None, "ABC é", make("qrs", 30), "中文"]
    got = trees.code_lengths(texts)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx([naive_code_length(x, t or "") for x in train.values()])
    langid.PIECE_VALUES, old = 0, langid.PIECE_VALUES  # the smallest pieces
    try:
        long = texts[0] * 300
        assert trees.code_lengths([long, "a"])[0] == pytest.approx([naive_code_length(x, long) for x in train.values()])
    finally:
        langid.PIECE_VALUES = old


def test_language_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in langid.language_digest(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.95
    # neither lang, source nor id take part in a prediction
    trees = langid.learn_trees(docs)
    bare = langid.predict_language(docs.select("text"), trees).select("text", "lang_pred", "score")
    full = langid.predict_language(docs, trees).select("text", "lang_pred", "score")
    assert sorted(bare.collect()) == sorted(full.collect())


def test_language_of_awkward_rows(spark):
    docs = frame(spark)
    out = langid.language_digest(docs).collect()
    assert len(out) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        if r.doc_id is not None:
            has = any(c.isalpha() for c in text[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    none = langid.language_digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.language_digest(frame(spark, [])).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 1, 5, 8])
    score, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, logz = crf.marginals(score, trans, bounds)
    pairs = iter(pair)
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        z, p, q = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in product((0, 1), repeat=b - a):
            w = math.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False)))
            z += w
            p += w * np.array(y)
            for i in range(1, b - a):
                q[i, y[i - 1], y[i]] += w
        assert good[a:b] == pytest.approx(p / z)
        assert logz[d] == pytest.approx(math.log(z))
        for i in range(1, b - a):
            assert next(pairs) == pytest.approx(q[i] / z)


def test_long_chains_equal_forward_backward():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    for n in (1, 2, 3, 10, 97, 1000):
        score = rng.normal(size=n) * 5
        assert crf.chain_marginals(score, trans) == pytest.approx(crf.marginals(score, trans, np.array([0, n]))[0], abs=1e-12)


def test_features_by_pieces_equal_those_of_the_whole():
    rng = random.Random(6)
    words = ["one", "TWO", "two", "é|!", "x.", "  ", "#"]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(60))
    long = "w" * 900
    odd = [long, f"{long} {long} {long}x", f"  {long}\t\t {long}", f"a {long}", f"{long}  b {long}\n{long}", "é" * 700, " " * 900, f"{' ' * 450}{long}{' ' * 300}"]
    for t in (text, text + "\n", " ".join(["same"] * 500), "\n" * 300, "", *odd):
        x, size, _ = crf.line_features([t])
        got = list(crf.features_by_pieces(t, 200))
        assert np.allclose(np.concatenate([g[0] for g in got]), x) and (np.concatenate([g[1] for g in got]) == size).all()


def test_potentials_equal_the_features_with_neighbours():
    rng = np.random.default_rng(5)
    field = crf.LineField(rng.normal(size=17), rng.random(17) + 1, rng.normal(size=54), rng.normal(size=(2, 2)), 1.0, 0.0)
    x, size, bounds = crf.line_features(["a b\nc", "", "X\n\n\nY z"])
    want = crf.with_neighbours((x - field.mean) / field.spread, bounds) @ field.weights
    assert field.potentials(field.parts(x), bounds) == pytest.approx(want)
    texts = ["a b\nC!\n" * 40, "### |"]
    whole = field.scores(texts)
    crf.PIECE, crf.LONG_LINES, old = 50, 5, (crf.PIECE, crf.LONG_LINES)
    try:
        assert field.scores([texts[0]]) == pytest.approx(whole[:1])
    finally:
        crf.PIECE, crf.LONG_LINES = old


def test_quality_matches_brute_force(spark, sf_dir):
    """The query's scores from the field by enumeration of paths for short
    texts and step by step for all; folds and thresholds from the contract."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = crf.learned_from(docs, labels, langid.in_fold("doc_id", 4, 2))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in crf.quality_digest(docs, labels).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)
        x, size, bounds = crf.line_features([text[r.doc_id]])
        z = crf.with_neighbours((x - field.mean) / field.spread, bounds) @ field.weights
        alpha = [np.array([0.0, z[0]])]
        for s in z[1:]:
            alpha.append(np.logaddexp(*(alpha[-1][:, None] + field.trans)) + np.array([0.0, s]))
        beta = [np.zeros(2)]
        for s in z[:0:-1]:
            beta.append(np.logaddexp(*(field.trans + np.array([0.0, s]) + beta[-1]).T))
        both = np.stack(alpha) + np.stack(beta[::-1])
        good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
        raw = np.clip((good * (size + 1)).sum() / (size + 1).sum(), 1e-4, 1 - 1e-4)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(field.slope * math.log(raw / (1 - raw)) + field.offset))), rel=1e-6)


def test_very_long_texts_are_scored(spark):
    """A million lines, and a line of 20 MB, with bounded memory and time."""
    field = crf.LineField(np.zeros(17), np.ones(17), np.full(54, 0.01), np.zeros((2, 2)), 1.0, 0.0)
    began = time.perf_counter()
    for t in ("some words\n" * 1_000_000, "word and " * 2_500_000):
        assert 0 <= field.scores([t])[0] <= 1
    assert time.perf_counter() - began < 60


def test_line_features_do_not_depend_on_the_batch():
    texts = [r[1] for r in awkward()]
    x, size, bounds = crf.line_features(texts)
    for i, t in enumerate(texts):
        y, s, b = crf.line_features([t])
        assert np.allclose(x[bounds[i] : bounds[i + 1]], y) and (size[bounds[i] : bounds[i + 1]] == s).all()
        assert b.tolist() == [0, len((t or "").split("\n"))]


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in crf.quality_digest(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    bad = [r.score for r in held if truth[r.doc_id] == 0]
    good = [r.score for r in held if truth[r.doc_id] == 1]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95


def test_quality_of_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, 1), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = crf.quality_digest(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert {r.score for r in crf.quality_digest(docs, labels.limit(0)).collect()} == {0.5}
    assert crf.quality_digest(frame(spark, []), labels).count() == 0


def test_scores_keep_the_ratio_of_the_labels_when_sampled(spark):
    """Overlapping classes, 12 good to 1 bad: a bounded sample must not move
    the mean score of a whole table off its share of good documents."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(5200):
        good = i % 13 != 0
        junk = rng.random(6) < (0.35 if good else 0.65)
        rows.append((i, "\n".join("### $$$ ||| !!! 123" if j else "Some plain words make a line." for j in junk), *[None] * 6))
        labels.append((i, int(good)))
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, y int")
    texts = [r[1] for r in rows]
    whole = crf.learn_field(docs, known, n_docs=5200).scores(texts)
    part = crf.learn_field(docs, known, n_docs=150).scores(texts)
    assert whole.mean() == pytest.approx(12 / 13, abs=0.005)
    assert part.mean() == pytest.approx(12 / 13, abs=0.015)
    assert np.mean((whole >= 0.7) == (part >= 0.7)) >= 0.95
