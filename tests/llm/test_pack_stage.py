from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import packing


def test_the_stage_packs_by_tokens_and_by_loss(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 90 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).alias("n_chars"))
    out = corpus_pipeline.pack(spark, docs.coalesce(1), "").collect()
    tokens, loss = defaultdict(int), defaultdict(int)
    for r in out:
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
    assert sum(loss.values()) < sum(tokens.values())
    assert max(loss.values()) <= 4096 - packing.PROMPT_TOKENS and max(tokens.values()) <= 4096


def test_a_small_memo_gives_the_same_ids():
    import random

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(200)) for _ in range(60)]
    few = packing.WordEncoder(None, 500)
    got = [few.encode([t])[0].tolist() for t in texts]
    assert got == [x.tolist() for x in packing.WordEncoder(None).encode(texts)] and len(few.index) < 2500
