"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents. Other columns of docs
are left out, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import crf, lines, minhash, mixing, packing
from quern.llm.common import words_count
from quern.scratch import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that a packing task remembers: beside what the stages before it leave in
#: an executor, more would not fit.
MEMO_WORDS = 100_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the line field, fitted on a sample of all labels, rejects.

    Null and empty texts are scored as one empty line; every row is judged by
    its own text, repeated ids or not. With labels of one kind only, or none,
    nothing is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = crf.learned_from(docs, labels, F.lit(False))
    scored = crf.score_quality(docs.select(*COLUMNS), field)
    return (scored if field is None else scored.where("predicted = 1")).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines of ten documents and more; every row stays.

    Null texts become empty ones; n_chars is that of what is left."""
    out = lines.drop_shared_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (five words, similarity
    0.8 and more): that of the least id.

    Rows are told apart by id and text: copies under one id, or without an
    id, leave one row too, and unlike texts under one id are judged apart.
    Texts without words have no copies."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS), percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; only ids, hashes of texts,
    sources and sizes are queued, and texts are joined to the result.

    Rows of one id are queued and taken apart, by their texts. Rows that are
    equal in id, source and text share what is taken of them: one such row
    comes as often as all of them together. Texts without words take nothing
    and go."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", "source", mark.alias("mark"), words_count(F.col("text")).alias("n"))
    taken = mixing.mix_sources(slim, F.col("n"), order_cols=("mark",)).where("size > 0")
    key = ["doc_id", "source", "mark"]
    times = taken.groupBy(*[F.col(c).alias(f"__q_{c}") for c in key]).agg(
        F.expr("cast(sum(taken div size) as int)").alias("__q_times"), F.count(F.lit(1)).alias("__q_rows")
    )
    times = write_table(times.where("__q_times > 0"), "times")
    rows = docs.select(*COLUMNS, mark.alias("__q_own"))
    same = F.col("doc_id").eqNullSafe(F.col("__q_doc_id")) & F.col("source").eqNullSafe(F.col("__q_source")) & (F.col("__q_own") == F.col("__q_mark"))
    # As many rows as documents: the texts are sorted to them at any size.
    rows = rows.join(times.hint("merge"), same)
    if not times.where("__q_rows > 1").isEmpty():
        equal = rows.where("__q_rows > 1").dropDuplicates(["__q_doc_id", "__q_source", "__q_mark"])
        rows = rows.where("__q_rows = 1").unionAll(equal)
    return rows.withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids.

    Rows are packed one by one, whatever their ids; a null or empty text is
    the end id alone. As in the packing query, a document's first tokens are
    its prompt and a sequence has room for fewer tokens that bear loss than
    for tokens, so that examples are told apart by more than their length."""
    room = {"prompt_tokens": packing.PROMPT_TOKENS, "max_loss": 4096 - packing.PROMPT_TOKENS}
    return packing.pack_examples(docs.select(*COLUMNS), memo_words=MEMO_WORDS, **room)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("near-dedup", keep_one_of_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The field of the first stage and the tokens of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
